"""Readers and writers for the file layouts the jobs use."""
