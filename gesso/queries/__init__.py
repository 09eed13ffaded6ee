"""Registered queries, grouped by subject."""

import importlib

SUBJECTS = ("colour", "geometry", "catalog", "sessions", "grid", "relief", "calibration", "mosaic", "mesh", "sources")


def load_all() -> None:
    for subject in SUBJECTS:
        importlib.import_module(f"gesso.queries.{subject}_queries")
