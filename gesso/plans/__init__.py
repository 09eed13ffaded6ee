"""Multi-stage jobs: solvers, calibration, alignment, labelling."""
