import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gesso.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 8)


@pytest.fixture
def rng():
    return np.random.default_rng(7)


def plane_rows(plane, name="v", image=0):
    """Pixel rows of a numpy plane."""
    h, w = plane.shape
    return [(image, y, x, float(plane[y, x])) for y in range(h) for x in range(w)]


def frame(spark, plane, name="v", image=0):
    return spark.createDataFrame(plane_rows(plane, name, image), f"image_id int, y int, x int, {name} double")


def to_plane(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[name] if r[name] is not None else np.nan
    return out
