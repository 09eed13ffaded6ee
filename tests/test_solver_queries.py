"""Solver queries against dense solutions on the smallest provided tables."""

from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="provided tables are not here")


def test_level_seams_takes_all_seams(spark):
    part = {r["p_partkey"]: r["p_retailprice"] for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    at = {v * 10 + label: i for i, (v, label) in enumerate((v, label) for v in sorted(part) for label in (1, 2))}
    a, b = [], []
    for v, price in part.items():
        row = np.zeros(len(at))
        row[at[v * 10 + 1]], row[at[v * 10 + 2]] = 1, -1
        a.append(row)
        b.append(np.sin(float(price)) * 0.1)
        for w in {v + 1, v + 37} & part.keys():
            for label in (1, 2):
                row = np.zeros(len(at))
                row[at[v * 10 + label]], row[at[w * 10 + label]] = 0.1, -0.1
                a.append(row)
                b.append(0.0)
    want = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0]
    got = {r["node"]: r["d0"] for r in entry.queries()["G10_level_seams"](spark, str(DATA)).collect()}
    assert got.keys() == at.keys()
    assert max(abs(got[n] - (want[i] - want.mean())) for n, i in at.items()) < 1e-3
