import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gesso.operators.scans import exact_quantiles, global_rank, least_squares, running


def hot_rows(rng, n=900):
    """One key holds a third of all rows."""
    keys = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    return pd.DataFrame({"k": keys.astype("int32"), "t": rng.permutation(n).astype("int64"), "v": rng.normal(size=n)})


@pytest.mark.parametrize("chunks", [1, 3, 16])
def test_running_matches_pandas_whatever_the_chunks(spark, rng, chunks):
    pdf = hot_rows(rng)
    out = running(spark.createDataFrame(pdf), ["k"], ["t"], [("s", "sum", "v", True), ("m", "min", "v", False), ("n", "count", "v", True)], chunks)
    got = out.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    by = want.groupby("k")["v"]
    assert np.allclose(got["s"], by.cumsum())
    assert (got["n"] == by.cumcount() + 1).all()
    low = by.cummin().groupby(want["k"]).shift(1)
    assert np.allclose(got["m"].fillna(99), low.fillna(99))


def test_global_rank_is_dense(spark, rng):
    pdf = hot_rows(rng)
    got = global_rank(spark.createDataFrame(pdf), ["k", "t"]).toPandas().sort_values(["k", "t"])
    assert got["rank"].tolist() == list(range(1, len(pdf) + 1))


@pytest.mark.parametrize("settle", [10**6, 5])
def test_exact_quantiles_match_numpy(spark, rng, settle):
    """``settle=5`` forces the narrowing rounds."""
    pdf = hot_rows(rng, 600)
    pdf.loc[pdf.index % 7 == 0, "v"] = 0.25
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs, bins=8, settle=settle).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert np.allclose(got.loc[k].to_numpy(dtype=float), np.quantile(part["v"], probs))
    whole = exact_quantiles(spark.createDataFrame(pdf), [], "v", probs, bins=8, settle=settle).first()
    assert np.allclose(list(whole), np.quantile(pdf["v"], probs))


def test_least_squares_matches_numpy(spark, rng):
    x = rng.normal(size=(200, 3))
    w = rng.uniform(0.2, 2, 200)
    y = x @ np.array([[1.0, -2.0], [0.5, 3.0], [2.0, 0.0]]) + 0.1 * rng.normal(size=(200, 2))
    df = spark.createDataFrame([(*map(float, a), *map(float, b), float(c)) for a, b, c in zip(x, y, w)], "a double, b double, c double, p double, q double, w double")
    coef = least_squares(df, [], [F.col("a"), F.col("b"), F.col("c")], [F.col("p"), F.col("q")], F.col("w")).first()["coef"]
    sw = np.sqrt(w)[:, None]
    want = np.linalg.lstsq(x * sw, y * sw, rcond=None)[0].T.ravel()
    assert np.allclose(coef, want)
