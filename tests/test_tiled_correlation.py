"""Correlation from tiles of long rows and from one aggregate, against pandas: gaps, constant series, keys, many blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.operators import stats


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 11)) + rng.normal(size=(60, 1)) + 1e4
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 3] = 0.1
    x[:, 4] = np.nan
    x[:5, 4] = 7.0
    return pd.DataFrame(x, columns=[f"d{i:02d}" for i in range(11)])


def _want(wide):
    varies = wide.max() > wide.min()
    r = wide.corr()
    for c in wide.columns:
        r.loc[c, c] = 1.0
        if not varies[c]:
            r.loc[c, :] = r.loc[:, c] = np.nan
    return r


@pytest.mark.parametrize("tile", [512, 3, 1])
def test_tiles(spark, wide, tile):
    rows = [(n, int(t), float(v)) for n in wide for t, v in wide[n].items() if not math.isnan(v)] + [(None, 1, 2.0), ("d00", 99, None)]
    long = spark.createDataFrame(rows, "n string, t long, v double").repartition(5)
    got = stats.corr_matrix_long(long, "n", "t", "v", digits=None, tile=tile).collect()
    want = _want(wide)
    assert len(got) == 121 and len({(r["a"], r["b"]) for r in got}) == 121
    for r in got:
        w = want.loc[r["a"], r["b"]]
        assert (r["r"] is None) == bool(np.isnan(w)) and (r["r"] is None or math.isclose(r["r"], w, abs_tol=1e-6)), r
    best = {r["kind"]: (r["a"], r["b"]) for r in stats.strongest_pairs(stats.corr_matrix_long(long, "n", "t", "v", digits=None, tile=tile)).collect()}
    upper = {(a, b): want.loc[a, b] for a in wide for b in wide if a < b and not np.isnan(want.loc[a, b])}
    assert best == {"max": max(upper, key=upper.get), "min": min(upper, key=upper.get)}


def test_tiles_per_key(spark, wide):
    rows = [(k, n, int(t), float(v) * (1 if k == "a" else (-1) ** int(n[1:]))) for k in ("a", "b") for n in wide for t, v in wide[n].items() if not math.isnan(v)]
    long = spark.createDataFrame(rows, "k string, n string, t long, v double")
    got = {(r["k"], r["a"], r["b"]): r["r"] for r in stats.corr_matrix_long(long, "n", "t", "v", keys=["k"], tile=4).collect()}
    assert len(got) == 242 and got["a", "d00", "d01"] == -got["b", "d00", "d01"] != 0


def test_few_columns_are_one_aggregate(spark, wide):
    few = wide[["d00", "d01", "d03", "d05"]]
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in few.to_numpy()], ", ".join(f"{c} double" for c in few))
    out = stats.corr_matrix(df, list(few), digits=None)
    want = _want(few)
    for r in out.collect():
        w = want.loc[r["a"], r["b"]]
        assert (r["r"] is None) == bool(np.isnan(w)) and (r["r"] is None or math.isclose(r["r"], w, abs_tol=1e-9))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    assert out.where(F.col("i") == F.col("j")).count() == 4
