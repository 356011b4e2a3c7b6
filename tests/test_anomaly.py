"""Monthly anomaly flags against a plain version: draws over all rows, trees, scores, cuts; series keys, parts, NULLs, partitionings."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.operators import anomaly

SCHEMA = "site string, id long, ts timestamp_ntz, use double, temp double, note string"


def _rows(seed=5):
    rng = random.Random(seed)
    out = []
    for site, month, n in (("a", 1, 700), ("a", 2, 101), ("a", 3, 100), (None, 1, 300)):
        for i in range(n):
            far = 40.0 if i % 50 == 0 else 0.0
            out.append((site, len(out), dt.datetime(2020, month, 1 + i % 28, i % 24), rng.gauss(0, 1) + far, rng.gauss(5, 2), f"n{i}"))
    out += [("a", 9_000, dt.datetime(2020, 1, 3), None, 1.0, "missing"), ("a", 9_001, dt.datetime(2020, 1, 3), float("nan"), 1.0, "nan"), ("a", 9_002, None, 1.0, 1.0, "no time")]
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(4)


def _flags(df, **options):
    return anomaly.monthly_anomalies(df, ["id"], ["use", "temp"], n_trees=20, keys=["site"], **options)


def _walk(tree, x):
    feature, threshold, left, right, size = tree
    node, depth = 0, 0
    while feature[node] >= 0:
        node = left[node] if x[feature[node]] <= threshold[node] else right[node]
        depth += 1
    return depth + float(anomaly._c(size[node]))


def test_flags_against_a_plain_version(spark, frame):
    """The draws, the trees and the cut of one month, worked out row by row."""
    got = {r["id"]: r for r in _flags(frame).collect()}
    h = F.xxhash64(F.lit(42), "id", "use", "temp")
    month = frame.where("site = 'a' and month(ts) = 1 and use is not null and not isnan(use)").withColumn("_h", h)
    rows = {r["id"]: (r["use"], r["temp"]) for r in month.collect()}
    trees = []
    import zlib
    name = zlib.crc32("a\x1f2020-01".encode())
    for t in range(20):
        order = month.withColumn("d", F.shiftrightunsigned(F.xxhash64("_h", F.lit(t)), 1)).orderBy("d").limit(256).collect()
        trees.append(anomaly._grow_tree(np.array([(r["use"], r["temp"]) for r in order]), np.random.default_rng([42, name, t]), 8))
    score = {i: 2.0 ** (-np.mean([_walk(t, x) for t in trees]) / float(anomaly._c(256))) for i, x in rows.items()}
    assert all(np.isclose(got[i]["anomaly_score"], s, rtol=1e-12) for i, s in score.items())
    cut = np.quantile([-s for s in score.values()], 0.03)
    assert {i for i in score if got[i]["anomaly"] == -1} == {i for i, s in score.items() if -s < cut}
    assert sum(got[i]["anomaly"] == -1 and abs(rows[i][0]) > 20 for i in rows) >= 13


def test_gate_missing_values_and_all_columns(frame):
    got = _flags(frame)
    assert got.columns == [*frame.columns, "year_month", "anomaly_score", "anomaly"]
    rows = got.collect()
    assert len(rows) == len(_rows()) and {r["id"] for r in rows} == {r[1] for r in _rows()}
    by = {}
    for r in rows:
        by.setdefault((r["site"], r["year_month"]), []).append(r)
    assert all(r["anomaly"] == 1 and r["anomaly_score"] is None for r in by["a", "2020-03"] + by["a", None])
    assert sum(r["anomaly"] == -1 for r in by[None, "2020-01"]) == 9 and sum(r["anomaly"] == -1 for r in by["a", "2020-02"]) == 3
    missing = [r for r in rows if r["id"] in (9_000, 9_001, 9_002)]
    assert len(missing) == 3 and all(r["anomaly"] == 1 and r["anomaly_score"] is None for r in missing)


def test_flags_do_not_depend_on_partitions_parts_or_joins(frame, monkeypatch):
    first = sorted(map(tuple, _flags(frame).select("id", "anomaly_score", "anomaly").collect()), key=str)
    monkeypatch.setattr(anomaly, "PART_ROWS", 37)  # a month over many tasks
    monkeypatch.setattr(anomaly, "BROADCAST_ROWS", 0)
    again = sorted(map(tuple, _flags(frame.repartition(11)).select("id", "anomaly_score", "anomaly").collect()), key=str)
    assert first == again


def test_scaling_the_columns_changes_no_score():
    """Why the trees need no scaled columns: splits lie between a column's least and largest value."""
    x = np.random.default_rng(0).normal(size=(200, 3))
    z = x * [4.0, 0.25, 2.0] + [8.0, -1.0, 0.5]
    for seed in range(5):
        a, b = (anomaly._grow_tree(v, np.random.default_rng(seed), 8) for v in (x, z))
        assert (a[0], a[2], a[3], a[4]) == (b[0], b[2], b[3], b[4])
        assert [_walk(a, r) for r in x] == [_walk(b, r) for r in z]


def test_series(frame):
    flags = _flags(frame)
    one = anomaly.anomaly_series(flags, "2020-01", keys={"site": None})
    assert one.count() == 300 and one.columns[0] == "ts"
    assert anomaly.anomaly_series(flags, "2020-01").count() == 1002


def test_empty_table(frame):
    assert _flags(frame.where("id < 0")).count() == 0
