"""The ordered scan behind positions and back-fill: ties, NULLs, keys over many ranges, and its plan."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import clean, ingest
from meterlake.operators.scan import ordered_scan

SCHEMA = "k string, o long, v string, id long"


def _rows(seed=1, n=400):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", None, "b"]
    return [(rng.choice(keys), rng.choice([None, *range(40)]), rng.choice([None, "junk", "junk", "junk", "1.5", "x"]), i) for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 3, 50])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_scan_against_a_plain_loop(spark, ranges, keys):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("tie", F.xxhash64("k", "o", "v", "id"))
    order = [F.col("o").desc_nulls_last(), F.col("tie").asc()]
    valid = F.when(F.col("v").isNull() | (F.col("v") != "junk"), F.struct("v"))
    got = ordered_scan(df, order, keys, position="p", last_valid={"seen": valid, "last_o": F.col("o")}, ranges=ranges).collect()
    assert len(got) == len(rows)
    plain = sorted(df.collect(), key=lambda r: (r["o"] is None, -(r["o"] or 0), r["tie"]))
    want, state = {}, {}
    for r in plain:
        key = r["k"] if keys else 0
        p, seen, last = state.get(key, (0, None, None))
        seen = (r["v"],) if r["v"] != "junk" else seen
        last = r["o"] if r["o"] is not None else last
        want[r["id"]] = (p, seen, last)
        state[key] = (p + 1, seen, last)
    assert {r["id"]: (r["p"], r["seen"] and tuple(r["seen"]), r["last_o"]) for r in got} == want


def test_scan_reads_its_input_once_and_joins_one_row_a_range(spark, tmp_path):
    spark.range(5000).select((F.col("id") * 7919 % 5003).alias("o"), F.lit("x").alias("v")).write.parquet(str(tmp_path / "in"))
    out = ingest.row_position(spark.read.parquet(str(tmp_path / "in")), "o", n_buckets=16)
    assert out.where("o != pos").count() == out.where("pos != o").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and str(tmp_path) not in plan
    assert plan.count("FileScan parquet") == 1 and "PartitionFilters: [isnotnull(_scan_kind" in plan


def test_one_value_of_many_rows_is_cut_into_ranges(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("o"), "id")
    out = ingest.row_position(df, "o", n_buckets=12)
    files = out.where("o = 5").select(F.input_file_name().alias("f")).distinct().count()
    assert files >= 3
    assert sorted(r["pos"] for r in out.collect()) == list(range(6000))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ingest.row_position(empty, "o").collect() == []
    assert clean.clean_backfill(empty, "v", ["o"], keys=["k"]).collect() == []


@pytest.mark.parametrize("with_nulls", [False, True])
def test_load_pipeline_equals_its_steps(spark, with_nulls):
    """One scan for dropping the last row, positions and back-fill gives what the three steps one after the other give."""
    rng = random.Random(3)
    rows = [(i // 2, float(i), 1.0, rng.choice(["cloudCover", "cloudCover", "0.25", "0.5"])) for i in range(60)] + [(30, 107.0, 1.0, "0.75"), (30, 108.0, 1.0, "0.125")]
    if with_nulls:
        rows += [(None, 109.0, 1.0, "cloudCover"), (None, 110.0, 1.0, "0.0625")]
    raw = spark.createDataFrame(rows, "row_order long, use_kw double, gen_kw double, cloudCover string").repartition(5)
    steps = ingest.assign_regular_time(ingest.drop_last_row(raw, "row_order"), "row_order")
    want = {r["use_kw"]: (r["ts"], r["cloudCover"]) for r in clean.clean_backfill(steps, "cloudCover", ["ts"]).collect()}
    got = {r["use_kw"]: r for r in ingest.load_pipeline(raw).collect()}
    times = sorted(r["ts"] for r in got.values())
    assert times == [dt.datetime(2016, 1, 1, 5) + dt.timedelta(minutes=m) for m in range(len(times))]
    assert set(got) == set(want) and {u: got[u]["ts"].minute // 2 for u in got if u < 60} == {u: want[u][0].minute // 2 for u in want if u < 60}
    order = {u: r["ts"] for u, r in got.items()}
    raw_value = {r[1]: r[3] for r in rows}
    for u, r in got.items():  # the next valid value in time among the rows that stay
        later = [raw_value[x] for x in sorted(order, key=order.get) if order[x] >= order[u] and raw_value[x] != "cloudCover"]
        assert r["cloudCover"] == (float(later[0]) if later else None)
    assert {107.0, 108.0}.isdisjoint(got)
