"""Sorted outputs, ranges that reach the scan, late readings of the stream, split ranks without a broadcast."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlake.operators import kpi, resample
from meterlake.sources import tables

SF_SMALL = "/root/testdata/sf0.001"


def test_groups_come_in_the_order_of_their_places(spark):
    df = spark.createDataFrame([("Rain", 6), ("Clear", 0), ("Breezy", 9), ("Overcast", 3)], "weather_group string, weather_ord int").repartition(3)
    assert [r[0] for r in kpi.ordered_groups(df, "weather_ord").collect()] == ["Clear", "Overcast", "Rain", "Breezy"]


def test_series_come_in_the_order_of_keys_and_days(spark):
    days = [dt.date(2020, 1, d) for d in (3, 1, 2)]
    df = spark.createDataFrame([(k, d) for k in ("b", "a") for d in days], "k string, ds date").repartition(4)
    assert [tuple(r) for r in kpi.sort_series(df, keys=["k"]).collect()] == [(k, d) for k in ("a", "b") for d in sorted(days)]
    assert [r["ds"] for r in kpi.sort_series(df.select("ds")).collect()] == sorted(days * 2)


@pytest.mark.parametrize("freq", ["hour", "day", "month"])
def test_ranges_of_buckets_reach_the_scan(spark, freq):
    events = tables.read_table(spark, SF_SMALL, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    lo, hi = str(first + (last - first) / 4), str(last - (last - first) / 4)
    every = resample.resample(events, "value", freq, gap_fill=None)
    name = next(c for c in every.columns if c != "value")
    want = {r[name]: r["value"] for r in every.collect()}
    cut = lambda t: {"hour": t.replace(minute=0, second=0, microsecond=0), "day": t.date(), "month": t.date().replace(day=1)}[freq]
    a, b = cut(dt.datetime.fromisoformat(lo)), cut(dt.datetime.fromisoformat(hi))
    out = resample.resample(events, "value", freq, gap_fill=None, start=lo, end=hi)
    got = {r[name]: r["value"] for r in out.collect()}
    assert set(got) == {k for k in want if a <= k <= b} and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_late_readings_count(spark, tmp_path):
    from meterlake.streaming.hourly import current_hourly, hourly_energy_stream, run_to_table
    schema = "k string, ts timestamp_ntz, v double"
    for i, (hour, value) in enumerate(((5, 60.0), (20, 30.0), (5, 120.0))):  # the third comes fifteen hours late
        spark.createDataFrame([("a", dt.datetime(2020, 1, 1, hour, 10), value)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={i}"))
        stream = hourly_energy_stream(spark, f"{tmp_path}/in/*/*.parquet", spark.createDataFrame([], schema).schema, "v", ["k"])
        run_to_table(stream, str(tmp_path / "table"), str(tmp_path / "ckpt")).awaitTermination()
    got = {r["hour"].hour: r["kwh"] for r in current_hourly(spark, str(tmp_path / "table"), ["k"]).collect()}
    assert got == {5: 3.0, 20: 0.5}


def test_split_ranks_joined_by_shuffle(spark, tmp_path, monkeypatch):
    spark.range(50).repartition(4).write.option("header", True).csv(str(tmp_path / "in"))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType())])
    want = {r["id"]: r["row_order"] for r in tables.scan_meter_csv(spark, str(tmp_path / "in"), schema).collect()}
    monkeypatch.setattr(tables, "BROADCAST_SPLITS", 0)
    assert {r["id"]: r["row_order"] for r in tables.scan_meter_csv(spark, str(tmp_path / "in"), schema).collect()} == want
