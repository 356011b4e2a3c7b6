"""Gap fill from one scan, NULL keys and times, positions with NULLs and ties, and the shared folder."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlake import session
from meterlake.operators import density, ingest, kpi, resample, stats
from meterlake.operators._util import null_safe_join

DAY = dt.date
READINGS = "device string, ts timestamp_ntz, kw double"


def _frame(spark):
    t = lambda d: dt.datetime(2020, 1, d, 5)
    return spark.createDataFrame([("a", t(1), 60.0), ("a", t(4), 30.0), ("a", None, 9.0), (None, t(2), 120.0), (None, t(3), None)], READINGS)


def test_roll_up_keeps_null_keys(spark):
    got = {(r["device"], r["day"]): r["kw"] for r in resample.daily_energy(_frame(spark), keys=["device"]).collect()}
    assert got == {("a", DAY(2020, 1, 1)): 1.0, ("a", DAY(2020, 1, 2)): 0.0, ("a", DAY(2020, 1, 3)): 0.0, ("a", DAY(2020, 1, 4)): 0.5,
                   (None, DAY(2020, 1, 2)): 2.0, (None, DAY(2020, 1, 3)): 0.0}


def test_mean_leaves_empty_days_null_and_range_widens(spark):
    got = resample.daily_mean(_frame(spark), ["kw"], keys=["device"]).where("device = 'a'").orderBy("day").collect()
    assert [r["kw"] for r in got] == [60.0, None, None, 30.0]
    wide = resample.daily_energy(_frame(spark), keys=["device"], start="2019-12-31", end="2020-01-05")
    assert wide.groupBy("device").count().where("count = 6").count() == 2
    assert wide.agg(F.sum("kw")).first()[0] == 3.5


def test_months_are_filled(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 31), 60.0), (dt.datetime(2020, 4, 1), 60.0)], "ts timestamp_ntz, kw double")
    got = [(r["month"], r["kw"]) for r in resample.monthly_energy(df).orderBy("month").collect()]
    assert got == [(DAY(2020, 1, 31), 1.0), (DAY(2020, 2, 29), 0.0), (DAY(2020, 3, 31), 0.0), (DAY(2020, 4, 30), 1.0)]


def test_complete_calendar_keeps_null_keys(spark):
    s = spark.createDataFrame([(None, DAY(2020, 1, 2), 5.0)], "k string, ds date, y double")
    got = [(r["ds"], r["y"]) for r in resample.complete_calendar(s, "2020-01-01", "2020-01-03", keys=["k"]).orderBy("ds").collect()]
    assert got == [(DAY(2020, 1, 1), None), (DAY(2020, 1, 2), 5.0), (DAY(2020, 1, 3), None)]


def test_roll_up_reads_its_input_once(spark, tmp_path):
    _frame(spark).write.parquet(str(tmp_path / "r"))
    out = resample.hourly_energy(spark.read.parquet(str(tmp_path / "r")), keys=["device"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1


def test_outer_alignment_and_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "k string, u double")
    b = spark.createDataFrame([(None, 3.0), ("y", 4.0)], "k string, g double")
    got = {r["k"]: (r["u"], r["g"]) for r in resample.align_two(a, b, ["k"], "u", "g").collect()}
    assert got == {None: (1.0, 3.0), "x": (2.0, 0.0), "y": (0.0, 4.0)}
    assert null_safe_join(a, b, ["k"]).count() == 1


def test_positions_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (2, "c"), (None, "m")], "o long, v string")
    for parts in (1, 5):
        for ranges in (1, 4, 9):
            got = {r["v"]: r["pos"] for r in ingest.row_position(df.repartition(parts), "o", n_buckets=ranges).collect()}
            assert sorted(got.values()) == [0, 1, 2, 3, 4]
            assert got["a"] == 0 and {got["b"], got["c"]} == {1, 2}
            assert got == (first := locals().get("first") or got)
    assert {r["v"] for r in ingest.drop_last_row(df, "o").collect()} == {"n", "m", "a"}
    none = ingest.row_position(df.where("o is null"), "o").collect()
    assert sorted(r["pos"] for r in none) == [0, 1]


def test_site_summary_nets_rows_with_one_side(spark):
    df = spark.createDataFrame([(5.0, None), (None, 2.0)], "use_kw double, gen_kw double")
    assert tuple(kpi.site_summary(df).first()) == (5.0, 2.0, 3.0, 40.0)


def test_trend_line_covers_all_rows_of_each_series(spark):
    rows = [(k, i, float(i), (2.0 if k == "a" else -1.0) * i) for k in ("a", None) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double")
    got = stats.ols_trend_points(df, "y", "x", ["id"], keys=["k"])
    assert got.count() == 3000
    assert got.where(F.abs(F.col("yhat") - F.col("y")) > 1e-6).count() == 0


def test_season_density_is_a_density_of_all_rows(spark):
    df = spark.range(4000).select(F.lit("w").alias("season"), (F.pmod(F.col("id") * 7919, F.lit(1000)) / 10.0).alias("v"))
    got = density.season_density(df, "v", points=400).orderBy("x").collect()
    step = got[1]["x"] - got[0]["x"]
    assert abs(sum(r["density"] for r in got) * step - 1.0) < 0.06
    assert min(r["density"] for r in got) > 0


def test_unset_shared_folder_on_a_cluster_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_silver_reads_only_its_months(spark, tmp_path):
    from meterlake.sources.tables import read_silver, write_silver
    rows = [(dt.datetime(2020, m, 3), float(m)) for m in range(1, 7)]
    path = write_silver(spark.createDataFrame(rows, "ts timestamp_ntz, kw double"), str(tmp_path / "silver"))
    got = read_silver(spark, path, "2020-02", "2020-03")
    assert sorted(r["kw"] for r in got.collect()) == [2.0, 3.0]
    assert "PartitionFilters: [isnotnull(year_month" in got._jdf.queryExecution().executedPlan().toString()
