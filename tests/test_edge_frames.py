"""Literal edge frames of the source's pandas rules (FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlake.functions.binning import equal_width_bin
from meterlake.functions.calendar import week_monday
from meterlake.operators import clean, forecast, kpi, resample, stats
from meterlake.operators.anomaly import monthly_anomalies


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_zero_fill_sum_and_null_mean(spark):
    df = spark.createDataFrame(
        [(ts("2024-01-01 10:00"), 60.0), (ts("2024-01-03 10:00"), 120.0), (ts("2024-01-03 11:00"), None)],
        "ts timestamp_ntz, kw double")
    s = {r["day"]: r["kwh"] for r in resample.daily_energy(df, "kw", out_names=["kwh"]).collect()}
    assert s == {dt.date(2024, 1, 1): 1.0, dt.date(2024, 1, 2): 0.0, dt.date(2024, 1, 3): 2.0}
    m = {r["day"]: r["kw"] for r in resample.daily_mean(df, ["kw"]).collect()}
    assert m[dt.date(2024, 1, 2)] is None and m[dt.date(2024, 1, 3)] == 120.0


def test_all_null_bucket_sums_to_zero(spark):
    df = spark.createDataFrame([(ts("2024-01-01 10:00"), None), (ts("2024-01-01 11:00"), 6.0)],
                               "ts timestamp_ntz, kw double")
    h = {r["hour"].hour: r["kwh"] for r in resample.hourly_energy(df, "kw", out_names=["kwh"]).collect()}
    assert h == {10: 0.0, 11: 0.1}


def test_interpolation_both_ends(spark):
    vals = [None, 1.0, None, None, 4.0, None]
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "series string, ds date, y double")
    out = [r["y"] for r in forecast.fill_series(df, ["series"]).orderBy("ds").collect()]
    assert out == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_all_null_series_fills_zero(spark):
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), None) for i in range(3)]
    df = spark.createDataFrame(rows, "series string, ds date, y double")
    assert [r["y"] for r in forecast.fill_series(df, ["series"]).collect()] == [0.0, 0.0, 0.0]


def test_first_argmax_null_ignored(spark):
    rows = [(ts(f"2024-01-01 0{i}:00"), v) for i, v in enumerate([1.0, 3.0, 3.0, None])]
    df = spark.createDataFrame(rows, "hour timestamp_ntz, kwh double")
    r = kpi.kpi_total_peak_mean(df, "kwh", "hour").first()
    assert r["peak"] == 3.0 and r["peak_at"] == ts("2024-01-01 01:00")
    p = kpi.peak_and_min_points(df, "kwh", "hour").first()
    assert p["min_at"] == ts("2024-01-01 00:00") and p["min"] == 1.0


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125, 0.25)], "a double, b double")
    r = df.select(F.bround("a", 2).alias("a"), F.bround("b", 1).alias("b")).first()
    assert (r["a"], r["b"]) == (0.12, 0.2)
    t = spark.createDataFrame([("x", 1.0), ("y", 7.0)], "device string, total double")
    shares = {r["device"]: r["share_pct"] for r in kpi.share_of_total(t).collect()}
    assert shares == {"x": 12.5, "y": 87.5}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_backfill_junk(spark, parts):
    vals = ["cloudCover", "cloudCover", "0.5", "cloudCover", "0.7", "cloudCover"]
    rows = [(i, ts("2024-01-01 00:00") + dt.timedelta(minutes=37 * i), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "i long, ts timestamp_ntz, cloudCover string").repartition(parts)
    out = clean.clean_backfill(df, "cloudCover", ["ts", "i"]).orderBy("i").collect()
    assert [r["cloudCover"] for r in out] == [0.5, 0.5, 0.5, 0.7, 0.7, None]


def test_backfill_across_days_with_keys(spark):
    rows = []
    for k in ("a", "b"):
        rows += [(k, ts("2024-01-01 23:00"), "cloudCover"), (k, ts("2024-01-02 05:00"), "cloudCover"),
                 (k, ts("2024-01-03 01:00"), "0.3" if k == "a" else "0.9")]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, cloudCover string")
    out = {(r["k"], r["ts"].day): r["cloudCover"] for r in clean.clean_backfill(df, "cloudCover", ["ts"], keys=["k"]).collect()}
    assert out[("a", 1)] == 0.3 and out[("a", 2)] == 0.3 and out[("b", 1)] == 0.9


def test_unobserved_group_returned_with_null(spark):
    df = spark.createDataFrame([(1.0, "Clear"), (5.0, "Clear"), (9.0, "Rain")], "use_kw double, summary string")
    out = {r["weather_group"]: r["high_usage_pct"] for r in stats.high_usage_probability(df).collect()}
    assert len(out) == 11 and out["Breezy"] is None and out["Clear"] is not None


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    lo, hi = df.select(F.min("x")).scalar(), df.select(F.max("x")).scalar()
    bins = [r["b"] for r in df.select(equal_width_bin(F.col("x"), lo, hi, 10).alias("b")).orderBy("x").collect()]
    assert bins == [0, 4, 9]


def test_week_rules(spark):
    df = spark.createDataFrame([(2016, 53), (2019, 1), (2020, 1)], "y int, w int")
    ref = [r["m"] for r in df.select(week_monday("y", "w").alias("m")).collect()]
    assert ref == [dt.date(2017, 1, 2), dt.date(2019, 1, 7), dt.date(2020, 1, 6)]
    iso = [r["m"] for r in df.select(week_monday("y", "w", "iso").alias("m")).collect()]
    # 2016 has 52 ISO weeks, so ISO week 53 is the first week of 2017.
    assert iso == [dt.date(2017, 1, 2), dt.date(2018, 12, 31), dt.date(2019, 12, 30)]


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (1.0, 5.0, 2.5)], "a double, b double, c double")
    m = {(r["a"], r["b"]): r["r"] for r in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert m[("a", "b")] is None and m[("a", "a")] is None and m[("b", "b")] == 1.0
    assert m[("b", "c")] == m[("c", "b")] and -1 <= m[("b", "c")] <= 1


def test_anomaly_row_gate(spark):
    import random
    rnd = random.Random(1)
    rows = [(i, ts("2024-01-01") + dt.timedelta(hours=i % 700), rnd.random(), rnd.random(), rnd.random())
            for i in range(100)]
    rows += [(1000 + i, ts("2024-02-01") + dt.timedelta(hours=i % 600), rnd.random(), rnd.random(), rnd.random())
             for i in range(101)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, u double, t double, h double")
    out = monthly_anomalies(df, ["id"], ["u", "t", "h"], n_trees=20).collect()
    jan = [r for r in out if r["year_month"] == "2024-01"]
    feb = [r for r in out if r["year_month"] == "2024-02"]
    assert len(jan) == 100 and all(r["anomaly"] == 1 and r["anomaly_score"] is None for r in jan)
    assert len(feb) == 101 and all(r["anomaly_score"] is not None for r in feb)
    assert 1 <= sum(r["anomaly"] == -1 for r in feb) <= 5


def test_wide_layout_helpers(spark):
    from meterlake.operators.calendar_grid import week_weekday_grid, week_weekday_pivot_wide
    from meterlake.sources.tables import wide_to_long
    w = spark.createDataFrame([(ts("2024-01-01 00:00"), 1.0, 2.0), (ts("2024-01-01 00:01"), 3.0, None)],
                              "ts timestamp_ntz, `Fridge [kW]` double, `Barn [kW]` double")
    long = wide_to_long(w, ["Fridge [kW]", "Barn [kW]"])
    assert sorted((r["device"], r["kw"]) for r in long.where("kw is not null").collect()) == \
        [("Barn", 2.0), ("Fridge", 1.0), ("Fridge", 3.0)]
    tot = kpi.device_totals_wide(w, ["Fridge [kW]", "Barn [kW]"]).collect()
    assert [(r["device"], r["total"]) for r in tot] == [("Fridge [kW]", 4.0), ("Barn [kW]", 2.0)]
    daily = spark.createDataFrame([(dt.date(2024, 1, 1), 5.0)], "day date, kwh double")
    wide = week_weekday_pivot_wide(week_weekday_grid(daily)).collect()
    assert len(wide) == 7 and wide[0]["1"] == 5.0 and len(wide[0]) == 55
