"""The hourly roll-up kept by month: unchanged months are not read, changed ones are replaced, lost ones leave, gaps across months are filled."""

from __future__ import annotations

import datetime as dt
import shutil

from pyspark.sql import functions as F

from meterlake.operators import resample, rollup
from meterlake.sources.tables import read_silver, write_silver


def _readings(spark, months, add=0.0):
    rows = [(k, dt.datetime(2020, m, d, h, 15), 60.0 * m + d + add) for k in ("a", None) for m in months for d in (1, 9) for h in (3, 4, 7)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, kw double")


def _month(spark, path, month):
    return {tuple(r) for r in spark.read.parquet(f"{path}/hours/year_month={month}").select(F.input_file_name(), "hour").collect()}


def test_only_changed_months_are_read(spark, tmp_path):
    silver, path = str(tmp_path / "silver"), str(tmp_path / "rollup")
    write_silver(_readings(spark, [1, 2, 4]), silver)
    assert rollup.refresh_hourly(spark, silver, path, ["kw"], keys=["k"]) == ["2020-01", "2020-02", "2020-04"]
    first = {m: _month(spark, path, m) for m in ("2020-01", "2020-02", "2020-04")}
    assert rollup.refresh_hourly(spark, silver, path, ["kw"], keys=["k"]) == []
    assert {m: _month(spark, path, m) for m in first} == first

    # One month gets more rows, one is new.
    more = _readings(spark, [2, 5], add=1.0).withColumn("year_month", F.date_format("ts", "yyyy-MM"))
    more.coalesce(1).write.mode("append").partitionBy("year_month").parquet(silver)
    assert rollup.refresh_hourly(spark, silver, path, ["kw"], keys=["k"]) == ["2020-02", "2020-05"]
    assert _month(spark, path, "2020-01") == first["2020-01"] and _month(spark, path, "2020-02") != first["2020-02"]
    want = resample.hourly_energy(read_silver(spark, silver), "kw", keys=["k"])
    got = rollup.read_hourly(spark, path, ["kw"], keys=["k"])
    key = lambda r: (r["k"], r["hour"])
    assert {key(r): round(r["kw"], 9) for r in got.collect()} == {key(r): round(r["kw"], 9) for r in want.collect()}
    assert str(silver) not in got._jdf.queryExecution().executedPlan().toString()

    # A month that goes leaves the readings, although its hours still lie there.
    shutil.rmtree(f"{silver}/year_month=2020-05")
    assert rollup.refresh_hourly(spark, silver, path, ["kw"], keys=["k"]) == []
    left = rollup.read_hourly(spark, path, ["kw"], keys=["k"])
    assert left.agg(F.max("hour")).first()[0] < dt.datetime(2020, 5, 1)
    one = rollup.read_hourly(spark, path, ["kw"], keys=["k"], first="2020-02", last="2020-02").collect()
    assert {r["hour"].month for r in one} == {2}


def test_refresh_reads_no_row_of_an_unchanged_table(spark, tmp_path):
    """The comparison lists files: with a file that is no Parquet at all the second refresh still succeeds."""
    silver, path = str(tmp_path / "silver"), str(tmp_path / "rollup")
    write_silver(_readings(spark, [1]), silver)
    rollup.refresh_hourly(spark, silver, path, ["kw"])
    import os
    for root, _dirs, files in os.walk(silver):
        for f in files:
            if f.endswith(".parquet"):
                at = os.path.join(root, f)
                state = os.stat(at)
                with open(at, "r+b") as fh:
                    fh.write(b"\0" * 16)
                os.utime(at, ns=(state.st_atime_ns, state.st_mtime_ns))
    assert rollup.refresh_hourly(spark, silver, path, ["kw"]) == []
    assert rollup.read_hourly(spark, path, ["kw"]).count() > 0
