"""Hourly roll-up of a monthly table, kept up to date month by month (for E1-E3 and E6-E8).

The roll-up is a Parquet table with one folder a month beside a manifest, which names for each month the files it was made from (their number, bytes and
a hash of names, sizes and times). ``refresh_hourly`` compares the manifest with the folders as they are now, from the file listing alone, and reads
the rows of new and changed months only. Their folders are replaced by Spark's dynamic partition overwrite, which moves finished files into place when the
job commits; the manifest follows as a new version. A run that dies between the two repeats its months.

Only hours with readings are kept, so that a gap across the end of a month stays a gap; hours are filled on reading, over the whole series.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import resample
from meterlake.operators._util import keys_list, null_safe_join
from meterlake.sources.tables import read_silver

MONTH = "year_month"


def file_state(spark: SparkSession, path: str) -> DataFrame:
    """``year_month, files, bytes, state`` of a monthly table, from the listing of its files; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    listed = listed.select(F.regexp_extract("path", rf"{MONTH}=([^/]+)/", 1).alias(MONTH), "length", F.xxhash64(F.regexp_extract("path", "[^/]+$", 0), "length", "modificationTime").alias("h"))
    return listed.where(F.col(MONTH) != "").groupBy(MONTH).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("state"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the manifest, oldest first."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/manifest").select("path").collect()
    except Exception as e:  # noqa: BLE001 - Spark has no test for a path
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted({int(r["path"].rstrip("/").split("/")[-2].removeprefix("v")) for r in found})


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest manifest of a roll-up; None if there is none yet."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/manifest/v{versions[-1]}") if versions else None


def refresh_hourly(spark: SparkSession, silver: str, path: str, value_cols: list[str], keys=None, ts_col: str = "ts", out_names: list[str] | None = None) -> list[str]:
    """Bring the roll-up at ``path`` up to date with the monthly table ``silver``; the months that were rolled up again (one per changed month).

    Months that the table no longer has leave the manifest, and so every later reading."""
    now = file_state(spark, silver)
    before = manifest(spark, path)
    if before is not None:
        same = before.select(MONTH, F.col("state").alias("was"))
        changed = [r[0] for r in null_safe_join(now, same, [MONTH], "left").where(~F.col("state").eqNullSafe(F.col("was"))).select(MONTH).collect()]
        gone = null_safe_join(before, now, [MONTH], "left_anti").head(1)
        if not changed and not gone:
            return []
    else:
        changed = [r[0] for r in now.select(MONTH).collect()]
    if changed:
        rows = read_silver(spark, silver).withColumn(MONTH, F.col(MONTH).cast("string")).where(F.col(MONTH).isin(sorted(changed)))
        hours = resample.energy(rows, value_cols, "hour", keys=[*keys_list(keys), MONTH], ts_col=ts_col, gap_fill=None, out_names=out_names)
        hours.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(f"{path}/hours")
    # One row a month in one file, so a version is there whole or not at all.
    now.coalesce(1).write.parquet(f"{path}/manifest/v{max([time.time_ns(), *(v + 1 for v in _versions(spark, path))])}")
    return sorted(changed)


def read_hourly(spark: SparkSession, path: str, value_cols: list[str], keys=None, first: str | None = None, last: str | None = None, gap_fill: str | None = "zero") -> DataFrame:
    """(keys, hour, values) of the roll-up's months from ``first`` to ``last`` (``yyyy-MM``), with empty hours filled over each series' span. No raw row is read."""
    known = manifest(spark, path)
    hours = spark.read.option("basePath", f"{path}/hours").parquet(f"{path}/hours").withColumn(MONTH, F.col(MONTH).cast("string"))
    months = [r[0] for r in known.select(MONTH).collect() if (first is None or r[0] >= first) and (last is None or r[0] <= last)]
    return resample.resample(hours.where(F.col(MONTH).isin(months)), value_cols, "hour", keys=keys, ts_col="hour", gap_fill=gap_fill)
