"""Scans and sinks (survey A1, A6, A7).

Parquet is the storage format of choice: column pruning and filter pushdown
reach the scan. The CSV scan takes an explicit schema so nothing is inferred
(inference is a full extra pass over the input at scale).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.session import ensure_checkpoint_dir

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# The wide meter layout of the source data.
DEVICE_COLUMNS = (
    "Dishwasher [kW]", "Furnace 1 [kW]", "Furnace 2 [kW]", "Home office [kW]",
    "Fridge [kW]", "Wine cellar [kW]", "Garage door [kW]", "Kitchen 12 [kW]",
    "Kitchen 14 [kW]", "Kitchen 38 [kW]", "Barn [kW]", "Well [kW]",
    "Microwave [kW]", "Living room [kW]", "Solar [kW]",
)
SOLAR_COLUMN = "Solar [kW]"
NON_SOLAR_DEVICE_COLUMNS = tuple(c for c in DEVICE_COLUMNS if c != SOLAR_COLUMN)
WEATHER_COLUMNS = (
    "temperature", "humidity", "windSpeed", "windBearing", "pressure",
    "apparentTemperature", "dewPoint", "precipProbability",
)
#: Splits of CSV files whose ranks are broadcast, at most; more are joined by shuffle.
BROADCAST_SPLITS = 100_000
SITE_COLUMNS = ("use [kW]", "gen [kW]")


def meter_csv_schema(extra_text: tuple[str, ...] = ("icon", "summary", "cloudCover")) -> T.StructType:
    """Schema of the wide minute-level CSV: time, site power, devices, weather."""
    fields = [T.StructField("time", T.StringType())]
    fields += [T.StructField(c, T.DoubleType()) for c in SITE_COLUMNS + DEVICE_COLUMNS]
    fields += [T.StructField(c, T.DoubleType()) for c in WEATHER_COLUMNS]
    fields += [T.StructField(c, T.StringType()) for c in extra_text]
    return T.StructType(fields)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_meter_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   order_col: str = "row_order") -> DataFrame:
    """A1: header CSV with an explicit schema, NaN turned into NULL, and a
    long order key that follows the files' row order.

    Rows of a CSV carry no order of their own in a DataFrame. The key is
    ``split_rank << 33 | row index``: splits (file path, byte offset) are
    ranked in file order (a table with one row per split, so bounded by the
    number of splits), and the row index is the position the scan gives the
    row inside its task. It is deterministic for a given input, and A2/A3 use
    it as the row position.
    """
    from pyspark.sql import Window
    schema = schema or meter_csv_schema()
    ensure_checkpoint_dir(spark)
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    df = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
                         "_mono": F.monotonically_increasing_id()})
    splits = df.select("_file", "_block").distinct()
    splits = splits.withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_block")) - 1)
    # One pass over the files finds the splits; every later use reads the written ranks.
    splits = splits.checkpoint(eager=True)
    mask = (1 << 33) - 1
    keyed = df.join(F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits, ["_file", "_block"])
    keyed = keyed.withColumn(order_col, F.shiftleft(F.col("_rank").cast("long"), 33) +
                             F.col("_mono").bitwiseAND(F.lit(mask)))
    return nan_to_null(keyed.drop("_file", "_block", "_mono", "_rank"))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan with NaN turned into NULL on the floating columns."""
    return nan_to_null(spark.read.parquet(path))


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """pandas skips NaN in sum/mean/max; Spark does not. Turn NaN into NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols or list(floats)) if c in floats]
    if not targets:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in targets})


# Microsecond timestamps survive the CSV round trip (the default keeps ms).
CSV_TIME_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Sink used by A6/A7: header CSV, one folder of part files."""
    df.write.mode(mode).option("header", True).options(**CSV_TIME_OPTIONS).csv(path)
    return path


def write_silver(df: DataFrame, path: str, ts_col: str = "ts", mode: str = "overwrite") -> str:
    """The cleaned table as Parquet in one folder per month (``year_month``); rows are dealt by month and day first, so
    that a month is a few files rather than one per task."""
    d = df.withColumn("year_month", F.date_format(ts_col, "yyyy-MM"))
    d.repartition("year_month", F.to_date(ts_col)).write.mode(mode).partitionBy("year_month").parquet(path)
    return path


def read_silver(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of the months ``first`` to ``last`` (``yyyy-MM``); other months' folders are not read."""
    d = spark.read.option("basePath", path).parquet(path)
    month = F.col("year_month").cast("string")
    if first is not None:
        d = d.where(month >= first)
    if last is not None:
        d = d.where(month <= last)
    return d


def read_csv_back(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).options(**CSV_TIME_OPTIONS).csv(path)


def wide_to_long(df: DataFrame, value_cols: list[str] | tuple[str, ...] = DEVICE_COLUMNS,
                 id_cols: list[str] | None = None, name_col: str = "device", value_col: str = "kw",
                 strip_unit: bool = True) -> DataFrame:
    """The wide layout (one column per device) as long rows
    ``(ids..., device, kw)`` through ``unpivot``; labels lose the " [kW]"
    unit (B12)."""
    present = [c for c in value_cols if c in df.columns]
    ids = id_cols if id_cols is not None else [c for c in df.columns if c not in present]
    long = df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in present], name_col, value_col)
    if strip_unit:
        long = long.withColumn(name_col, F.replace(F.col(name_col), F.lit(" [kW]"), F.lit("")))
    return long
