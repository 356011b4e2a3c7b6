"""Driver tables adapted, by projection only, to the meter roles the operators use.

These adapters rename and retype columns; they do none of an operator's work.
(See FIXTURES.md for the role table.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.tables import nan_to_null, read_table

# The five event types become five meters; signup plays generation.
EVENT_DEVICES = ("click", "error", "purchase", "signup", "view")
GEN_DEVICE = "signup"

# Fixture choice: order priority stands in for the weather text. Four map to
# known weather groups, one ("Fog") to none, so it lands in "Other".
PRIORITY_TO_SUMMARY = {
    "1-URGENT": "Clear",
    "2-HIGH": "Partly Cloudy",
    "3-MEDIUM": "Overcast",
    "4-NOT SPECIFIED": "Light Rain",
    "5-LOW": "Fog",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nan_to_null(read_table(spark, sf_dir, "events"))


def meter_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meter_id, event_id, ts, device, kw): one reading per row."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("meter_id"),
        "event_id",
        "ts",
        F.col("event_type").alias("device"),
        F.col("value").alias("kw"),
    )


def meter_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide layout: ``use_kw`` (every type but signup), ``gen_kw`` (signup) and
    one column per event type. Timestamps are unique, so the pivot is a
    projection (no shuffle)."""
    ev = events(spark, sf_dir)
    is_gen = F.col("event_type") == F.lit(GEN_DEVICE)
    cols = {d: F.when(F.col("event_type") == d, F.col("value")) for d in EVENT_DEVICES}
    return ev.select(
        "event_id",
        "ts",
        F.when(~is_gen, F.col("value")).alias("use_kw"),
        F.when(is_gen, F.col("value")).alias("gen_kw"),
        *[c.alias(d) for d, c in cols.items()],
    )


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their order key ``event_id`` (ts is monotone in it)."""
    return events(spark, sf_dir).select(
        "event_id", "ts", F.col("event_type").alias("device"), F.col("value").alias("kw"))


def junk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column holding the junk literal ``cloudCover`` on some rows."""
    ev = events(spark, sf_dir)
    return ev.select(
        "event_id",
        "ts",
        F.when(F.col("event_id") % 7 == 0, F.lit("cloudCover"))
        .otherwise(F.col("value").cast("string"))
        .alias("cloudCover"),
    )


def _lineitem_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    # Equi-join on the part key; the planner/AQE choose broadcast or shuffle
    # from the measured size of `part`, which grows with the data.
    return li.join(part, li.l_partkey == part.p_partkey, "inner")


def devices25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row key, ts, device = brand, kw = quantity)."""
    return _lineitem_part(spark, sf_dir).select(
        "l_orderkey", "l_linenumber",
        F.col("l_shipdate").alias("ts"),
        F.col("p_brand").alias("device"),
        F.col("l_quantity").alias("kw"),
    )


def series6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series = part type, ts, kw = quantity): raw readings; the forecasting
    job does its own daily roll-up."""
    return _lineitem_part(spark, sf_dir).select(
        F.col("p_type").alias("series"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("kw"),
    )


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute-style rows with site use and weather covariates."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    mapping = F.create_map(*[F.lit(x) for kv in PRIORITY_TO_SUMMARY.items() for x in kv])
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    # Row key: (l_orderkey, l_linenumber) alone repeats in the driver data.
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("use_kw"),
        (F.col("l_quantity") * 2).alias("temperature"),
        F.col("l_discount").alias("humidity"),
        F.col("l_tax").alias("windSpeed"),
        mapping[F.col("o_orderpriority")].alias("summary"),
    )
