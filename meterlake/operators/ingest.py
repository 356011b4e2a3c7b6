"""Row order, positions and schema guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.operators._util import col, keys_list
from meterlake.operators.scan import ordered_scan


def drop_last_row(df: DataFrame, order_col: str) -> DataFrame:
    """A2: remove the row with the largest order key.

    Rows without a key stand first and stay; rows that share the largest key
    are all the last. ``max(order)`` is a scalar subquery (partial+final
    aggregate, one value), so the filter is a plain predicate on every partition."""
    last = df.select(F.max(col(order_col))).scalar()
    return df.where(col(order_col).isNull() | (col(order_col) < last))


def row_position(df: DataFrame, order_col: str, out_col: str = "pos", n_buckets: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_col`` (integer) order, by an ordered scan over ``n_buckets`` ranges (default: the
    session's shuffle partitions); no window over the table.

    Rows with a key come first; rows without one follow. Rows of one key, and rows without one, stand in the order of a hash of all
    their columns, so equal rows alone are interchangeable. The answer does not depend on how the input is partitioned."""
    return ordered_scan(df, [col(order_col).cast("long").asc_nulls_last()], position=out_col, ranges=n_buckets)


def assign_regular_time(df: DataFrame, order_col: str, start: str = "2016-01-01 05:00:00",
                        step_seconds: int = 60, out_col: str = "ts") -> DataFrame:
    """A3: ``ts = start + position * step``; the row's own time is replaced."""
    p = row_position(df, order_col, "_pos")
    return p.withColumn(out_col, regular_time(F.col("_pos"), start, step_seconds)).drop("_pos")


def regular_time(position: Column, start: str = "2016-01-01 05:00:00", step_seconds: int = 60) -> Column:
    """The time of a 0-based position on the regular axis."""
    return F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(secs=(position * step_seconds).cast("decimal(18,6)"))


def select_numeric(df: DataFrame) -> DataFrame:
    """A4: keep numeric columns only."""
    return df.select([col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


def guarded(df: DataFrame, needed: list[str], out_schema: T.StructType, numeric: bool = True):
    """A5: return an empty frame of ``out_schema`` when a needed column is
    missing (or not numeric), else None so the caller proceeds."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for n in needed:
        if n not in fields or (numeric and not isinstance(fields[n], T.NumericType)):
            return df.sparkSession.createDataFrame([], out_schema)
    return None


def date_bounds(df: DataFrame, ts_col: str = "ts", keys=None) -> DataFrame:
    """First and last calendar date (per key)."""
    k = keys_list(keys)
    d = F.to_date(col(ts_col))
    aggs = [F.min(d).alias("min_date"), F.max(d).alias("max_date")]
    return df.groupBy(*k).agg(*aggs) if k else df.agg(*aggs)


def distinct_periods(df: DataFrame, ts_col: str = "ts", period: str = "date") -> DataFrame:
    """Distinct dates (newest first), years (newest first) or months
    (oldest first)."""
    ts = col(ts_col)
    if period == "date":
        return df.select(F.to_date(ts).alias("period")).distinct().orderBy(F.desc("period"))
    if period == "year":
        return df.select(F.year(ts).alias("period")).distinct().orderBy(F.desc("period"))
    if period == "month":
        return df.select(F.date_format(ts, "yyyy-MM").alias("period")).distinct().orderBy("period")
    raise ValueError(period)


def load_pipeline(raw: DataFrame, order_col: str = "row_order", use_col: str = "use_kw", gen_col: str = "gen_kw",
                  junk_cols: tuple[str, ...] = ("cloudCover",)) -> DataFrame:
    """The source's load: drop the final row, replace the times by a regular
    axis, add calendar features, clean the junk columns, and add net energy
    and the generation ratio of every row."""
    from meterlake.functions.calendar import calendar_features
    from meterlake.functions.energy import energy_ratio, net_energy
    from meterlake.operators.clean import filled_number, valid_reading
    o = col(order_col)
    # One scan from the last row to the first gives positions and next valid values together. A valid value of the last row
    # itself, which goes, is told by its key; then only rows without a key, which stand behind it, can give a value.
    seen = {}
    for c in junk_cols:
        seen[f"_with_{c}"] = F.when(o.isNotNull() & valid_reading(c).isNotNull(), F.struct(valid_reading(c).alias("r"), o.alias("o")))
        seen[f"_without_{c}"] = F.when(o.isNull(), valid_reading(c))
    d = ordered_scan(raw, [o.desc_nulls_first()], position="_back", last_valid=seen)
    last = d.agg(F.max(F.struct(o.alias("o"), "_back")).alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(o.isNull()).alias("none"))
    last = last.select(F.col("last.o").alias("_last"), "n", "none", F.when(F.col("last.o").isNull(), 0).otherwise(F.col("last._back") + 1 - F.col("none")).alias("_gone"))
    d = d.join(F.broadcast(last)).where(o.isNull() | (o < F.col("_last")))
    back = F.col("_back") - F.when(o.isNull(), 0).otherwise(F.col("_gone"))
    d = d.withColumn("ts", regular_time(F.col("n") - F.col("_gone") - 1 - back))
    for c in junk_cols:
        value, none = F.col(f"_with_{c}"), F.col(f"_without_{c}")
        d = d.withColumn(c, filled_number(F.when(value["o"] < F.col("_last"), value["r"]).otherwise(none)))
    d = calendar_features(d.drop("_back", "_last", "n", "none", "_gone", *seen))
    return d.withColumns({"net_kw": net_energy(use_col, gen_col), "ratio": energy_ratio(use_col, gen_col)})
