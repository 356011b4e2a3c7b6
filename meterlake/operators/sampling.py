"""Repeatable sampling.

A row's place in the sample depends only on a hash of its key and the seed,
so the sample is the same under any partitioning and on re-execution after a
lost executor. ``orderBy(hash).limit(n)`` plans as TakeOrderedAndProject:
every task keeps n rows, one final task merges n x tasks rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators._util import col


def sample_hash(key_cols: list[str], seed: int = 42, method: str = "md5") -> Column:
    if method == "md5":
        txt = F.concat_ws(":", F.lit(str(seed)), *[col(c).cast("string") for c in key_cols])
        return F.md5(txt)
    if method == "xxhash64":
        return F.xxhash64(F.lit(seed), *[col(c) for c in key_cols])
    raise ValueError(method)


def sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = 42, method: str = "md5") -> DataFrame:
    """Exactly min(n, rows) rows without replacement."""
    h = sample_hash(key_cols, seed, method)
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(n).drop("_h")


def sample_n_per_group(df: DataFrame, n: int, group_cols: list[str], key_cols: list[str],
                       seed: int = 42, method: str = "md5", salts: int = 64) -> DataFrame:
    """min(n, rows) rows per group, repeatable.

    A group holding at most n rows is kept whole without ranking (a count
    per group decides). A larger group is split first: rows go to ``salts``
    sub-groups by their hash, each keeps its n smallest hashes (a sort of
    1/salts of the group), then the group keeps the n smallest of at most
    salts * n survivors."""
    from pyspark.sql import Window
    counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_gn"))
    d = df.join(counts, group_cols, "inner")
    small = d.where(F.col("_gn") <= n).drop("_gn")
    big = d.where(F.col("_gn") > n).drop("_gn")
    h = sample_hash(key_cols, seed, method)
    b = big.withColumn("_h", h).withColumn("_salt", F.abs(F.xxhash64("_h")) % salts)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy("_h", *key_cols)
    b = b.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
    w2 = Window.partitionBy(*group_cols).orderBy("_h", *key_cols)
    b = b.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= n).drop("_h", "_salt", "_r")
    return small.unionByName(b)
