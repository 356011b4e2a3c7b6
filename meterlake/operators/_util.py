from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str | Column) -> Column:
    """Column by (possibly unusual) name, e.g. ``use [kW]``."""
    return F.col(f"`{name}`") if isinstance(name, str) else name


def keys_list(keys: Sequence[str] | str | None) -> list[str]:
    if keys is None:
        return []
    if isinstance(keys, str):
        return [keys]
    return list(keys)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names where NULL equals NULL; the left side's key columns stay (for ``full`` either side's)."""
    on = list(on)
    names = {c: f"_r_{i}" for i, c in enumerate(on)}
    r = right.withColumnsRenamed(names)
    cond = None
    for c, n in names.items():
        e = left[f"`{c}`"].eqNullSafe(r[n])
        cond = e if cond is None else cond & e
    j = left.join(r, cond, how)
    if how == "full":
        j = j.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col(n)) for c, n in names.items()})
    return j.drop(*names.values())


def join_scalar_keys(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-key statistics to rows.

    With keys, an equi-join on the keys (size is #keys; the planner decides
    broadcast vs shuffle). Without keys ``stats`` is one aggregated row: it is
    broadcast (a proven one-row bound) and joined on a constant, so the
    aggregate runs once whatever the number of statistics.
    """
    if keys:
        return null_safe_join(df, stats, keys, "left")
    one = F.broadcast(stats.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one", "left").drop("_one")
