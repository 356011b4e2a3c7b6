"""Exact quantiles (linear interpolation, like ``quantile_cont``) from a mergeable sketch and one exact pass.

The sketch counts the rows of fine value cells (``value_cells``), so it is one map-side combined aggregate, and running counts over a key's cells
give the cell that holds a wanted rank. A second pass counts the different values inside these cells only, and the ranks are
read off. No row is shuffled as it is, whatever the size of a key. A cell with more than ``max_exact`` rows
(a dense cluster of values) is cut again into ``bins`` equal parts of its own range, until its part is small or holds a single value; one scalar
(the largest count left) is read per level to decide that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators._util import col, keys_list, null_safe_join

#: Rows of the request table that are broadcast, at most.
BROADCAST_ROWS = 100_000


def value_cells(df: DataFrame, value_col: str, keys: list[str], bits: int = 10) -> DataFrame:
    """Fine counts of the values of each key: ``*keys, cell, c, lo, hi`` (count, least and largest value of the cell).

    A cell is an octave cut into ``2 ** bits`` parts, so its number grows with the value and needs no range beforehand. Counts of any parts of
    the table merge exactly, and a key has at most ``2 ** bits`` cells an octave of its values."""
    v = col(value_col).cast("double")
    size = F.abs(v)
    octave = F.floor(F.least(F.log2(size), F.lit(1024.0))).cast("long")
    part = F.when(size < float("inf"), F.floor((size / F.pow(F.lit(2.0), octave) - 1) * (1 << bits)).cast("long")).otherwise(0)
    cell = (octave + 2_000) * (1 << bits) + part  # above 0 for every double
    cell = F.when(v > 0, cell).when(v < 0, -cell).otherwise(F.lit(0).cast("long"))
    return (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*[col(k) for k in keys], cell.alias("cell"))
            .agg(F.count(F.lit(1)).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi")))


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], keys=None,
                    bins: int = 1024, max_exact: int = 200_000, max_levels: int = 8,
                    materialize: bool = True) -> DataFrame:
    """One row per key: ``q0, q1, ...`` for ``probs`` and the count ``n``.

    ``materialize=False`` when ``df`` is already a written narrow table."""
    from meterlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    user_keys = keys_list(keys)
    k = user_keys or ["_g"]
    src = df if user_keys else df.withColumn("_g", F.lit(0))
    # The narrow (keys, value) projection is read twice: checkpoint it so that the upstream plan (joins, Python stages) runs once.
    d = src.select(*k, col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if materialize:
        d = d.checkpoint(eager=True)
    cells = value_cells(d, "_v", k).checkpoint(eager=True)
    stats = cells.groupBy(*k).agg(F.sum("c").alias("_n"))
    targets = stats.select(*k, "_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])).alias("_t"))
    targets = targets.select(*k, "_n", "_t.qi", ((F.col("_n") - 1) * F.col("_t.p")).alias("_h"))
    # Every wanted rank (floor and ceil of h) is one request.
    req = targets.select(*k, F.explode(F.array_distinct(F.array(F.floor("_h").cast("long"), F.ceil("_h").cast("long")))).alias("_r")).distinct()
    running = Window.partitionBy(*k).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumn("_below", F.sum("c").over(running) - F.col("c"))
    req = (_joined(req, placed, k).where((F.col("_r") >= F.col("_below")) & (F.col("_r") < F.col("_below") + F.col("c")))
           .select(*k, "_r", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_below", F.col("c").alias("_c")).checkpoint(eager=True))
    for _ in range(max_levels):
        worst = req.where(F.col("_lo") < F.col("_hi")).select(F.max("_c")).first()[0]
        if worst is None or worst <= max_exact:
            break
        ranges = req.select(*k, "_lo", "_hi", "_below").distinct()
        cand = _joined(d, ranges, k).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        width = F.col("_hi") - F.col("_lo")
        b = F.when(width == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col("_v") - F.col("_lo")) / width * bins), F.lit(bins - 1))).cast("int")
        hist = (cand.groupBy(*k, "_lo", "_hi", "_below", b.alias("_b"))
                .agg(F.count(F.lit(1)).alias("_n1"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax")))
        w = Window.partitionBy(*k, "_lo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_n1").over(w), F.lit(0)))
        # The request table is tiny (keys x ranks); checkpointing it cuts the lineage so later levels do not recompute earlier ones.
        req = (_joined(req, hist, [*k, "_lo", "_hi", "_below"])
               .where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_n1")))
               .select(*k, "_r", F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"),
                       F.col("_before").alias("_below"), F.col("_n1").alias("_c"))).checkpoint(eager=True)
    # A range holding one value needs no second pass (it may be a huge tie).
    single = req.where(F.col("_lo") == F.col("_hi")).select(*k, "_r", F.col("_lo").alias("_x"))
    multi = req.where(F.col("_lo") < F.col("_hi"))
    ranges = multi.select(*k, "_lo", "_hi", "_below").distinct()
    # keys x ranks rows at most, and the other side has all rows.
    cand = _joined(d, F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges, k)
    values = cand.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).groupBy(*k, "_lo", "_hi", "_below", "_v").agg(F.count(F.lit(1)).alias("_n1"))
    upto = Window.partitionBy(*k, "_lo", "_hi").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_end", F.col("_below") + F.sum("_n1").over(upto))
    picked = (_joined(multi, ranked.drop("_below"), [*k, "_lo", "_hi"]).where((F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_n1")))
              .select(*k, "_r", F.col("_v").alias("_x")).unionByName(single))
    lo_v = picked.select(*k, F.col("_r").alias("_rl"), F.col("_x").alias("_vl"))
    hi_v = picked.select(*k, F.col("_r").alias("_rh"), F.col("_x").alias("_vh"))
    t = targets.withColumn("_rl", F.floor("_h").cast("long")).withColumn("_rh", F.ceil("_h").cast("long"))
    t = _joined(_joined(t, lo_v, [*k, "_rl"], "left"), hi_v, [*k, "_rh"], "left")
    t = t.withColumn("_q", F.col("_vl") + (F.col("_h") - F.col("_rl")) * (F.col("_vh") - F.col("_vl")))
    out = t.groupBy(*k, "_n").pivot("qi", list(range(len(probs)))).agg(F.first("_q"))
    return out.select(*user_keys, F.col("_n").alias("n"), *[F.col(str(i)).alias(f"q{i}") for i in range(len(probs))])


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, where NULL keys are a key like any other."""
    return null_safe_join(left, right, on, how)
