"""Statistics: correlation, regression, scaling, distribution summaries
(H1-H4, H8, E11-E13, E15, E16, F4).

Correlation is computed as covar_pop / (stddev_pop * stddev_pop) over
pairwise-complete rows with a NULL-guarded denominator: Spark's ``corr``
raises DIVIDE_BY_ZERO on a constant column under ANSI mode, while the
reference (and DuckDB) give NaN/NULL. All pairs of a matrix come out of ONE
aggregate pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions.binning import bin_edges, bin_label, equal_width_bin
from meterlake.functions.weather import WEATHER_GROUP_ORDER, weather_group, weather_group_ord
from meterlake.operators._util import col, join_scalar_keys, keys_list, null_safe_join
from meterlake.operators.quantiles import exact_quantiles
from meterlake.session import shared_dir

#: Columns whose pairs are one aggregate, at most.
FEW_COLUMNS = 8
#: Names of one block of a correlation matrix.
TILE = 512


def safe_corr(a: Column, b: Column) -> Column:
    a2 = F.when(b.isNotNull(), a)
    b2 = F.when(a.isNotNull(), b)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a2) * F.stddev_pop(b2), F.lit(0.0))


def _pair_stats(keys: list[str], n: int):
    """Per batch and key: pairwise-complete sums for every column pair, as
    n x n matrix products (the rows of a batch are never paired)."""
    import numpy as np
    import pandas as pd

    xs = [f"_x{i}" for i in range(n)]
    ii, jj = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    ii, jj = ii.ravel(), jj.ravel()

    def part(it):
        for pdf in it:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, g in groups:
                X = g[xs].to_numpy(dtype=float, na_value=np.nan)
                M = ~np.isnan(X)
                X0 = np.where(M, X, 0.0)
                Mf = M.astype(float)
                N = Mf.T @ Mf
                SX = X0.T @ Mf
                SXX = (X0 * X0).T @ Mf
                SXY = X0.T @ X0
                out = pd.DataFrame({
                    "i": ii.astype("int32"), "j": jj.astype("int32"),
                    "n": N.ravel().astype("int64"), "sx": SX.ravel(), "sy": SX.T.ravel(),
                    "sxx": SXX.ravel(), "syy": SXX.T.ravel(), "sxy": SXY.ravel()})
                kv = key if isinstance(key, tuple) else (key,)
                for name, v in zip(keys, kv):
                    out.insert(0, name, v)
                yield out
    return part


def corr_matrix(df: DataFrame, cols: list[str], keys=None, digits: int | None = 2) -> DataFrame:
    """H1/H2: Pearson matrix in long form ``(a, b, i, j, r)`` over
    pairwise-complete rows, mirrored, diagonal 1 (NULL for a constant
    column), rounded half-even to ``digits``.

    Up to ``FEW_COLUMNS`` columns are one aggregate of their pairs. More are a
    distributed Gram matrix: columns are centred on their means (one
    aggregate), every partition adds up the pairwise sums with NumPy matrix
    products and emits n x n rows per key, and one ``groupBy(i, j)`` combines
    them. Work is linear in rows; nothing is held per group.
    """
    k = keys_list(keys)
    n = len(cols)
    if n <= FEW_COLUMNS:
        return _few_correlations(df, cols, k, digits)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(col(c)).alias(f"_m{i}"), F.stddev_pop(col(c)).alias(f"_s{i}")]
    moments = (df.groupBy(*k) if k else df).agg(*aggs)
    d = join_scalar_keys(df.select(*k, *[col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]),
                         moments.drop(*[f"_s{i}" for i in range(n)]), k)
    centred = d.select(*k, *[(F.col(f"_x{i}") - F.col(f"_m{i}")).alias(f"_x{i}") for i in range(n)])
    key_fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in k]
    schema = ", ".join(key_fields + ["i int", "j int", "n long", "sx double", "sy double", "sxx double",
                                     "syy double", "sxy double"])
    # With keys, rows of a key are made contiguous inside each partition (a
    # local sort, no shuffle), so a batch emits n x n rows per key it holds,
    # not per key per scattered row group.
    if k:
        centred = centred.sortWithinPartitions(*k)
    sums = (centred.mapInPandas(_pair_stats(k, n), schema)
            .groupBy(*k, "i", "j")
            .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]))
    cnt = F.col("n").cast("double")
    cov = F.col("sxy") / cnt - (F.col("sx") / cnt) * (F.col("sy") / cnt)
    vx = F.col("sxx") / cnt - (F.col("sx") / cnt) ** 2
    vy = F.col("syy") / cnt - (F.col("sy") / cnt) ** 2
    names = F.array(*[F.lit(c) for c in cols])
    # A column with zero spread gives NULL, as pandas' NaN does.
    sd = F.array(*[F.col(f"_s{i}") for i in range(n)])
    const = (F.element_at(sd, F.col("i") + 1) == 0) | (F.element_at(sd, F.col("j") + 1) == 0)
    r = F.when((F.col("n") > 0) & ~const & (vx > 0) & (vy > 0),
               F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(cov / F.sqrt(vx * vy)))
    out = join_scalar_keys(sums, moments.select(*k, *[f"_s{i}" for i in range(n)]), k)
    out = out.select(*k, F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
                     "i", "j", r.alias("r"))
    if digits is not None:
        out = out.withColumn("r", F.bround("r", digits))
    return out


def _few_correlations(df: DataFrame, cols: list[str], k: list[str], digits: int | None) -> DataFrame:
    """``corr_matrix`` of a few columns: every pair in one map-side combined aggregate, one scan, no Python."""
    n = len(cols)
    x = [col(c).cast("double") for c in cols]
    aggs = [F.stddev_pop(v).alias(f"_s{i}") for i, v in enumerate(x)]
    aggs += [safe_corr(x[i], x[j]).alias(f"_r{i}_{j}") for i in range(n) for j in range(i + 1, n)]
    one = df.groupBy(*k).agg(*aggs) if k else df.agg(*aggs)

    def r(i, j):
        own = F.lit(1.0) if i == j else F.nullif(F.col(f"_r{min(i, j)}_{max(i, j)}"), F.lit(float("nan")))
        own = F.when((F.col(f"_s{i}") > 0) & (F.col(f"_s{j}") > 0), own)
        return F.bround(own, digits) if digits is not None else own

    pairs = [F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j"), r(i, j).alias("r")) for i in range(n) for j in range(n)]
    return one.select(*k, F.explode(F.array(*pairs)).alias("_p")).select(*k, "_p.*")


def corr_matrix_long(df: DataFrame, name_col: str, time_col: str, value_col: str, keys=None, digits: int | None = 2, tile: int = TILE) -> DataFrame:
    """H1 for any number of devices: the Pearson matrix ``(a, b, r)`` of the series in long rows (one row per name and time), over the times that both series
    have, mirrored, diagonal 1 (NULL for a constant series), rounded half-even to ``digits``.

    Names are dealt into blocks of about ``tile``, and the upper triangle into tiles (block, block). A row is sent to the tiles of its
    block, and a tile's task multiplies two matrices of times x names, whose size is bounded by the calendar. No table has a
    column per device, and no batch gives more rows than its tile has pairs."""
    spark, k = df.sparkSession, keys_list(keys)
    path = shared_dir(spark, f"corr/{uuid.uuid4().hex}")
    df.select(*k, col(name_col).alias("_n"), col(time_col).alias("_t"), col(value_col).cast("double").alias("_v")).where(F.col("_n").isNotNull() & F.col("_v").isNotNull()).write.parquet(path)
    long = spark.read.parquet(path)
    blocks = max(1, -(-long.agg(F.count_distinct("_n")).first()[0] // tile))
    own = F.pmod(F.xxhash64("_n"), F.lit(blocks)).cast("int")
    sent = long.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select("*", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))
    fields = [f for f in long.schema.fields if f.name in k]
    name = long.schema["_n"].dataType
    schema = T.StructType([*fields, T.StructField("a", name), T.StructField("b", name), T.StructField("r", T.DoubleType())])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = sent.repartition(tasks, *k, "_i", "_j").groupBy(*k, "_i", "_j").applyInPandas(_tile_correlations(k), schema)
    return out.withColumn("r", F.bround("r", digits)) if digits is not None else out


def _tile_correlations(k: list[str]):
    import numpy as np
    import pandas as pd

    def side(rows: pd.DataFrame, times: pd.Index):
        names, at = np.unique(rows["_n"].to_numpy(), return_inverse=True)
        x = np.full((len(times), len(names)), np.nan)
        x[times.get_indexer(rows["_t"]), at] = rows["_v"].to_numpy()
        varies = np.nanmax(x, axis=0) > np.nanmin(x, axis=0)
        x -= np.nanmean(x, axis=0)
        return names, np.nan_to_num(x), (~np.isnan(x)).astype(float), varies

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["_i"].iloc[0], rows["_j"].iloc[0]
        times = pd.Index(rows["_t"].unique())
        left, right = rows[rows["_b"] == i], rows[rows["_b"] == j]
        if not len(left) or not len(right):  # a block without names
            return pd.DataFrame(columns=[*k, "a", "b", "r"])
        a, x, m, varies = side(left, times)
        b, y, w, varies2 = (a, x, m, varies) if i == j else side(right, times)
        n = np.maximum(m.T @ w, 1)
        sx, sy = x.T @ w / n, m.T @ y / n
        vx, vy = (x * x).T @ w / n - sx * sx, m.T @ (y * y) / n - sy * sy
        ok = (vx > 0) & (vy > 0) & varies[:, None] & varies2[None, :] & (m.T @ w > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.where(ok, (x.T @ y / n - sx * sy) / np.sqrt(vx * vy), np.nan)
        p, q = np.indices(r.shape).reshape(2, -1)
        if i == j:
            r[np.diag_indices(len(a))] = np.where(np.isnan(np.diag(r)), np.nan, 1.0)
        out = pd.DataFrame({"a": a[p], "b": b[q], "r": r.ravel()})
        if i != j:
            out = pd.concat([out, out.rename(columns={"a": "b", "b": "a"})])
        out["r"] = out["r"].astype(object).where(out["r"].notna(), None)
        for c in reversed(k):
            out.insert(0, c, rows[c].iloc[0])
        return out

    return tile


def strongest_pairs(matrix: DataFrame, keys=None, upper_only: bool = True) -> DataFrame:
    """the largest and the smallest off-diagonal r, first in row order (in name order, for a matrix without places) on
    ties; no row (N/A) when there is none."""
    k = keys_list(keys)
    i, j = ("i", "j") if "i" in matrix.columns else ("a", "b")
    m = matrix.where(F.col(i) < F.col(j) if upper_only else F.col(i) != F.col(j)) \
        .where(F.col("r").isNotNull())
    pair = F.struct("a", "b", "r")
    aggs = [F.min_by(pair, F.struct(-F.col("r"), i, j)).alias("max_pair"),
            F.min_by(pair, F.struct(F.col("r"), i, j)).alias("min_pair")]
    g = m.groupBy(*k).agg(*aggs) if k else m.agg(*aggs)
    g = g.where(F.col("max_pair").isNotNull())
    return g.select(*k, F.explode(F.array(
        F.struct(F.lit("max").alias("kind"), F.col("max_pair.a").alias("a"), F.col("max_pair.b").alias("b"),
                 F.col("max_pair.r").alias("r")),
        F.struct(F.lit("min").alias("kind"), F.col("min_pair.a").alias("a"), F.col("min_pair.b").alias("b"),
                 F.col("min_pair.r").alias("r")))).alias("_p")).select(*k, "_p.*")


def ols(df: DataFrame, y: str, x: str, keys=None) -> DataFrame:
    """H3: slope, intercept and R^2 of y ~ x on the complete rows, exact."""
    k = keys_list(keys)
    aggs = [F.regr_slope(col(y), col(x)).alias("slope"), F.regr_intercept(col(y), col(x)).alias("intercept"),
            F.regr_r2(col(y), col(x)).alias("r2"), F.regr_count(col(y), col(x)).alias("n")]
    return df.groupBy(*k).agg(*aggs) if k else df.agg(*aggs)


def ols_trend_points(df: DataFrame, y: str, x: str, key_cols: list[str], keys=None,
                     extra: list[str] | None = None) -> DataFrame:
    """H4: every complete row with the OLS line's value, fitted on all
    complete rows (of its series). The fit is one row per series."""
    k = keys_list(keys)
    s = df.select(*dict.fromkeys([*k, *key_cols]), col(x), col(y), *[col(e) for e in (extra or [])]).dropna(subset=[x, y])
    fit = ols(s, y, x, k).select(*k, F.col("slope").alias("_slope"), F.col("intercept").alias("_intercept"))
    return join_scalar_keys(s, fit, k).withColumn("yhat", F.col("_intercept") + F.col("_slope") * col(x)) \
        .drop("_slope", "_intercept")


def standard_scale(df: DataFrame, cols: list[str], keys=None, suffix: str = "") -> DataFrame:
    """H8: (x - mean) / population std per key; a zero std divides by 1.
    Statistics come from an aggregate joined back (combined map-side), not
    from a window over each whole group."""
    k = keys_list(keys)
    aggs = []
    for c in cols:
        aggs += [F.avg(col(c)).alias(f"_m_{c}"), F.stddev_pop(col(c)).alias(f"_s_{c}")]
    st = (df.groupBy(*k) if k else df).agg(*aggs)
    d = join_scalar_keys(df, st, k)
    scaled = {f"{c}{suffix}": (col(c) - F.col(f"_m_{c}")) /
              F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in cols}
    return d.withColumns(scaled).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


# The weather metrics summarised, in display order.
SUMMARY_METRICS = ("temperature", "apparentTemperature", "humidity", "windSpeed", "pressure")


def weather_summary(df: DataFrame, metrics=SUMMARY_METRICS, keys=None) -> DataFrame:
    """Mean, min and max of the present numeric weather metrics, long (per series, with ``keys``)."""
    from pyspark.sql import types as T
    k = keys_list(keys)
    present = [m for m in metrics if m in df.columns and isinstance(df.schema[m].dataType, T.NumericType)]
    if not present:
        fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name in k]
        return df.sparkSession.createDataFrame([], T.StructType([*fields, T.StructField("metric", T.StringType()), T.StructField("ord", T.IntegerType()),
                                                                 *[T.StructField(c, T.DoubleType()) for c in ("mean", "min", "max")]]))
    aggs = []
    for m in present:
        aggs += [F.avg(m).alias(f"{m}__mean"), F.min(m).alias(f"{m}__min"), F.max(m).alias(f"{m}__max")]
    one = df.groupBy(*k).agg(*aggs) if k else df.agg(*aggs)
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(i).alias("ord"), F.col(f"{m}__mean").cast("double").alias("mean"),
                     F.col(f"{m}__min").cast("double").alias("min"), F.col(f"{m}__max").cast("double").alias("max"))
            for i, m in enumerate(present)]
    return one.select(*k, F.explode(F.array(*rows)).alias("_r")).select(*k, "_r.*")


def high_usage_threshold(df: DataFrame, use_col: str = "use_kw", keys=None) -> DataFrame:
    """Mean + sample standard deviation (per series, with ``keys``)."""
    threshold = (F.avg(col(use_col)) + F.stddev_samp(col(use_col))).alias("threshold")
    k = keys_list(keys)
    return df.groupBy(*k).agg(threshold) if k else df.agg(threshold)


def _groups_dim(spark) -> DataFrame:
    return spark.createDataFrame([(g, i) for i, g in enumerate(WEATHER_GROUP_ORDER)],
                                 "weather_group string, weather_ord int")


def high_usage_probability(df: DataFrame, use_col: str = "use_kw", summary_col: str = "summary", keys=None) -> DataFrame:
    """Percent of rows above the E12 threshold per weather group; all 11
    groups returned (NULL where a group has no rows), with their order. With
    ``keys`` every series has its own threshold and its own 11 groups."""
    k = keys_list(keys)
    rows = df.select(*k, weather_group(summary_col).alias("weather_group"), col(use_col).alias("_use"))
    rows = join_scalar_keys(rows, high_usage_threshold(df, use_col, k).withColumnRenamed("threshold", "_thr"), k)
    pct = rows.groupBy(*k, "weather_group").agg((F.avg(F.when(F.col("_use") > F.col("_thr"), 1.0).otherwise(0.0)) * 100).alias("high_usage_pct"))
    # The dimension is the fixed list of 11 groups (a proven bound): broadcast.
    dim = F.broadcast(_groups_dim(df.sparkSession))
    if not k:
        return dim.join(pct, "weather_group", "left")
    groups = F.array(*[F.struct(F.lit(g).alias("weather_group"), F.lit(i).alias("weather_ord")) for i, g in enumerate(WEATHER_GROUP_ORDER)])
    every = pct.select(*k).distinct().select(*k, F.explode(groups).alias("_g")).select(*k, "_g.*")
    return null_safe_join(every, pct, [*k, "weather_group"], "left")


def box_stats(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """Quartiles (exact, linear interpolation), IQR fences at 1.5 IQR,
    whiskers (extreme values inside the fences) and the outlier count."""
    from meterlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    # The narrow (group, value) table is read by the quantile levels and by
    # the whisker pass: materialise it once.
    narrow = df.select(col(group_col), col(value_col).cast("double").alias(value_col)) \
        .where(col(value_col).isNotNull()).checkpoint(eager=True)
    q = exact_quantiles(narrow, value_col, [0.25, 0.5, 0.75], keys=[group_col], materialize=False).select(
        group_col, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumns({"iqr": F.col("q3") - F.col("q1")})
    q = q.withColumns({"lower_fence": F.col("q1") - 1.5 * F.col("iqr"),
                       "upper_fence": F.col("q3") + 1.5 * F.col("iqr")})
    # One row per group: the planner/AQE broadcast it when it is small.
    j = narrow.select(col(group_col), col(value_col).alias("_v")).join(
        q.select(group_col, "lower_fence", "upper_fence"), group_col)
    inside = F.col("_v").between(F.col("lower_fence"), F.col("upper_fence"))
    w = j.groupBy(group_col).agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
                                 F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
                                 F.count_if(~inside).alias("n_outliers"))
    return q.join(w, group_col)


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 10, keys=None) -> DataFrame:
    """Mean of y in each of the equal-width x bins (B17), every bin
    returned (NULL when empty), with its label. With ``keys`` every series has bins of its own range."""
    k = keys_list(keys)
    if k:
        span = df.groupBy(*k).agg(F.min(col(x)).alias("_lo"), F.max(col(x)).alias("_hi"))
        lo, hi = F.col("_lo"), F.col("_hi")
        d = join_scalar_keys(df.select(*k, col(x).alias("_x"), col(y).alias("_y")), span, k)
        d = d.select(*k, equal_width_bin(F.col("_x"), lo, hi, bins).alias("bin"), "_y")
        allb = span.select(*k, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    else:
        lo = df.select(F.min(col(x))).scalar()
        hi = df.select(F.max(col(x))).scalar()
        d = df.select(equal_width_bin(col(x), lo, hi, bins).alias("bin"), col(y).alias("_y"))
        allb = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    m = d.where(F.col("bin").isNotNull()).groupBy(*k, "bin").agg(F.avg("_y").alias("mean"))
    left, right = bin_edges(F.col("bin"), lo, hi, bins)
    return null_safe_join(allb, m, [*k, "bin"], "left").select(*k, "bin", bin_label(left, right).alias("bin_label"), "mean")
