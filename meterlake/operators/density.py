"""Smoothers and densities over all rows (H5, H6, H7).

Rows are counted into bins by map-side combined aggregates (``groupBy``); the
binned sums, whose number is a parameter and does not grow with the rows, are
what the smoother and the kernels are evaluated on. No rows are gathered or
sampled and no row pairs are made.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators._util import col
from meterlake.operators.quantiles import exact_quantiles
from meterlake.session import shared_dir

# Smoother and density settings of the source's charts.
LOWESS_FRAC, LOWESS_ITER = 2.0 / 3.0, 3
# Times that LOWESS cuts bins with too many rows again; each time into at least two.
LOWESS_CUTS = 8
KDE_GRID, KDE_CUT, KDE_THRESH = 200, 3.0, 0.05


def _bin(value, lo: float, hi: float, bins: int):
    """Number of the equal-width bin of [lo, hi]."""
    if not hi > lo:
        return F.lit(0)
    return F.greatest(F.least(F.floor((value - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)), F.lit(0)).cast("int")


def _place(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """``_b``: the number of the bin, which begins at its edge and ends below the next one."""
    if len(edges) < 2:
        return df.withColumn("_b", F.lit(0))
    from pyspark.ml.feature import Bucketizer
    out = Bucketizer(splits=[-math.inf, *edges[1:], math.inf], inputCol=x, outputCol="_b").transform(df)
    return out.withColumn("_b", F.col("_b").cast("int"))


def _edges(d: DataFrame, x: str, n: int, lo: float, hi: float, bins: int) -> list[float]:
    """The smallest x of each bin: ``bins`` equal parts of the range, and those with more than 2 n / bins rows cut
    again by the same rule between their smallest and largest x, until they are small or hold one value.

    Each cut adds at most 1.5 x ``bins`` bins, so their number does not grow with the rows."""
    import numpy as np
    placed = d.withColumn("_b", _bin(col(x), lo, hi, bins))
    for i in range(LOWESS_CUTS + 1):
        got = placed.groupBy("_b").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        edges = {r["lo"] for r in got}
        dense = [r for r in got if r["n"] > max(1, 2 * n / bins) and r["lo"] < r["hi"]]
        if not dense or i == LOWESS_CUTS:
            return sorted(edges)
        for r in dense:
            edges.update(np.linspace(r["lo"], r["hi"], max(2, math.ceil(r["n"] * bins / n)) + 1)[1:-1].tolist())
        placed = _place(d, x, sorted(edges))


def _local_lines(sums: list, edges: list[float], frac: float) -> list[tuple[int, float, float]]:
    """Per bin the local line (level at the bin's edge, slope): tricube weights over the ceil(frac * n) nearest rows.

    ``sums``: (bin, n, mean u, and the sums of w, w u, w y, w u^2, w u y) with u = x - the bin's edge. For each line they are
    shifted to the bin's mean x, so that rows far away, whose weight is 0, cost no digits."""
    import numpy as np
    sums = sorted(sums)
    n, mean, w, wu, wy, wuu, wuy = (np.array([r[i] for r in sums], float) for i in range(1, 8))
    edge = np.array([edges[r[0]] for r in sums], float)
    at = edge + mean
    k = max(2, min(int(n.sum()), math.ceil(frac * n.sum())))
    out = []
    for i, x0 in enumerate(at):
        d = np.abs(at - x0)
        order = np.argsort(d, kind="stable")
        h = d[order[min(int(np.searchsorted(np.cumsum(n[order]), k)), len(order) - 1)]]
        t = (1 - np.clip(d / h, 0, 1) ** 3) ** 3 if h > 0 else (d == 0).astype(float)
        sw = (t * w).sum()
        if sw <= 0:
            out.append((sums[i][0], float("nan"), 0.0))
            continue
        far = edge - x0
        mx, my = (t * (wu + w * far)).sum() / sw, (t * wy).sum() / sw
        xx = (t * (wuu + 2 * far * wu + far * far * w)).sum()
        sxx = xx - sw * mx * mx
        slope = ((t * (wuy + far * wy)).sum() - sw * mx * my) / sxx if sxx > 1e-12 * max(xx, 1e-300) else 0.0
        out.append((sums[i][0], float(my + slope * (far[i] - mx)), float(slope)))
    return out


def lowess(df: DataFrame, y: str, x: str, key_cols: list[str], frac: float = LOWESS_FRAC,
           iterations: int = LOWESS_ITER, bins: int = 1024) -> DataFrame:
    """H5: locally weighted linear fit of all complete rows: tricube weights
    over the ceil(frac * n) nearest x, then ``iterations`` robust re-fits with
    bisquare weights on residuals / (6 * median |residual|).

    One pass sums n, x, y, xx and xy per bin of x (narrow in x and, but for
    ties, of at most 2 n / ``bins`` rows, also where a few x lie far outside); a
    line per bin follows from these; every row is fitted by its bin's line.
    A robust pass weighs the rows by their residuals and sums again."""
    spark = df.sparkSession
    d = df.select(*key_cols, col(x).cast("double").alias(x), col(y).cast("double").alias(y)).dropna(subset=[x, y])
    # Cuts and passes read the narrow rows; the input itself is read once.
    path = shared_dir(spark, f"lowess/{uuid.uuid4().hex}")
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    n, lo, hi = d.agg(F.count(F.lit(1)), F.min(x), F.max(x)).first()
    fitted = F.lit(None).cast("double")
    if lo is None:
        return d.withColumn("fitted", fitted)
    edges = _edges(d, x, n, lo, hi, bins)
    starts = spark.createDataFrame(list(enumerate(edges)), "_b int, _e double")
    d = _place(d, x, edges).join(F.broadcast(starts), "_b").withColumn("_u", col(x) - F.col("_e"))
    u = F.col("_u")
    rows, weight = d, F.lit(1.0)
    for i in range(iterations + 1):
        sums = rows.withColumn("_w", weight).groupBy("_b").agg(
            F.count(F.lit(1)).alias("n"), F.avg(u).alias("at"), F.sum("_w").alias("w"), F.sum(F.col("_w") * u).alias("wu"),
            F.sum(F.col("_w") * col(y)).alias("wy"), F.sum(F.col("_w") * u * u).alias("wuu"),
            F.sum(F.col("_w") * u * col(y)).alias("wuy")).collect()  # one row per bin
        lines = spark.createDataFrame(_local_lines([tuple(r) for r in sums], edges, frac), "_b int, _a double, _s double")
        rows = d.join(F.broadcast(lines), "_b").withColumn("fitted", F.col("_a") + F.col("_s") * u)
        if i == iterations:
            break
        resid = F.abs(col(y) - F.col("fitted"))
        s = exact_quantiles(rows.select(resid.alias("_r")), "_r", [0.5]).first()["q0"]
        if not s > 0:
            break
        part = resid / F.lit(6.0 * s)
        weight = F.when(part < 1, (1 - part * part) * (1 - part * part)).otherwise(F.lit(0.0))
    return rows.select(*key_cols, x, y, F.when(~F.isnan("fitted"), F.col("fitted")).alias("fitted"))


def kde2d(df: DataFrame, x: str, y: str, grid: int = KDE_GRID, cut: float = KDE_CUT,
          thresh: float = KDE_THRESH, bins: int | None = None) -> DataFrame:
    """H6: 2-D Gaussian density of all complete rows on a grid x grid lattice
    (Scott bandwidth, full covariance), extended ``cut`` bandwidths beyond the
    data, with the level below which ``thresh`` of the mass lies and a flag for
    the cells drawn (density >= level).

    The rows are counted into ``bins`` x ``bins`` cells (``grid`` unless given);
    a cell's count stands at the mean of its rows. The cells are a broadcast
    of at most ``bins``^2 rows; lattice points are spread over the tasks."""
    import numpy as np
    spark = df.sparkSession
    bins = bins or grid
    d = df.select(col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y")).dropna()
    s = d.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"),
              F.var_samp("_x").alias("vx"), F.var_samp("_y").alias("vy"), F.covar_samp("_x", "_y").alias("vxy")).first()
    schema = "cell long, gx double, gy double, density double, mass double, in_contour boolean, level double"
    if s["n"] < 2:
        return spark.createDataFrame([], schema)
    cells = d.groupBy(_bin(F.col("_x"), s["x0"], s["x1"], bins).alias("i"), _bin(F.col("_y"), s["y0"], s["y1"], bins).alias("j")).agg(
        F.avg("_x").alias("x"), F.avg("_y").alias("y"), F.count(F.lit(1)).alias("w")).collect()  # at most bins^2 rows
    data = np.array([(r["x"], r["y"], r["w"]) for r in cells], float)
    cov = np.array([[s["vx"], s["vxy"]], [s["vxy"], s["vy"]]]) * s["n"] ** (-1.0 / 3.0)
    inv = np.linalg.pinv(cov)
    norm = 1.0 / (2 * math.pi * math.sqrt(max(np.linalg.det(cov), 1e-300)) * s["n"])
    bw = np.sqrt(np.diag(cov))
    gx = np.linspace(s["x0"] - cut * bw[0], s["x1"] + cut * bw[0], grid)
    gy = np.linspace(s["y0"] - cut * bw[1], s["y1"] + cut * bw[1], grid)
    bc = spark.sparkContext.broadcast((data, inv, norm, gx, gy))

    def dens(it):
        import numpy as np
        pts, ainv, c, ax, ay = bc.value
        for part in it:
            ids = part["id"].to_numpy()
            px = ax[ids // grid]
            py = ay[ids % grid]
            out = np.zeros(len(ids))
            for start in range(0, len(ids), 128):
                dx = px[start:start + 128, None] - pts[None, :, 0]
                dy = py[start:start + 128, None] - pts[None, :, 1]
                q = ainv[0, 0] * dx * dx + 2 * ainv[0, 1] * dx * dy + ainv[1, 1] * dy * dy
                out[start:start + 128] = c * (np.exp(-0.5 * q) @ pts[:, 2])
            yield part.assign(gx=px, gy=py, density=out)

    from meterlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    lattice = spark.range(grid * grid).mapInPandas(dens, "id long, gx double, gy double, density double") \
        .checkpoint(eager=True)
    cell_area = float((gx[1] - gx[0]) * (gy[1] - gy[0])) if grid > 1 else 1.0
    # Level: walking cells from the lowest density up, the density at which
    # the accumulated share of mass reaches ``thresh``. The lattice size is a
    # parameter (grid^2 rows), so this window is bounded.
    total = lattice.select(F.sum("density")).scalar()
    w = Window.orderBy("density", "id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = lattice.withColumn("_cum", F.sum("density").over(w) / total)
    level = ranked.where(F.col("_cum") >= thresh).select(F.min("density")).scalar()
    return lattice.select(F.col("id").alias("cell"), "gx", "gy", "density",
                          (F.col("density") * cell_area).alias("mass"),
                          (F.col("density") >= level).alias("in_contour"), level.alias("level"))


def season_box(df: DataFrame, value_col: str, season_col: str = "season") -> DataFrame:
    """H7 (box part): exact quartiles, whiskers and outliers per season of all
    complete rows."""
    from meterlake.operators.stats import box_stats
    return box_stats(df.select(col(value_col), col(season_col)).dropna(), value_col, season_col)


def season_density(df: DataFrame, value_col: str, season_col: str = "season", points: int = 100,
                   bins: int = 512) -> DataFrame:
    """H7 (density part): 1-D Gaussian density per season (Silverman
    bandwidth) on ``points`` values spanning each season's range.

    All complete rows enter: they are counted into ``bins`` equal bins of the
    season's range (a map-side combined aggregate), and a bin's count stands
    at the mean of its values, so a season's kernel sum has at most ``bins``
    terms however many rows there are."""
    d = df.select(col(season_col), col(value_col).cast("double").alias("_v")).dropna()
    q = exact_quantiles(d, "_v", [0.25, 0.75], keys=[season_col])
    st = d.groupBy(season_col).agg(F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_lo"),
                                   F.max("_v").alias("_hi"))
    st = st.join(q, season_col)
    iqr = (F.col("q1") - F.col("q0")) / 1.34
    spread = F.when((iqr > 0) & (iqr < F.col("_sd")), iqr).otherwise(F.col("_sd"))
    st = st.withColumn("bandwidth", 0.9 * spread * F.pow(F.col("n"), -0.2))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    weights = (d.join(st.select(season_col, "_lo", "_hi"), season_col).groupBy(season_col, place.alias("_bin"))
               .agg(F.avg("_v").alias("at"), F.count(F.lit(1)).alias("w"))
               .groupBy(season_col).agg(F.collect_list(F.struct("at", "w")).alias("_bins")))
    grid = st.select(season_col, "bandwidth", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_g"),
                     "_lo", "_hi").withColumn(
        "x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_g") / F.lit(max(points - 1, 1)))
    g = grid.join(weights, season_col)
    term = F.transform("_bins", lambda b: b["w"] * F.exp(-0.5 * ((F.col("x") - b["at"]) / F.col("bandwidth")) ** 2))
    dens = F.aggregate(term, F.lit(0.0), lambda a, b: a + b) / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))
    return g.select(season_col, "x", F.when(F.col("bandwidth") > 0, dens).alias("density"), "bandwidth")
