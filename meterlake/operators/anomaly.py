"""Per-month anomaly flags with isolation forests.

Published algorithm: Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008).
For every month (of every series, with ``keys``) with more than 100 complete rows:

1. every tree draws its own ``max_samples`` rows without replacement from all rows of the month: those with the smallest hashes
   of (row, tree). A row can only be among them if its hash is below a bound that follows from the month's row count, so tasks send little more
   than the draws themselves, however many rows and tasks there are;
2. the trees are grown month by month on these draws; the forests are a written table;
3. rows and forests meet by month: rows are dealt by (month, part of at most ``PART_ROWS`` rows), each part is sent its month's forest in front,
   and the rows behind it are scored batch by batch. One forest is held at a time, and nothing goes through the driver;
4. a row is flagged -1 when its score is in the top ``contamination`` share of its month: the cut is the exact (interpolated)
   quantile of the month's scores, from a sketch and one exact pass.

The source scales the columns per month first. A tree splits between a column's least and largest value, so
shifting and scaling a column moves every split with it and changes no score; the trees are grown on the values as they are.
Months at or below the row gate, and rows with a missing value, keep 1. Seeds derive from (seed, month, tree) and draws from hashes, so
results do not depend on how the data are partitioned.
"""

from __future__ import annotations

import io
import math
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.operators._util import col, keys_list, null_safe_join
from meterlake.operators.quantiles import exact_quantiles
from meterlake.operators.scan import changes
from meterlake.session import shared_dir

# The detector's settings in the source.
CONTAMINATION = 0.03
N_TREES = 100
MAX_SAMPLES = 256
MIN_ROWS = 100          # months with more rows than this are modelled
SEED = 42
#: Rows of a month that are scored by one task.
PART_ROWS = 500_000
#: Months (of all series) whose counts and cuts are broadcast, at most; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Rows that are walked through all trees at once.
BLOCK = 2_048
EULER = 0.5772156649015329


def _c(n):
    n = np.asarray(n, dtype=float)
    out = np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2.0 * (n - 1) / np.maximum(n, 1), 0.0)
    return np.where(n == 2, 1.0, out)


def _grow_tree(sub, rng, height: int):
    """One isolation tree, built level by level: all nodes of a depth are
    split with a few array operations. A node splits on a random feature
    among those not constant in it, at a uniform threshold between that
    feature's min and max; it stays a leaf at the height limit, with one
    sample, or when every feature is constant."""
    n, d = sub.shape
    feat, thr, left, right, size = [-1], [0.0], [-1], [-1], [n]
    node_of = np.zeros(n, dtype=np.int64)
    frontier = np.array([0])
    for _depth in range(height):
        if len(frontier) == 0:
            break
        in_front = np.isin(node_of, frontier)
        idx = np.nonzero(in_front)[0]
        if len(idx) == 0:
            break
        order = idx[np.argsort(node_of[idx], kind="stable")]
        nodes, starts, counts = np.unique(node_of[order], return_index=True, return_counts=True)
        vals = sub[order]
        mins = np.minimum.reduceat(vals, starts, axis=0)
        maxs = np.maximum.reduceat(vals, starts, axis=0)
        varying = maxs > mins
        can = (counts > 1) & varying.any(axis=1)
        # A random feature among the varying ones of each splitting node.
        r = rng.random((len(nodes), d)) * varying
        f = np.argmax(r, axis=1)
        lo = mins[np.arange(len(nodes)), f]
        hi = maxs[np.arange(len(nodes)), f]
        t = lo + rng.random(len(nodes)) * (hi - lo)
        split_nodes = nodes[can]
        next_ids = len(feat) + 2 * np.arange(len(split_nodes))
        child = {}
        for k, (nid, fk, tk, nl) in enumerate(zip(split_nodes, f[can], t[can], next_ids)):
            feat[nid], thr[nid], left[nid], right[nid] = int(fk), float(tk), int(nl), int(nl + 1)
            child[nid] = (int(fk), float(tk), int(nl))
        feat += [-1, -1] * len(split_nodes)
        thr += [0.0, 0.0] * len(split_nodes)
        left += [-1, -1] * len(split_nodes)
        right += [-1, -1] * len(split_nodes)
        size += [0, 0] * len(split_nodes)
        if not child:
            break
        # Route the samples of split nodes to their children.
        per_sample_split = np.isin(node_of, split_nodes)
        sidx = np.nonzero(per_sample_split)[0]
        lookup_f = np.full(len(feat), -1, dtype=np.int64)
        lookup_t = np.zeros(len(feat))
        lookup_l = np.zeros(len(feat), dtype=np.int64)
        for nid, (fk, tk, nl) in child.items():
            lookup_f[nid], lookup_t[nid], lookup_l[nid] = fk, tk, nl
        cur = node_of[sidx]
        go_left = sub[sidx, lookup_f[cur]] <= lookup_t[cur]
        node_of[sidx] = np.where(go_left, lookup_l[cur], lookup_l[cur] + 1)
        new_nodes, new_counts = np.unique(node_of[sidx], return_counts=True)
        for nid, c in zip(new_nodes, new_counts):
            size[nid] = int(c)
        frontier = new_nodes
    return feat, thr, left, right, size


def _builder(groups: list[str], cols: list[str], n_trees: int, max_samples: int, seed: int):
    """One month's draws to one row: its forest, and the smallest number of rows that a tree could draw."""

    def build(drawn: pd.DataFrame) -> pd.DataFrame:
        name = tuple(drawn[g].iloc[0] for g in groups)
        month = zlib.crc32("\x1f".join("\x00" if pd.isna(x) else str(x) for x in name).encode())
        wanted = min(max_samples, int(drawn["_n"].iloc[0]))
        drawn = drawn.sort_values(["_tree", "_draw", *cols], kind="mergesort")
        tree, values = drawn["_tree"].to_numpy(), drawn[cols].to_numpy(dtype=float)
        cuts = np.searchsorted(tree, np.arange(n_trees + 1))
        got = int(np.minimum(np.diff(cuts), wanted).min())
        trees = []
        for t in range(n_trees if got == wanted else 0):
            own = values[cuts[t] : cuts[t] + wanted]
            trees.append(_grow_tree(own, np.random.default_rng([seed, month, t]), math.ceil(math.log2(max(wanted, 2)))))
        return pd.DataFrame([(*name, _packed(trees, wanted), wanted - got)], columns=[*groups, "_forest", "_short"])

    return build


def _packed(trees: list, psi: int) -> bytes:
    """Trees side by side: split feature and threshold, left child (the right one is next to it; a leaf is its own child), and the path length of leaves."""
    width = max((len(t[0]) for t in trees), default=1)
    feature, threshold = np.zeros((len(trees), width), np.int16), np.full((len(trees), width), np.inf)
    left, path = np.zeros((len(trees), width), np.int32), np.zeros((len(trees), width))
    for i, (f, thr, child, _right, size) in enumerate(trees):
        f, child = np.array(f), np.array(child)
        inner = f >= 0
        depth = np.zeros(len(f))
        for node in np.flatnonzero(inner):  # children come after their parents
            depth[child[node]] = depth[child[node] + 1] = depth[node] + 1
        feature[i, : len(f)] = np.where(inner, f, 0)
        threshold[i, : len(f)] = np.where(inner, thr, np.inf)
        left[i, : len(f)] = np.where(inner, child, np.arange(len(f)))
        path[i, : len(f)] = np.where(inner, 0.0, depth + _c(size))
    out = io.BytesIO()
    np.savez_compressed(out, feature=feature, threshold=threshold, left=left, path=path, psi=np.array(psi))
    return out.getvalue()


def _scores(forest: dict, values: np.ndarray) -> np.ndarray:
    """Scores of complete rows, all trees walked together."""
    feature, threshold, left, path = (forest[x].ravel() for x in ("feature", "threshold", "left", "path"))
    trees, width = forest["feature"].shape
    root = np.arange(trees) * width
    height = math.ceil(math.log2(max(int(forest["psi"]), 2)))
    out = np.empty(len(values))
    for at in range(0, len(values), BLOCK):
        block = np.ascontiguousarray(values[at : at + BLOCK])
        row = (np.arange(len(block)) * block.shape[1])[:, None]
        node = np.broadcast_to(root, (len(block), trees))
        for _ in range(height):
            x = block.ravel().take(row + feature.take(node))
            node = root + left.take(node) + (x > threshold.take(node))
        out[at : at + BLOCK] = path.take(node).mean(1)
    return 2.0 ** (-out / _c(int(forest["psi"])))


def _scorer(names: list[str], groups: list[str], cols: list[str], out: list[str]):
    """Rows with their score, from a stream sorted so that each part's forest comes before its rows."""

    def run(batches):
        key = forest = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            given = {c: batch.column(names.index(c)) for c in names}
            now = [given[g] for g in groups]
            new = changes(now, n)
            new[0] = key is None or bool(changes([pa.concat_arrays([a, b.slice(0, 1)]) for a, b in zip(key, now, strict=True)], 2)[1])
            values = np.stack([given[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cols], 1)
            blob, score = given["_forest"], np.full(n, np.nan)
            # A part starts where the month changes or a forest stands.
            starts = np.flatnonzero(new | blob.is_valid().to_numpy(zero_copy_only=False))
            for s, e in zip([0, *starts.tolist()], [*starts.tolist(), n], strict=True):
                if s == e:
                    continue
                if new[s]:
                    forest = None
                if blob[s].is_valid:
                    forest = dict(np.load(io.BytesIO(blob[s].as_py())))
                own = s + np.flatnonzero(~np.isnan(values[s:e]).any(1))
                if forest is not None and len(own):
                    score[own] = _scores(forest, values[own])
            key = [c.slice(n - 1, 1) for c in now]
            rows = pa.RecordBatch.from_arrays([*(given[c] for c in out), pa.array(score, mask=np.isnan(score))], [*out, "anomaly_score"])
            yield rows.filter(given["_forest"].is_null())

    return run


def monthly_anomalies(df: DataFrame, key_cols: list[str], value_cols: list[str], ts_col: str = "ts",
                      contamination: float = CONTAMINATION, n_trees: int = N_TREES,
                      max_samples: int = MAX_SAMPLES, min_rows: int = MIN_ROWS, seed: int = SEED, keys=None) -> DataFrame:
    """J13 + D5: every input row with ``year_month``, ``anomaly_score`` (NULL
    where not modelled) and ``anomaly`` (-1 flagged, 1 otherwise).

    With ``keys``, each series has months of its own. ``key_cols`` tell rows apart in the draw (equal rows are drawn together).
    The write-back needs no unique row key: rows carry all their columns through scoring. The input is read twice: for a narrow copy, and for scoring."""
    spark = df.sparkSession
    groups = [*keys_list(keys), "year_month"]
    base = df.withColumn("year_month", F.date_format(ts_col, "yyyy-MM"))
    complete = F.lit(True)
    for c in value_cols:
        complete = complete & col(c).isNotNull() & ~F.isnan(col(c).cast("double"))
    row_hash = F.xxhash64(F.lit(seed), *[col(c) for c in (*key_cols, *value_cols)])
    cols = [f"_x{i}" for i in range(len(value_cols))]
    folder = shared_dir(spark, f"anomaly/{uuid.uuid4().hex}")
    base.select(*[col(g) for g in groups], *[col(v).cast("double").alias(x) for v, x in zip(value_cols, cols, strict=True)], row_hash.alias("_h"), complete.alias("_ok")).write.parquet(f"{folder}/narrow")
    narrow = spark.read.parquet(f"{folder}/narrow")
    narrow.groupBy(*groups).agg(F.count(F.lit(1)).alias("_all"), F.count_if("_ok").alias("_n")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    few = counts.count() <= BROADCAST_ROWS
    side = (lambda t: F.broadcast(t)) if few else (lambda t: t)

    spread = 10.0
    while True:
        # Ten standard deviations more rows than wanted stay below the bound on average; where even so a tree got too few, the bound is widened.
        share = F.least(F.lit(1.0), (max_samples + spread * math.sqrt(max_samples) + 10) / F.col("_n"))
        rows = null_safe_join(narrow.where("_ok"), side(counts.where(F.col("_n") > min_rows)), groups)
        draw = F.shiftrightunsigned(F.xxhash64("_h", "_tree"), 1)
        drawn = rows.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("_draw", draw).where(F.col("_draw") <= share * float(1 << 63))
        forest_schema = T.StructType([*[T.StructField(g, base.schema[g].dataType) for g in groups], T.StructField("_forest", T.BinaryType()), T.StructField("_short", T.LongType())])
        drawn = drawn.select(*groups, *cols, "_n", "_tree", "_draw").repartition(max(spark.sparkContext.defaultParallelism, 1) * 4, *groups)
        path = f"{folder}/forests-{spread:g}"
        drawn.groupBy(*groups).applyInPandas(_builder(groups, cols, n_trees, max_samples, seed), forest_schema).write.parquet(path)
        forests = spark.read.parquet(path)
        if not forests.where("_short > 0").head(1):
            break
        spread *= 4

    parts = F.ceil(F.col("_all") / PART_ROWS).cast("int")
    names = [f"_c{i}" for i in range(len(df.columns))]  # the caller's columns under names that meet no others
    own = base.select(*[col(c).alias(n) for c, n in zip(df.columns, names, strict=True)], *[col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
                      *[F.when(complete, col(v).cast("double")).alias(x) for v, x in zip(value_cols, cols, strict=True)], row_hash.alias("_h"))
    inner = [f"_g{i}" for i in range(len(groups))]
    renamed = counts.withColumnsRenamed(dict(zip(groups, inner, strict=True)))
    own = null_safe_join(own, side(renamed), inner, "left").withColumn("_part", F.pmod(F.xxhash64("_h"), parts)).withColumn("_forest", F.lit(None).cast("binary"))
    sent = null_safe_join(forests, counts, groups).withColumnsRenamed(dict(zip(groups, inner, strict=True))).select(*inner, "_forest", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("_part"))
    fields = [*names, *inner, *cols, "_part", "_forest"]
    both = own.select(*fields).unionByName(sent, allowMissingColumns=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(tasks, *inner, "_part").sortWithinPartitions(*inner, "_part", F.col("_forest").isNull())
    schema = T.StructType([*[T.StructField(c, both.schema[c].dataType, True) for c in (*names, *inner)], T.StructField("anomaly_score", T.DoubleType())])
    both.mapInArrow(_scorer(fields, inner, cols, [*names, *inner]), schema).write.parquet(f"{folder}/scored")
    scored = spark.read.schema(schema).parquet(f"{folder}/scored")

    # A row is an anomaly when -score falls below the month's contamination quantile of -score, i.e. its score is in the top share of the month.
    neg = scored.withColumn("_neg", -F.col("anomaly_score"))
    cut = exact_quantiles(neg, "_neg", [contamination], keys=inner, materialize=False).select(*inner, F.col("q0").alias("_cut"))
    flagged = null_safe_join(neg, side(cut), inner, "left").withColumn("anomaly", F.when(F.col("_neg") < F.col("_cut"), -1).otherwise(1))
    return flagged.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)], F.col(inner[-1]).alias("year_month"), "anomaly_score", "anomaly")


def anomaly_series(flags: DataFrame, month: str, ts_col: str = "ts", keys=None) -> DataFrame:
    """The month's rows with their flag, for the series + markers view; ``keys`` (column: value) pick one series."""
    rows = flags.where(F.col("year_month") == month)
    for name, value in (keys or {}).items():
        rows = rows.where(col(name).eqNullSafe(F.lit(value)))
    return rows.select(ts_col, *[c for c in flags.columns if c != ts_col])
