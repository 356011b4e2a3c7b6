"""Second-order boosting of regression trees on binned features (Chen and Guestrin 2016, histogram form), squared loss.

1. Every feature is cut into at most ``BINS`` parts of about equal row counts, from counts of fine value cells that merge exactly (``quantiles.value_cells``).
2. Rows of equal bins are one cell with their number and the sum of their labels. For squared loss the gradients and curvatures of a cell's
   rows follow from these two numbers, so nothing is lost.
3. Per level of a tree, the gradients and curvatures of the cells are summed by (node, feature, bin), and each node takes the split with the
   largest regularised gain. The sums are one grouped aggregate over the cells' table; where it has at most ``LOCAL_CELLS`` rows it is fetched once and
   summed in place.

Labels and leaf values are whole multiples of a power of two, and are summed as integers. So the model is the same, bit by bit, however the
rows are partitioned and wherever the sums are taken.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.operators._util import col
from meterlake.operators.quantiles import value_cells
from meterlake.session import shared_dir

# The boosted model's settings in the source, and the defaults that it takes over from its library.
TREES, DEPTH, RATE = 50, 4, 0.1
L2, LEAST_CHILD, LEAST_GAIN, BINS = 1.0, 1, 1e-6, 256
#: Cells that are fetched and summed on the driver, at most; more are summed by grouped aggregates.
LOCAL_CELLS = 250_000
#: Rows that are predicted or attributed together.
GATHERED_ROWS = 1 << 17


@dataclass
class Tree:
    """Nodes in the order of their making; ``feature`` -1 for leaves. A row goes left where its bin is at most ``bin``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[int] = field(default_factory=lambda: [0])  # in units of the model
    cover: list[int] = field(default_factory=lambda: [0])

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(codes), np.int64)
        while (inner := feature[node] >= 0).any():
            f = np.where(inner, feature[node], 0)
            goes = codes[np.arange(len(codes)), f] <= cut[node]
            node = np.where(inner, np.where(goes, left[node], right[node]), node)
        return node


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]  # upper ends of the bins of each feature but the last
    unit: float
    base: int = 0
    trees: list[Tree] = field(default_factory=list)

    def codes(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(self.edges)], 1).astype(np.int32)

    def margins(self, codes: np.ndarray, known: np.ndarray | None = None, trees: int = 0) -> np.ndarray:
        """Predictions in units; ``known`` are those of the first ``trees`` trees."""
        out = np.full(len(codes), self.base, np.int64) if known is None else known
        for t in self.trees[trees:]:
            out = out + np.array(t.value, np.int64)[t.leaf_of(codes)]
        return out

    def distinct(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows of codes, and which of them each row is."""
        widths = [len(e) + 1 for e in self.edges]
        if math.prod(widths) < 1 << 62:
            key = np.zeros(len(codes), np.int64)
            for k, w in enumerate(widths):
                key = key * w + codes[:, k]
            _own, first, which = np.unique(key, return_index=True, return_inverse=True)
            return codes[first], which
        own, which = np.unique(codes, axis=0, return_inverse=True)
        return own, which.ravel()


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """For each feature the upper ends of its bins, but for the last bin's; values that differ lie in one bin only where there are more than ``bins``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), col(f).cast("double").alias("v")) for k, f in enumerate(features)])
    cells = value_cells(df.select(F.explode(pairs).alias("p")).select("p.*"), "v", ["k"], bits=14)
    total = F.sum("c").over(_running().rangeBetween(_UNBOUNDED, _END))
    upto = F.sum("c").over(_running())
    cells = cells.withColumns({"upto": upto, "total": total, "kinds": F.count(F.lit(1)).over(_running().rangeBetween(_UNBOUNDED, _END))})
    part = F.when(F.col("kinds") <= bins, F.col("cell")).otherwise(F.floor((F.col("upto") - 1) * bins / F.col("total")))
    # At most ``bins`` rows a feature.
    ends = cells.groupBy("k", part.alias("part")).agg(F.max("hi").alias("hi")).collect()
    return [np.array(sorted(r["hi"] for r in ends if r["k"] == k)[:-1], float) for k in range(len(features))]


def _running():
    from pyspark.sql import Window
    return Window.partitionBy("k").orderBy("cell")


_UNBOUNDED, _END = -(1 << 63), (1 << 63) - 1


def _cells(model: Boosted):
    """Rows of (label, features...) to cells of the batch."""
    names = [*(f"b{k}" for k in range(len(model.features))), "n", "s"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([np.asarray(c, float) for c in batch.columns], 1)
            label = np.rint(values[:, 0] / model.unit).astype(np.int64)
            code, which = model.distinct(model.codes(values[:, 1:]))
            total = np.zeros(len(code), np.int64)
            np.add.at(total, which, label)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(code[:, k])) for k in range(code.shape[1])), pa.array(np.bincount(which, minlength=len(code)).astype(np.int64)), pa.array(total)], names)

    return run


def level_sums(model: Boosted, tree: Tree, codes: np.ndarray, n: np.ndarray, s: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, feature, bin) of cells in open nodes, and sums of gradients and curvatures there; gradients in units."""
    node = tree.leaf_of(codes)
    gradient = n * margin - s
    width = max(len(e) for e in model.edges) + 1
    shape = (len(tree.feature), len(model.features), width)
    sums = np.zeros((2, math.prod(shape)), np.int64)
    for k in range(len(model.features)):
        at = (node * shape[1] + k) * width + codes[:, k]
        np.add.at(sums[0], at, gradient)
        np.add.at(sums[1], at, n)
    at = np.flatnonzero(sums[1])
    return at, sums[:, at]


def _partial_sums(model: Boosted, tree: Tree):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                *codes, n, s = (np.asarray(c) for c in batch.columns)
                codes = np.stack(codes, 1)
                at, (g, h) = level_sums(model, tree, codes, n, s, model.margins(codes))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g), pa.array(h)], ["at", "g", "h"])

    return run


def grow(model: Boosted, sums, depth: int, rate: float, l2: float) -> Tree:
    """One more tree. ``sums(model, tree)`` gives the level sums over all cells."""
    tree = Tree()
    shape = len(model.features), max(len(e) for e in model.edges) + 1
    open_nodes, gradient, curvature = [0], {}, {}
    for _level in range(depth):
        at, (g, h) = sums(model, tree)
        dense = np.zeros((2, len(tree.feature), *shape), np.int64)
        dense.reshape(2, -1)[:, at] = g, h
        if 0 in open_nodes:
            gradient[0], curvature[0] = int(dense[0, 0, 0].sum()), int(dense[1, 0, 0].sum())
            tree.cover[0] = curvature[0]
        splits = []
        for node in open_nodes:
            left_g, left_h = dense[:, node].cumsum(2)
            right_g, right_h = gradient[node] - left_g, curvature[node] - left_h
            score = lambda a, b: (a * model.unit) ** 2 / (b + l2)
            gain = (score(left_g, left_h) + score(right_g, right_h) - score(gradient[node], curvature[node])) / 2
            gain = np.where((left_h >= LEAST_CHILD) & (right_h >= LEAST_CHILD), gain, -np.inf)
            best = int(np.argmax(gain))
            if gain.flat[best] > LEAST_GAIN:
                f, b = divmod(best, shape[1])
                splits.append((node, f, b, int(left_g[f, b]), int(left_h[f, b])))
        open_nodes = []
        for node, f, b, lg, lh in splits:
            tree.feature[node], tree.bin[node] = f, b
            for side, (g1, h1) in (("left", (lg, lh)), ("right", (gradient[node] - lg, curvature[node] - lh))):
                child = len(tree.feature)
                getattr(tree, side)[node] = child
                for name, value in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("value", 0), ("cover", h1)):
                    getattr(tree, name).append(value)
                gradient[child], curvature[child] = g1, h1
                open_nodes.append(child)
        if not open_nodes:
            break
    for node, f in enumerate(tree.feature):
        if f < 0 and node in gradient:
            tree.value[node] = round(-rate * gradient[node] / (curvature[node] + l2))
    return tree


def fit(df: DataFrame, features: list[str], label: str, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, l2: float = L2, bins: int = BINS, local_cells: int | None = None) -> Boosted:
    """Boosted trees on all rows that have the label and every feature. No rows give a model that predicts 0."""
    spark = df.sparkSession
    rows = df.select(col(label).cast("double").alias("y"), *[col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)]).dropna()
    path = shared_dir(spark, f"boost/{uuid.uuid4().hex}")
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    names = [f"f{k}" for k in range(len(features))]
    count, largest = rows.agg(F.count(F.lit(1)), F.max(F.abs("y"))).first()
    # Sums of labels, margins and their differences stay below 2^62.
    unit = 2.0 ** math.ceil(math.log2(max(count * (largest or 1), 1)) - 60) if count and largest else 1.0
    model = Boosted(list(features), bin_edges(rows, names, bins) if count else [np.empty(0)] * len(features), max(unit, 2.0**-40))
    if not count:
        return model
    schema = ", ".join([*(f"b{k} int" for k in range(len(features))), "n long", "s long"])
    codes = [f"b{k}" for k in range(len(features))]
    rows.mapInArrow(_cells(model), schema).groupBy(*codes).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells").select(*codes, "n", "s")
    count_cells, total = cells.agg(F.count(F.lit(1)), F.sum("s")).first()
    if count_cells <= (LOCAL_CELLS if local_cells is None else local_cells):
        fetched = cells.toArrow()
        *columns, n, s = (c.to_numpy() for c in fetched.columns)
        held = np.stack(columns, 1)
        state = [None, 0]  # margins of so many trees

        def sums(m, t):
            state[:] = m.margins(held, *state), len(m.trees)
            return level_sums(m, t, held, n, s, state[0])
    else:
        def sums(m, t):
            got = cells.mapInArrow(_partial_sums(m, t), "at long, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            return got["at"].to_numpy(), (got["g"].to_numpy(), got["h"].to_numpy())
    model.base = round(total / count)
    for _ in range(trees):
        model.trees.append(grow(model, sums, depth, rate, l2))
    return model


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``; NULL where a feature is missing."""
    names = df.columns
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in df.schema.fields), T.StructField("prediction", T.DoubleType())])

    def run(batches):
        for batch in gathered(batches):
            values = feature_values(model, batch)
            codes, which = model.distinct(model.codes(values))
            out = (model.margins(codes) * model.unit)[which]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64(), mask=np.isnan(values).any(1))], [*names, "prediction"])

    return df.mapInArrow(run, schema)


def gathered(batches, rows: int = GATHERED_ROWS):
    """The batches joined to about ``rows`` rows each, so that equal rows meet."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def feature_values(model: Boosted, batch: pa.RecordBatch) -> np.ndarray:
    """The rows' features as floats, NaN where missing."""
    given = [batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in model.features]
    return np.stack(given, 1) if given else np.empty((batch.num_rows, 0))


# ---- attribution -------------------------------------------------------------------------------------------------------------


def _extended(weight: np.ndarray, zero: float, one: np.ndarray) -> np.ndarray:
    """Weights of the path's coalitions by size (rows: size) with one more feature."""
    m = len(weight)
    out = np.zeros((m + 1, weight.shape[1]))
    size = np.arange(m)[:, None]
    out[1:] = one * weight * (size + 1) / (m + 1)
    out[:-1] += zero * weight * (m - size) / (m + 1)
    return out


def _without(weight: np.ndarray, zero: float, one: np.ndarray) -> np.ndarray:
    """The weights before the feature with these fractions was added; ``one`` is 0 or 1 for each row."""
    m = len(weight) - 1
    out = np.empty((m, weight.shape[1]))
    rest = weight[m]
    for k in range(m - 1, -1, -1):
        taken = rest * (m + 1) / (k + 1)
        out[k] = np.where(one > 0, taken, weight[k] * (m + 1) / (zero * (m - k)))
        rest = weight[k] - taken * zero * (m - k) / (m + 1)
    return out


def tree_attribution(tree: Tree, codes: np.ndarray, phi: np.ndarray) -> None:
    """Add one tree's path-dependent Shapley values (in units) to ``phi``, by the recursion of Lundberg et al. (2018) over all rows at once.

    Every leaf costs the square of its depth; no coalition is listed."""

    def visit(node, path, weight):
        if tree.feature[node] < 0:
            for f, zero, one in path:
                phi[:, f] += _without(weight, zero, one).sum(0) * (one - zero) * tree.value[node]
            return
        f = tree.feature[node]
        zero, one = 1.0, 1.0
        for k, (g, z, o) in enumerate(path):  # a feature that the path has already
            if g == f:
                weight, zero, one, path = _without(weight, z, o), z, o, path[:k] + path[k + 1 :]
                break
        goes = codes[:, f] <= tree.bin[node]
        for child, own in ((tree.left[node], goes), (tree.right[node], ~goes)):
            z, o = zero * tree.cover[child] / tree.cover[node], one * own
            visit(child, [*path, (f, z, o)], _extended(weight, z, o))

    visit(0, [], np.ones((1, len(codes))))


def attribution(model: Boosted, codes: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values of each row and feature, and the value without any feature; equal rows are worked out once."""
    own, which = model.distinct(codes)
    phi = np.zeros(own.shape)
    base = float(model.base)
    for t in model.trees:
        tree_attribution(t, own, phi)
        base += sum(v * c for v, c, f in zip(t.value, t.cover, t.feature, strict=True) if f < 0) / max(t.cover[0], 1)
    return (phi * model.unit)[which], base * model.unit
