"""Boosting against a plain row-by-row version, on both ways of summing, and attribution against all coalitions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.operators import boost, explain

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(0, 30, 900) / 2, rng.normal(size=900).round(2), rng.choice([-1e9, 0.0, 1e-9, 5.0], 900)
    y = 100 * a + 30 * (b > 0) * (c > 0) + rng.normal(size=900)
    return np.stack([a, b, c, y], 1)


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(int(i), *map(float, r)) for i, r in enumerate(data)] + [(900, None, 1.0, 1.0, 1.0), (901, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def plain_boosting(x, y, edges, trees, depth, rate=boost.RATE, l2=boost.L2):
    """Exact arithmetic left aside: every split is searched by summing rows."""
    pred = np.full(len(y), y.mean())
    for _ in range(trees):
        g, step = pred - y, np.zeros(len(y))

        def split(rows, level):
            best = (boost.LEAST_GAIN, None)
            for f, cuts in enumerate(edges) if level < depth else ():
                for e in cuts:
                    left = rows & (x[:, f] <= e)
                    right = rows & (x[:, f] > e)
                    if left.any() and right.any():
                        gain = (g[left].sum() ** 2 / (left.sum() + l2) + g[right].sum() ** 2 / (right.sum() + l2) - g[rows].sum() ** 2 / (rows.sum() + l2)) / 2
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            if best[1] is None:
                step[rows] = -rate * g[rows].sum() / (rows.sum() + l2)
            else:
                for side in best[1]:
                    split(side, level + 1)

        split(np.ones(len(y), bool), 0)
        pred = pred + step
    return pred


@pytest.mark.parametrize("local", [boost.LOCAL_CELLS, 0])
def test_boosting_against_a_plain_version(frame, data, local):
    model = boost.fit(frame, FEATURES, "y", trees=3, depth=3, bins=16, local_cells=local)
    got = {r["id"]: r["prediction"] for r in boost.predict(model, frame).collect()}
    want = plain_boosting(data[:, :3], data[:, 3], model.edges, 3, 3)
    assert np.allclose([got[i] for i in range(900)], want, rtol=1e-6)
    assert got[900] is None and got[901] is not None
    assert [len(e) + 1 for e in model.edges] == [16, 16, 4]


def test_model_does_not_depend_on_partitions_or_on_where_it_sums(frame):
    models = [boost.fit(frame.repartition(p), FEATURES, "y", trees=4, local_cells=local) for p, local in ((1, None), (7, None), (5, 0))]
    assert models[0].trees == models[1].trees == models[2].trees and len({m.base for m in models}) == 1


def test_bins_are_merged_quantiles(spark):
    df = spark.range(20_000).select((F.pmod(F.col("id") * 7919, F.lit(20_000)) / 7 - 900).cast("double").alias("v"), F.lit(1.5).alias("w"))
    edges = boost.bin_edges(df, ["v", "w"], 64)
    assert boost.bin_edges(df.repartition(9), ["v", "w"], 64)[0].tolist() == edges[0].tolist()
    values = np.sort(np.arange(20_000) / 7 - 900)
    counts = np.bincount(np.searchsorted(edges[0], values), minlength=64)
    assert len(counts) == 64 and counts.max() < 2 * 20_000 / 64 and len(edges[1]) == 0


def coalition_value(tree, codes, members, node=0):
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in members:
        return coalition_value(tree, codes, members, left if codes[f] <= tree.bin[node] else right)
    return sum(tree.cover[c] * coalition_value(tree, codes, members, c) for c in (left, right)) / tree.cover[node]


@pytest.mark.parametrize("depth", [1, 4, 8])
def test_attribution_against_all_coalitions(frame, data, depth):
    model = boost.fit(frame, FEATURES, "y", trees=2, depth=depth)
    codes = model.codes(data[:40, :3])
    phi, base = boost.attribution(model, codes)
    for r in range(len(codes)):
        for f in range(3):
            others, want = [k for k in range(3) if k != f], 0.0
            for size in range(3):
                for s in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / 6
                    want += weight * sum(coalition_value(t, codes[r], {*s, f}) - coalition_value(t, codes[r], set(s)) for t in model.trees)
            assert math.isclose(phi[r, f], want * model.unit, rel_tol=1e-9, abs_tol=1e-7)
    assert np.allclose(phi.sum(1) + base, model.margins(codes) * model.unit, rtol=1e-12)


def test_every_present_weather_column_is_used(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", 3.0, 4)], "use_kw double, pressure double, summary string, dewPoint double, humidity int")
    assert explain.weather_features(df) == ["humidity", "pressure", "dewPoint"]


def test_no_rows(frame):
    model = boost.fit(frame.where("id < 0"), FEATURES, "y")
    assert {r["prediction"] for r in boost.predict(model, frame).collect()} == {0.0, None}
