"""Boosted-tree usage model and exact per-row feature attribution.

J10 is the second-order boosting of ``boost`` on all complete rows. J11 are the path-dependent Shapley values of that
ensemble, with cover = training rows of a node, by the extend / unwind recursion over each tree; rows are
worked out per Arrow batch on all tasks and nothing is gathered. sum(shap) + base_value is the model's prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.operators import boost
from meterlake.operators._util import col
from meterlake.sources.tables import WEATHER_COLUMNS


def weather_features(df: DataFrame) -> list[str]:
    """The weather columns that are present and numeric, in the source's order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in WEATHER_COLUMNS if isinstance(kinds.get(c), T.NumericType)]


def fit_gbt(df: DataFrame, features: list[str], label: str, **settings) -> boost.Boosted:
    """Boosted regression trees (50 trees, depth 4, rate 0.1) on all complete rows."""
    return boost.fit(df, features, label, **settings)


def predict(model: boost.Boosted, df: DataFrame) -> DataFrame:
    return boost.predict(model, df)


def _shap_batch(model: boost.Boosted, keys: int):
    def run(batches):
        features = pa.array(model.features, pa.string())
        for rows in boost.gathered(batches):
            values = boost.feature_values(model, rows)
            phi, base = boost.attribution(model, model.codes(values))
            row = pa.array(np.repeat(np.arange(rows.num_rows), len(features)))
            feature = features.take(pa.array(np.tile(np.arange(len(features)), rows.num_rows)))
            out = [*(c.take(row) for c in rows.columns[:keys]), feature, pa.array(values.ravel()), pa.array(phi.ravel()), pa.array(np.full(phi.size, base))]
            yield pa.RecordBatch.from_arrays(out, [*rows.schema.names[:keys], "feature", "value", "shap", "base_value"])

    return run


def shap_attribution(model: boost.Boosted, df: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per (row, feature) with the feature's value and its Shapley contribution, for rows with every feature."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [T.StructField(k, kinds[k], True) for k in key_cols]
    fields += [T.StructField("feature", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("value", "shap", "base_value")]]
    rows = df.select(*[col(k) for k in key_cols], *[col(f).cast("double").alias(f) for f in model.features]).dropna(subset=model.features)
    return rows.mapInArrow(_shap_batch(model, len(key_cols)), T.StructType(fields))


def shap_ranking(shap: DataFrame, top: int = 10) -> DataFrame:
    """Features by mean |shap|, with the direction of the value/shap
    relation (sign of their correlation), top ``top``."""
    from meterlake.operators.stats import safe_corr
    g = shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"),
                                    F.signum(safe_corr(F.col("value"), F.col("shap"))).alias("direction"))
    return g.orderBy(F.desc("mean_abs_shap"), "feature").limit(top)
