"""Registered model queries: boosted trees and attribution (J10-J12),
monthly anomalies (J13, J14, D5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import anomaly, explain
from meterlake.operators.filters import drop_incomplete
from meterlake.plans.catalog import COVARIATES, query
from meterlake.sources import fixtures as fx

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _fitted(spark, sf):
    """All complete rows, and the model fitted on them."""
    c = fx.covariates(spark, sf)
    features = explain.weather_features(c)
    c = drop_incomplete(c.select(*KEYS, "use_kw", *features), ["use_kw", *features])
    return c, explain.fit_gbt(c, features, "use_kw")


@query("j10_gbt_usage_model")
def j10(spark, sf):
    """Boosted trees (50 x depth 4, rate 0.1) of use on every present weather column, fitted on and predicting all complete rows."""
    c, model = _fitted(spark, sf)
    return explain.predict(model, c)


def _shap(spark, sf):
    c, model = _fitted(spark, sf)
    return explain.shap_attribution(model, c, KEYS)


@query("j11_shap_attribution")
def j11(spark, sf):
    """Exact per-row, per-feature Shapley values of the boosted model, for all complete rows."""
    return _shap(spark, sf)


@query("j11s_shap_additivity", f"""select count(*) as n_values, count(*) / 3 as n_rows, 0 as n_off
from ({COVARIATES}), unnest(['temperature', 'humidity', 'windSpeed']) as _f(feature)
where use_kw is not null and temperature is not null and humidity is not null and windSpeed is not null""")
def j11s(spark, sf):
    """Every value of every complete row is attributed, and contributions and base add up to the model's prediction."""
    c, model = _fitted(spark, sf)
    total = explain.shap_attribution(model, c, KEYS).groupBy(*KEYS, "base_value").agg(F.sum("shap").alias("phi"), F.count(F.lit(1)).alias("n"))
    predicted = explain.predict(model, c).groupBy(*KEYS).agg(F.sum("prediction").alias("p"), F.count(F.lit(1)).alias("rows"))
    both = predicted.join(total, KEYS, "left")
    off = F.coalesce(F.abs(F.col("phi") + F.col("base_value") * F.col("rows") - F.col("p")) > 1e-9 * F.abs("p"), F.lit(True))
    return both.agg(F.sum("n").alias("n_values"), F.sum("rows").cast("double").alias("n_rows"), F.count_if(off).alias("n_off"))


@query("j12_shap_ranking")
def j12(spark, sf):
    """Features ranked by mean |Shapley value| over all complete rows, with direction."""
    return explain.shap_ranking(_shap(spark, sf))


def _flags(spark, sf):
    c = fx.covariates(spark, sf).select(*KEYS, "ts", "use_kw", "temperature", "humidity")
    return anomaly.monthly_anomalies(c, KEYS, ["use_kw", "temperature", "humidity"])


@query("j13_monthly_anomalies")
def j13(spark, sf):
    """J13 (+D5): per-month isolation-forest flags written back to every row
    (1 for months with <= 100 complete rows and for incomplete rows)."""
    return _flags(spark, sf)


@query("d05_write_back_labels")
def d05(spark, sf):
    """Flag counts per month after the write-back (default 1 kept)."""
    f = _flags(spark, sf)
    return f.groupBy("year_month").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count_if(F.col("anomaly") == -1).alias("n_flagged"))


_COMPLETE = "use_kw is not null and temperature is not null and humidity is not null"


@query("d05s_write_back_checks", f"""select strftime(ts, '%Y-%m') as year_month, count(*) as n_rows, count(distinct (l_orderkey, l_linenumber, l_partkey, l_suppkey)) as n_keys,
  sum(l_orderkey) as key_sum, sum(use_kw) as use_kw, count(case when {_COMPLETE} then 1 end) > 100 as modelled, true as flags_fit
from ({COVARIATES}) group by 1""")
def d05s(spark, sf):
    """Every row comes back once, with its values; months at or below the gate keep 1, the others flag at most the top 3 %, at least one row, and
    every flagged row scores above every other one."""
    f = _flags(spark, sf)
    scored, flagged = F.count("anomaly_score"), F.count_if(F.col("anomaly") == -1)
    top = F.floor(0.03 * (scored - 1)) + 1
    lowest = F.min(F.when(F.col("anomaly") == -1, F.col("anomaly_score")))
    highest = F.max(F.when(F.col("anomaly") == 1, F.col("anomaly_score")))
    fit = F.when(scored > 0, (flagged <= top) & (flagged >= 1) & (lowest > highest)).otherwise(flagged == 0)
    return f.groupBy("year_month").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*KEYS).alias("n_keys"), F.sum("l_orderkey").alias("key_sum"),
                                       F.sum("use_kw").alias("use_kw"), (scored > 100).alias("modelled"), fit.alias("flags_fit"))


@query("j14_anomaly_series")
def j14(spark, sf):
    """One month's rows (the busiest month) with the flagged subset."""
    f = _flags(spark, sf)
    busiest = f.groupBy("year_month").count().orderBy(F.desc("count"), "year_month").limit(1)
    return anomaly.anomaly_series(f, busiest.select("year_month").first()[0])
