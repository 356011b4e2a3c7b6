"""Partition independence, exactness against brute force, invariants and plans."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.operators import density, explain, forecast, ingest, kpi, resample
from meterlake.operators.quantiles import exact_quantiles
from meterlake.operators.sampling import sample_n
from meterlake.sources import fixtures as fx
from tests.conftest import SF_MID, SF_SMALL


@pytest.mark.parametrize("parts", [1, 7, 16])
def test_row_position_is_exact_and_partition_free(spark, parts):
    ev = fx.indexed(spark, SF_SMALL).repartition(parts)
    got = {r["event_id"]: r["pos"] for r in ingest.row_position(ev, "event_id").collect()}
    ids = sorted(got)
    assert [got[i] for i in ids] == list(range(len(ids)))


def test_regular_time(spark):
    ev = fx.indexed(spark, SF_SMALL).drop("ts")
    rows = ingest.assign_regular_time(ev, "event_id").orderBy("event_id").limit(3).collect()
    assert [r["ts"] for r in rows] == [dt.datetime(2016, 1, 1, 5, m) for m in range(3)]


@pytest.mark.parametrize("parts", [1, 16])
def test_sample_is_partition_free(spark, parts):
    ev = fx.meter_long(spark, SF_SMALL).repartition(parts)
    got = sorted(r["event_id"] for r in sample_n(ev, 50, ["event_id"]).collect())
    base = sorted(r["event_id"] for r in sample_n(fx.meter_long(spark, SF_SMALL), 50, ["event_id"]).collect())
    assert got == base and len(got) == 50


def test_exact_quantiles_hot_key_and_ties(spark):
    rnd = random.Random(7)
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(20000)]
    rows += [("cold", rnd.gauss(0, 1)) for _ in range(37)] + [("one", 3.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.03, 0.25, 0.5, 0.75, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(len(probs))]
           for r in exact_quantiles(df, "v", probs, keys=["k"], bins=16, max_exact=100).collect()}
    for k in ("hot", "cold", "one"):
        vals = np.array([v for kk, v in rows if kk == k])
        want = np.percentile(vals, [p * 100 for p in probs])
        assert np.allclose(got[k], want), (k, got[k], want)


def test_energy_sums_agree_across_grains(spark):
    d25 = fx.devices25(spark, SF_SMALL)
    tot = d25.select(F.sum("kw")).first()[0] / 60
    for freq in ("day", "month"):
        e = resample.energy(d25, "kw", freq, keys=["device"], out_names=["kwh"])
        assert math.isclose(e.select(F.sum("kwh")).first()[0], tot, rel_tol=1e-9)
    h = resample.hourly_energy(fx.meter_long(spark, SF_SMALL), "kw", out_names=["kwh"]).select(F.sum("kwh")).first()[0]
    assert math.isclose(h, fx.meter_long(spark, SF_SMALL).select(F.sum("kw")).first()[0] / 60, rel_tol=1e-9)


def test_shares_sum_to_100(spark):
    s = kpi.share_of_total(kpi.device_totals(fx.devices25(spark, SF_SMALL)))
    assert abs(s.select(F.sum("share_pct")).first()[0] - 100) < 0.5


def test_between_dates_is_pushed_to_scan(spark):
    from meterlake.operators.filters import between_dates
    from meterlake.sources.tables import read_table
    q = between_dates(read_table(spark, SF_SMALL, "events"), "2024-01-05", "2024-01-12").select("event_id")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_arima_interval_grows_and_contains_mean(spark):
    raw = fx.series6(spark, SF_SMALL)
    ch = forecast.run_forecasts(raw, ["series"], horizon=7)
    a = ch["arima"].toPandas().sort_values(["series", "ds"])
    assert (a["yhat_lower"] <= a["yhat"]).all() and (a["yhat"] <= a["yhat_upper"]).all()
    for _, g in a.groupby("series"):
        w = (g["yhat_upper"] - g["yhat_lower"]).to_numpy()
        assert w[-1] >= w[0]
    m = ch["metrics"].toPandas()
    assert set(m["verdict"]) <= {"additive better", "arima better", "mixed", "insufficient data"}


def test_shapley_values_add_up(spark):
    c = fx.covariates(spark, SF_SMALL).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                               "use_kw", "temperature", "humidity", "windSpeed")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    s = sample_n(c, 400, keys).cache()
    model = explain.fit_gbt(s, ["temperature", "humidity", "windSpeed"], "use_kw")
    shap = explain.shap_attribution(model, s, keys)
    tot = shap.groupBy(*keys).agg(F.sum("shap").alias("phi"), F.first("base_value").alias("base"))
    pred = explain.predict(model, s).select(*keys, "prediction")
    err = pred.join(tot, keys).select(F.max(F.abs(F.col("phi") + F.col("base") - F.col("prediction")))).first()[0]
    assert err < 1e-6


def _lowess_brute(x, y, frac):
    n = len(x)
    k = max(2, min(n, math.ceil(frac * n)))
    out = []
    for x0 in x:
        d = np.abs(x - x0)
        h = np.sort(d)[k - 1]
        w = (1 - np.clip(d / h, 0, 1) ** 3) ** 3 if h > 0 else (d == 0).astype(float)
        W = np.diag(w)
        X = np.column_stack([np.ones(n), x])
        beta = np.linalg.lstsq(X.T @ W @ X, X.T @ W @ y, rcond=None)[0]
        out.append(beta[0] + beta[1] * x0)
    return np.array(out)


def test_lowess_matches_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = rnd.uniform(0, 10, 120)
    y = np.sin(x) + rnd.normal(0, 0.2, 120)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    got = density.lowess(df, "y", "x", ["id"], iterations=0, bins=100_000).toPandas().sort_values("id")
    want = _lowess_brute(x, y, 2 / 3)
    assert np.allclose(got["fitted"].to_numpy(), want[got["id"].to_numpy()], atol=1e-8)


def test_lowess_keeps_its_resolution_beside_extreme_x(spark):
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.uniform(0, 10, 300), [500.0, 1e9]])
    y = np.concatenate([np.sin(x[:300]), [0.0, 0.0]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    got = density.lowess(df, "y", "x", ["id"], frac=0.2, iterations=0).toPandas().sort_values("id")
    want = _lowess_brute(x[:301], y[:301], 61 / 301)  # as many neighbours without the far row
    assert np.allclose(got["fitted"].to_numpy()[:300], want[:300], atol=1e-4)


def test_lowess_bins_are_small_in_dense_regions(spark):
    far = "case when id % 5000 = 0 then 1e12 * (id + 1) when id % 100 = 0 then 1e5 * rand(2) else rand(1) end"
    df = spark.range(100_000).selectExpr(f"{far} as x")
    n, lo, hi = df.agg(F.count("x"), F.min("x"), F.max("x")).first()
    edges = density._edges(df, "x", n, lo, hi, 1024)
    sizes = [r["count"] for r in density._place(df, "x", edges).groupBy("_b").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * n / 1024 and len(edges) == len(sizes) < 4096


def test_lowess_robust_passes_ignore_outliers(spark):
    rows = [(i, i / 10.0, 2.0 * i / 10.0 + (500.0 if i % 40 == 7 else 0.0)) for i in range(800)]
    got = density.lowess(spark.createDataFrame(rows, "id long, x double, y double"), "y", "x", ["id"]).toPandas()
    assert len(got) == 800
    assert (abs(got["fitted"] - 2 * got["x"]) < 0.5).all()


def test_kde_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    pts = rnd.normal(size=(60, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    out = density.kde2d(df, "x", "y", grid=12, bins=4096).toPandas()
    cov = np.cov(pts.T) * len(pts) ** (-1 / 3)
    inv = np.linalg.inv(cov)
    for _, r in out.sample(5, random_state=1).iterrows():
        d = pts - np.array([r["gx"], r["gy"]])
        q = np.einsum("ij,jk,ik->i", d, inv, d)
        want = np.exp(-0.5 * q).sum() / (2 * math.pi * math.sqrt(np.linalg.det(cov)) * len(pts))
        assert math.isclose(r["density"], want, rel_tol=1e-9)
    assert abs(out["mass"].sum() - 1) < 0.05


def test_stream_equals_batch(spark):
    import uuid
    from meterlake.sources.tables import read_table
    from meterlake.streaming.hourly import stream_hourly_once
    schema = read_table(spark, SF_SMALL, "events").schema
    s = stream_hourly_once(spark, f"{SF_SMALL}/events.parquet", schema, "value", ["event_type"], f"t-{uuid.uuid4().hex}")
    b = resample.hourly_energy(read_table(spark, SF_SMALL, "events"), "value", keys=["event_type"], gap_fill=None,
                               out_names=["kwh"])
    got = {(r["event_type"], r["hour"]): round(r["kwh"], 9) for r in s.collect()}
    want = {(r["event_type"], r["hour"]): round(r["kwh"], 9) for r in b.collect()}
    assert got == want


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "net_kwh" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_backfill_with_keys_has_no_single_partition_step(spark):
    from meterlake.operators import clean
    j = fx.junk_text(spark, SF_SMALL).withColumn("k", F.col("event_id") % 5)
    out = clean.clean_backfill(j, "cloudCover", ["ts", "event_id"], keys=["k"])
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_dedup_keep_last_is_an_aggregate(spark):
    from meterlake.operators.filters import dedup_keep_last
    m = fx.meter_long(spark, SF_SMALL).withColumn("day", F.to_date("ts"))
    out = dedup_keep_last(m.select("device", "day", "ts", "event_id", "kw"), ["device", "day"], "ts", ["event_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan


def test_csv_scan_order_key_drives_regular_time(spark, tmp_path):
    from pyspark.sql import types as T
    from meterlake.sources.tables import scan_meter_csv
    d = tmp_path / "csv"
    d.mkdir()
    n = 0
    for f in range(3):
        with open(d / f"part-{f}.csv", "w") as fh:
            fh.write("time,use [kW],cloudCover\n")
            for i in range(50 + 10 * f):
                fh.write(f"x,{n},0.5\n")
                n += 1
    schema = T.StructType([T.StructField("time", T.StringType()), T.StructField("use [kW]", T.DoubleType()),
                           T.StructField("cloudCover", T.StringType())])
    df = scan_meter_csv(spark, str(d), schema)
    out = ingest.assign_regular_time(df, "row_order").orderBy("ts").collect()
    assert [r["use [kW]"] for r in out] == [float(i) for i in range(n)]
    assert out[0]["ts"] == dt.datetime(2016, 1, 1, 5, 0) and out[-1]["ts"] == dt.datetime(2016, 1, 1, 5, 0) + dt.timedelta(minutes=n - 1)
    last = ingest.drop_last_row(df, "row_order").count()
    assert last == n - 1


def test_row_position_splits_dense_key_cluster(spark):
    # A third of the rows sit in a narrow key range; positions stay exact.
    ids = list(range(0, 2000)) + list(range(10**9, 10**9 + 1000))
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(5)
    got = {r["k"]: r["pos"] for r in ingest.row_position(df, "k", n_buckets=16).collect()}
    assert [got[k] for k in sorted(ids)] == list(range(len(ids)))


def test_stream_resumes_from_checkpoint(spark, tmp_path):
    from meterlake.sources.tables import read_table
    from meterlake.streaming.hourly import current_hourly, hourly_energy_stream, run_to_table
    ev = read_table(spark, SF_SMALL, "events")
    src = tmp_path / "incoming"
    first = ev.where(F.col("event_id") < 500)
    second = ev.where(F.col("event_id") >= 500)
    first.coalesce(1).write.parquet(str(src / "batch=1"))
    table, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    stream = hourly_energy_stream(spark, f"{src}/*/*.parquet", ev.schema, "value", ["event_type"])
    run_to_table(stream, table, ckpt).awaitTermination()
    second.coalesce(1).write.parquet(str(src / "batch=2"))
    stream = hourly_energy_stream(spark, f"{src}/*/*.parquet", ev.schema, "value", ["event_type"])
    run_to_table(stream, table, ckpt).awaitTermination()
    got = {(r["event_type"], r["hour"]): round(r["kwh"], 9) for r in current_hourly(spark, table, ["event_type"]).collect()}
    want = {(r["event_type"], r["hour"]): round(r["kwh"], 9) for r in
            resample.hourly_energy(ev, "value", keys=["event_type"], gap_fill=None, out_names=["kwh"]).collect()}
    assert got == want


def test_hourly_rollup_plan_is_partial_and_pruned(spark):
    from meterlake.sources.tables import read_table
    q = resample.hourly_energy(read_table(spark, SF_SMALL, "events"), "value", keys=["event_type"], out_names=["kwh"])
    q.write.format("noop").mode("overwrite").save()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(value" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert "SinglePartition" not in plan


def test_keyed_corr_matches_pandas(spark):
    import pandas as pd
    from meterlake.operators import stats
    rnd = np.random.default_rng(11)
    rows = []
    for k in ("a", "b", "c"):
        x = rnd.normal(size=80)
        y = 0.5 * x + rnd.normal(size=80)
        z = np.where(rnd.random(80) < 0.2, np.nan, rnd.normal(size=80))
        rows += [(k, float(a), float(b), None if np.isnan(c) else float(c)) for a, b, c in zip(x, y, z)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double").repartition(4)
    got = {(r["k"], r["a"], r["b"]): r["r"] for r in stats.corr_matrix(df, ["x", "y", "z"], keys=["k"], digits=None).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "x", "y", "z"])
    for k, g in pdf.groupby("k"):
        want = g[["x", "y", "z"]].corr()
        for a in "xyz":
            for b in "xyz":
                assert math.isclose(got[(k, a, b)], want.loc[a, b], rel_tol=1e-9, abs_tol=1e-12)


def test_written_tables_live_in_the_shared_checkpoint_folder(spark):
    from meterlake.session import ensure_checkpoint_dir, shared_dir
    root = ensure_checkpoint_dir(spark)
    assert root == spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark, "exports/x").startswith(root.rstrip("/") + "/")
