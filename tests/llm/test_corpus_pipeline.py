"""The stages of the corpus pipeline, and all of them in a row, against plain versions: null and repeated ids, copies, empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import frames

ITEM = " ".join(f"item{k}" for k in range(20))


def _rows():
    rows = frames.rows()
    copy, near = " ".join(f"p{k}" for k in range(50)), " ".join(f"q{k}" for k in range(120))
    more = [(None, copy), (None, copy + " "), (None, near), (None, near + " end"), (7, "same id " + copy[:150]), (7, "same id " + copy[:150] + "\n"), (900, ITEM), (901, "bad " * 12), (902, "bad word " * 9)]
    return [*rows, *((i, t, "en", "more", len(t), 5, "clash") for i, t in more)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, frames.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(r[0], int("bad" in (r[1] or ""))) for r in _rows() if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def _pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def _keys(spark, texts):
    return {r["text"]: r["k"] for r in spark.createDataFrame([(t,) for t in set(texts)], "text string").select("text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k")).collect()}


def _one_of_each_group(pairs, keys):
    def shingles(text):
        w = frames.lower(text).encode().split()
        return {tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set()

    own = list(dict.fromkeys(pairs))
    sets = {k: shingles(t) for k, (_i, t) in enumerate(own)}
    groups = frames.components(sets, 80)
    place = lambda k: (own[k][0] is None, own[k][0] or 0, keys[own[k][1]])
    return [p for k, p in enumerate(own) if not sets[k] or min(groups[k], key=place) == k]


def _clean(pairs):
    hit = frames.contamination(pairs, [(1, ITEM), (2, None)])
    return [p for p in pairs if not hit[p][-1]]


def test_without_removes_named_rows_only(spark, docs, rows):
    key = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key")
    gone = docs.where("doc_id is null or doc_id = 3").select("doc_id", key)
    assert _pairs(corpus_pipeline._without(docs, gone)) == Counter((r[0], r[1]) for r in rows if r[0] not in (None, 3))
    assert _pairs(corpus_pipeline._without(docs, gone.limit(0))) == Counter((r[0], r[1]) for r in rows)


def test_one_of_each_group(spark, docs, rows):
    pairs = [(r[0], r[1]) for r in rows]
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert _pairs(got) == Counter(_one_of_each_group(pairs, _keys(spark, [t for _, t in pairs])))


def test_drop_contaminated(spark, docs, rows, tables):
    assert _pairs(corpus_pipeline.drop_contaminated(spark, docs, tables)) == Counter(_clean([(r[0], r[1]) for r in rows]))


def test_drop_toxic(spark, docs, tables):
    from meterlake.llm import toxicity
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()
    left = corpus_pipeline.drop_toxic(spark, docs, tables)
    assert Counter(i for i, _ in _pairs(left).elements()) == Counter(r["doc_id"] for r in scored if not r["predicted"])


def test_run(spark, docs, tables):
    left = list(_pairs(corpus_pipeline.drop_toxic(spark, docs, tables)).elements())
    left = _one_of_each_group(left, _keys(spark, [t for _, t in left]))
    kept = corpus_pipeline.remove_repeats(spark, spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in left], frames.SCHEMA), tables)
    want = Counter(i for i, _ in _clean(list(_pairs(kept).elements())))
    got = corpus_pipeline.run(spark, tables).where("start = 0").collect()
    assert Counter(r["doc_id"] for r in got) == want


def test_run_on_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
