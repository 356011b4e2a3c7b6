"""Words that polynomial hashes confuse, texts beyond the piece size, clashing column names, and words of any length."""

from __future__ import annotations


import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import common, decontam, jaccard, kneser_ney, langid, quality, substring, toxicity

from . import frames


def thue_morse(n):
    """Two words of ``n`` letters that have one polynomial hash modulo 2^64 under every base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_word_hashes_tell_structured_words_apart():
    for n in (16, 64, 1024, 2048):
        a, b = thue_morse(n)
        h = common.word_hashes(f"{a} {b} {a}".encode())
        assert h[0] == h[2] != h[1]
    words = [b"x" * n for n in range(1, 300)] + [b"y" + b"x" * n for n in range(300)] + [bytes([65 + k]) * 8 + b"z" * 9 for k in range(20)]
    hashes = common.word_hashes(b" \n".join(words))
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    apart = [common.word_hashes(w)[0] for w in words]
    assert hashes.tolist() == apart
    assert len(common.word_hashes(b"")) == len(common.word_hashes(b" \t\n")) == 0


def test_confusable_words_change_no_result(spark):
    a, b = thue_morse(1024)
    words = [f"w{k}" for k in range(19)]
    texts = [" ".join([a, *words]), " ".join([b, *words]), a, b, " ".join([a, *words[:7], b, *words[:7]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert {r["doc_id"]: r["n_removed"] for r in substring.digest(docs).collect()} == dict.fromkeys(range(5), 0)
    assert all(r["component_id"] == r["doc_id"] for r in jaccard.digest(docs).where("doc_id in (2, 3)").collect())
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert {r["n_repeat_words"] for r in quality.judge(docs, labels).collect()} == {0}
    held = next(i for i in range(10, 1000) if __import__("zlib").crc32(str(i).encode()) % 10 == 0)
    more = docs.where("doc_id = 2").select(F.lit(1).cast("long").alias("doc_id"), "text").unionByName(docs.where("doc_id = 3").select(F.lit(held).cast("long").alias("doc_id"), "text"))
    assert {r["doc_id"]: r["n_known"] for r in kneser_ney.perplexity_scores(more).collect()}[held] == 1


def test_windows_of_one_hash_are_compared_by_words(spark, monkeypatch):
    """With a hash that gives every window one value, only windows of equal words are removed."""
    monkeypatch.setattr(substring, "LOCAL_HOT", 1 << 30)
    rows = [(i, " ".join(f"v{(i * 3 + k) % 40}" for k in range(30 + i))) for i in range(12)] + [(20, " ".join(f"v{k}" for k in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keys = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    want = frames.removed([(i, t, keys[t]) for i, t in rows])
    judged = substring._judge
    real = substring.window_hashes
    monkeypatch.setattr(substring, "window_hashes", lambda words, n: real(words, n) * np.uint64(n != substring.WINDOW))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(docs).collect()}
    assert got == {i: want[i, t] for i, t in rows} and judged is substring._judge


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts above the piece size, one of them a single word."""
    prose = " ".join(f"word{k % 700}x{k % 11}" for k in range(30_000))
    assert len(prose) > common.PIECE_BYTES
    rows = [(1, prose, "en"), (2, prose + " end", "en"), (3, "x" * (common.PIECE_BYTES + 50), "en"), (4, prose.upper(), "de"), (5, "short text", "de"), (6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_long_texts(spark, long_docs):
    docs, rows = long_docs
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    for i, text, _lang in rows:
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == frames.measures(text)
    keys = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    want = frames.removed([(i, t, keys[t]) for i, t, _ in rows])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(docs).collect()} == {i: want[i, t or ""] for i, t, _ in rows}
    sets = {i: frames.shingles(t) for i, t, _ in rows}
    groups = frames.components(sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.digest(docs).collect()} == {i: (len(sets[i]), min(groups[i])) for i in sets}
    items = [(1, " ".join(rows[0][1].split()[20_000:20_030])), (2, "short text")]
    plain = frames.contamination([(i, t) for i, t, _ in rows], items)
    found = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()} == {i: plain[i, t] for i, t, _ in rows}
    assert langid.languages(docs).count() == toxicity.toxicity_scores(docs, labels).count() == len(rows)
    scores = {r["doc_id"]: r for r in kneser_ney.perplexity_scores(docs, order=3).collect()}
    assert [scores[i]["n_tokens"] for i in (1, 2, 3, 4, 6)] == [30_001, 30_002, 2, 30_001, 1]


def test_columns_that_clash_with_internal_names(spark):
    text = " ".join(f"v{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, "a", "b", "c"), (2, text + " end", "a", "b", "c")], "doc_id long, text string, _spans string, _id string, _key string")
    got = substring.without_repeats(docs)
    assert got.schema == docs.schema
    assert {r["doc_id"]: (r["text"], r["_spans"], r["_id"], r["_key"]) for r in got.collect()} == {1: (text, "a", "b", "c"), 2: ("end", "a", "b", "c")}


# ---- language ----


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(langid.default_path(langid.VOCABULARY))


def test_words_of_any_length_are_summed_over_all_segmentations(pieces):
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces.number) + 1, 2)) * 1e-3
    word = "▁" + "ingthetionßonin" * 4
    assert len(word) > 60 > langid.PLAIN

    total = [np.ones(2)]
    for j in range(1, len(word) + 1):
        now = np.zeros(2)
        for i in range(j):
            q = pieces.number.get(word[i:j], pieces.unknown if j == i + 1 else None)
            if q is not None:
                now = now + prob[q] * total[i]
        total.append(now)
    lattice = langid.Lattice([word, "▁the"], pieces)
    assert np.allclose(lattice.log_totals(prob)[0], np.log(total[-1]), rtol=1e-12)
    counts = np.array([[1.0, 2.0], [3.0, 1.0]])
    short = langid.Lattice(["▁the"], pieces)
    alone = langid.Lattice([word], pieces)
    assert np.allclose(lattice.expected(prob, counts), short.expected(prob, counts[1:]) + alone.expected(prob, counts[:1]))
    expected, eps = alone.expected(prob, counts[:1]), 1e-6
    for q in (pieces.number["in"], pieces.unknown, pieces.number["t"]):
        more = prob.copy()
        more[q] *= 1 + eps
        assert np.allclose(((alone.log_totals(more) - alone.log_totals(prob)) / eps * counts[:1]).sum(0), expected[q], atol=1e-3)


def test_a_word_of_thousands_of_letters_has_a_finite_score(pieces):
    prob = np.full((len(pieces.number) + 1, 3), 1e-5)
    logs = langid.Lattice(["▁" + "thing" * 2_000], pieces).log_totals(prob)
    assert np.isfinite(logs).all() and (logs < -1000).all()


def test_chunks_cover_all_words_once(monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 100)
    words = ["a" * n for n in (1, 30, 24, 25, 500, 26, 3)]
    parts = list(langid.chunked(words))
    assert sorted(i for p in parts for i in p.tolist()) == list(range(7))
    assert all(len(p) == 1 or max(len(words[i]) for i in p) * len(p) <= 100 or max(len(words[i]) for i in p) <= langid.PLAIN for p in parts)


def test_texts_without_a_letter(spark):
    texts = ["½ ²", "①", "123 _", "...", "", None, "x½y", "the house"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, "the house of words and more words", "en") for i in range(9)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.languages(docs).collect()}
    assert [got[i]["lang_pred"] for i in range(8)] == ["und"] * 6 + ["en"] * 2
    assert [w for ws in langid.words_of("x½y Straße ①ab") for w in ws] == ["x", "y", "straße", "ab"]


def test_text_without_spaces_is_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", F.regexp_replace("text", r"\s+", "").alias("text"))
    learn = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lit(None).cast("long").alias("doc_id"), "lang", "text")
    got = langid.languages(docs.unionByName(learn)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()


