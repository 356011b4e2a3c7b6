"""Every operator against a plain version on small frames with nulls, copies, repeated rows, odd and long texts and clashing columns; and on empty tables."""

from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import common, decontam, jaccard, kneser_ney, langid, packing, quality, queries, substring, token_files, tokens, toxicity, url_cascade
from meterlake.llm.components import components

from . import frames


@pytest.fixture(scope="module")
def rows():
    return frames.rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, frames.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], frames.SCHEMA)


def test_substring_dedup(spark, docs, rows, monkeypatch):
    keys = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    want = frames.removed([(r[0], r[1], keys[r[1]]) for r in rows])
    monkeypatch.setattr(substring, "RUN", 16)
    for hot in (16, 0):  # 0: windows of every minimiser that a task meets travel alone
        monkeypatch.setattr(substring, "LOCAL_HOT", hot)
        got = substring.dedup_substrings(docs).select("doc_id", "text_key", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()
        assert len(got) == len(rows)
        text = {k: t for t, k in keys.items() if t is not None}
        for r in got:
            assert (r["n_words"], r["n_removed"], r["h"]) == want[r["doc_id"], text.get(r["text_key"], "")], r
    assert any(v[1] for v in want.values())


def test_without_repeats_keeps_columns_and_untouched_texts(docs, rows):
    got = substring.without_repeats(docs)
    assert got.schema == docs.schema
    out = {(r["doc_id"], r["source"]): r for r in got.collect()}
    same = sum(out[r[0], r[3]]["text"] == r[1] for r in rows if (r[0], r[3]) in out)
    assert same > 20
    assert all(r["n_chars"] == len(r["text"]) for r in out.values() if r["text"] and r["n_chars"] not in (None, 3))


def test_jaccard_components(docs, rows):
    sets = {i: frames.shingles(r[1]) for i, r in enumerate(rows)}
    groups = frames.components(sets)
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in groups[i] if rows[j][0] is not None]
        want[r[0], len(sets[i]), min(ids) if sets[i] and ids else r[0]] += 1
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.digest(docs).collect())
    assert got == want


def test_jaccard_finds_links_that_no_star_sees(spark, monkeypatch):
    """Chains of near copies, salted columns, small blocks and small sides give the same components."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = []
    for k in range(60):
        w = list(base)
        for at in rng.integers(0, 200, 1 + k % 9):
            w[at] = f"v{k}x{at}"
        texts.append(" ".join(w))
    chain = [f"c{x}" for x in range(120)]
    for _ in range(12):
        chain = chain[3:] + [f"d{rng.integers(1 << 30)}" for _ in range(3)]
        texts.append(" ".join(chain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    groups = frames.components({i: frames.shingles(t) for i, t in enumerate(texts)})
    for block, side, column, narrow in ((256, 512, 100_000, 64), (3, 5, 7, 4)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "SIDE", side)
        monkeypatch.setattr(jaccard, "COLUMN", column)
        monkeypatch.setattr(jaccard, "NARROW", narrow)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.digest(docs).collect()}
        assert got == {i: min(g) for i, g in groups.items()}


def test_jaccard_sends_no_rows_that_cannot_link(spark, monkeypatch):
    """Texts of the same few passages share columns but are far apart: none is sent to a block of the product."""
    rng = np.random.default_rng(6)
    passages = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 30)) for _ in range(24)]
    texts = [" ".join(passages[k] for k in rng.permutation(24)[:8]) for _ in range(150)]
    texts += [texts[3] + " more", texts[4] + " words"]
    sent, write = {}, jaccard.stored_alone

    def seen(df, name):
        out = write(df, name)
        sent[name] = sent.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stored_alone", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.digest(docs).collect()}
    assert got == {i: min(g) for i, g in frames.components({i: frames.shingles(t) for i, t in enumerate(texts)}).items()}
    assert sent["pairs"] < 10 and sent["clusters"] < 10


def test_signatures_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(7)
    sets = []
    for size in (1, 2, 60, 64, 65, 90, 700, 1000, 3000, 3500):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for k in range(4):
            sets.append(np.unique(np.concatenate([base[k * size // 9 :], rng.integers(0, 1 << 63, k).astype(np.uint64)])))
    near = jaccard.Signatures([jaccard.signature(x) for x in sets])
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    true = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)])
    apart = near.apart(i, j)
    assert (apart <= true).all() and (apart[i == j] == 0).all()
    assert (apart[(true > 100) & (true < 1500)] > 20).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_decontamination(spark, docs, rows):
    words = [t.split() for t in frames.texts() if t and len(t.split()) > 40]
    items = [(1, " ".join(words[0][5:40])), (2, " ".join(words[1][:13]).upper()), (3, "an the"), (None, " ".join(words[2][3:9])), (5, None), (6, "..."), (7, "ou"), (1, " ".join(words[3][:20]))]
    bench = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, n_words long, pos long")
    want = frames.contamination([(r[0], r[1]) for r in rows], items)
    got = decontam.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    by_key = {r["text_key"]: None for r in got}
    for r in docs.select("text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k")).collect():
        by_key[r["k"]] = r["text"]
    by_key[0] = None
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[r["doc_id"], by_key[r["text_key"]]]
    assert any(v[4] for v in want.values())
    none = decontam.contamination(docs, bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(rows))


def test_decontamination_is_native(spark, docs):
    plan = decontam.contamination(docs, spark.createDataFrame([(1, "an the ou")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tokens_match_the_library(rows):
    tk = tokens.WordTokenizer(tokens.default_path())
    odd = ["don't it's we'll 'S x's", "<|endoftext|> a<|endoftext|>b <|STARTOFTEXT|>", "A.B. ...x!! é!! İstanbul İ.", "á́. a≠ .̸", "漢字。かな！a。 한국어", "ªº ǅ ﬁ ΑΣ Σ ß ẞ", "x" * 50_000 + " y", "word " * 300_000]
    for t in [*odd, *(r[1] for r in rows)]:
        want = tk.tokenizer.encode(t, add_special_tokens=False).ids if t else []
        assert tk.encode([t])[0].tolist() == want, t


def _ids(text):
    return tokens.tokenizer(tokens.default_path()).encode([text])[0].tolist()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, docs, rows, encoding, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, path, encoding=encoding, partitions=3)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    for r, w in zip(got, want, strict=True):
        assert r["ids"] == [*_ids(w[1]), 2] and r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += len(r["ids"])
    digest = token_files.token_file_digest(docs).collect()
    assert Counter(r["ids_crc32"] for r in digest) == Counter(zlib.crc32(np.array([*_ids(r[1]), 2], "<u4").tobytes()) for r in rows)


def test_token_files_have_pages_and_indexes(docs, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_token_files(docs, f"file://{tmp_path}/files", partitions=1)
    meta = pq.ParquetFile(next((tmp_path / "files").glob("part-*.parquet"))).metadata.row_group(0)
    ids = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema.startswith("ids"))
    assert ids.has_offset_index and any(e.endswith("DICTIONARY") for e in ids.encodings)


def test_packing(docs, rows):
    got = packing.pack(docs, window=64).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    want = Counter()
    for r in rows:
        ids = np.array([*_ids(r[1]), 1], "<u4")
        for s in range(0, len(ids), 64):
            want[r[0], s, zlib.crc32(ids[s : s + 64].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    waste = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
        waste += packing.padding(at, 64)
    assert waste < 128


def test_fill_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = Counter(rng.integers(1, 40, rng.integers(1, 9)).tolist())
        first, window = max(counts), 64
        got = packing.fill(dict(counts), first, window)
        sums = {first}
        left = counts.copy()
        left[first] -= 1
        for length in left.elements():
            sums |= {x + length for x in sums if x + length <= window}
        total = sum(k * n for k, n in got.items())
        assert all(n <= counts[k] for k, n in got.items()) and total in sums
        assert packing.padding(total, window) == min(packing.padding(x, window) for x in sums)


def test_language_forward_algorithm_and_accuracy(spark):
    pieces = langid.Pieces(langid.default_path(langid.VOCABULARY))
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces.number) + 1, 2)) * 1e-3

    def brute(w):
        total = np.zeros(2) if w else np.ones(2)
        for j in range(1, len(w) + 1):
            q = pieces.number.get(w[:j], pieces.unknown if j == 1 else None)
            if q is not None:
                total = total + prob[q] * brute(w[j:])
        return total

    words = ["▁the", "▁onin", "▁ßüç", "ing", "▁"]
    lattice = langid.Lattice(words, pieces)
    assert np.allclose(lattice.totals(prob), [brute(w) for w in words])
    counts = np.array([[1.0, 2.0]] * len(words))
    expected = lattice.expected(prob, counts)
    eps = 1e-6  # an expected number is the derivative of the log probability by the piece's log probability
    for q in (pieces.number["▁"], pieces.number["in"], pieces.unknown):
        more = prob.copy()
        more[q] *= 1 + eps
        slope = ((np.log(lattice.totals(more)) - np.log(lattice.totals(prob))) / eps * counts).sum(0)
        assert np.allclose(slope, expected[q], atol=1e-4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_language_edges(spark, docs, empty, rows):
    got = langid.languages(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] is not None and not any(c.isalpha() for c in next(x[1] for x in rows if x[0] == r["doc_id"]) or "")} == {"und"}
    assert langid.languages(empty).count() == 0
    nothing = langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


def test_toxicity_learns_and_generalises(spark):
    rng = np.random.default_rng(2)
    made = lambda: " ".join("".join(rng.choice(["an", "re", "to", "li", "mo"], 3)) for _ in range(60))
    bad = ["wretched", "wretchedly", "scoundrel", "scoundrels"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = made().split()
        if toxic:
            for at in rng.integers(0, 60, 4):
                words[at] = bad[rng.integers(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    rows += [(900, made() + " wretchhed scoundrell wretchedd"), (901, None), (902, ""), (903, made()), (None, made())]
    labels += [(901, None, 1), (None, 1, 1), (5, 0, 0), (5, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash")).withColumn("score", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity_scores(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum((r["score"] > 0.5) == (r["doc_id"] % 3 == 0) for r in held) >= 0.97 * len(held)
    assert by[900]["predicted"] == 1 and by[903]["predicted"] == 0
    assert by[901]["score"] == by[902]["score"]
    assert toxicity.toxicity_scores(docs, marks.limit(0)).agg(F.max("score")).first()[0] == 0.5


def test_toxicity_fit_holds_the_sample_once():
    rng = np.random.default_rng(3)
    index = [np.unique(rng.integers(0, 1 << 14, 3000).astype(np.int32)) for _ in range(640)]
    value = [np.full(len(i), 1 / len(i), np.float32) for i in index]
    tracemalloc.start()
    toxicity.train(np.arange(640) % 2, index, value, buckets=1 << 14, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * sum(map(len, index))  # ten bytes an entry, and a batch's own arrays


def test_tasks_give_back_what_earlier_ones_freed():
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    np.ones(4 << 20, np.uint8)  # from here on the C library takes pieces of this size from its own heap
    held = [(np.ones(300_000, np.uint8), np.ones(100_000, np.uint8)) for _ in range(400)]
    left = [b for _, b in held]
    del held
    before = resident()
    assert list(common.small([])) == []
    assert before - resident() > 50 << 20 and len(left) == 400


def test_quality_measures_and_bounds(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    want = Counter((r[0], *frames.measures(r[1])) for r in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # so few labels certify no cutoff
    assert quality.judge(empty, labels).count() == 0


def test_exact_binomial_bound():
    tail = quality.binomial_tail(3, 40, 0.2)
    assert math.isclose(tail, sum(math.comb(40, k) * 0.2**k * 0.8 ** (40 - k) for k in range(4)))
    assert quality.certified([0, 0, 9], 2000, 0.005, 0.01) == 2
    assert quality.certified([0], 0, 0.1, 0.1) == 0


def test_quality_rejects_bad_and_keeps_good(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 5 == 0
        words = [f"w{x}" + ("###" if bad else "") for x in rng.integers(0, 10**6, 30)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad)))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 != 0) for r in got)
    assert {r["rejected_by"] for r in got} == {None, "symbols"}


def test_kneser_ney_against_plain_counts(spark, docs, rows, empty):
    every = [(r[0], frames.lower(r[1]).encode().split() + ["</s>"]) for r in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    uni, bi = Counter(), Counter()
    for i, w in every:
        if not held(i):
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
    total, v = sum(uni.values()), len(uni)
    before, context = Counter(b for _, b in bi), Counter()
    kinds = {k: Counter() for k in (1, 2, 3)}
    for (a, _b), c in bi.items():
        context[a] += c
        kinds[min(c, 3)][a] += 1
    count = lambda x: np.array([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)])
    d, e = kneser_ney.discounts(count(bi)), kneser_ney.discounts(count(before))
    low = lambda c, x: x[min(c, 3) - 1] if c else 0
    mass = sum(low(c, e) for c in before.values()) / len(bi)
    want = Counter()
    for i, w in every:
        s = b = 0.0
        for a, x in zip(["<s>", *w], w, strict=False):
            p = max(before[x] - low(before[x], e), 0) / len(bi) + mass / (v + 1)
            if context[a]:
                p = max(bi[a, x] - low(bi[a, x], d), 0) / context[a] + sum(d[k - 1] * kinds[k][a] for k in (1, 2, 3)) / context[a] * p
            s += math.log10(p)
            b += math.log10((uni[x] + 0.1) / (total + 0.1 * (v + 1)))
        want[i, held(i), len(w), sum(uni[x] > 0 for x in w), total, round(b, 6), round(s, 6)] += 1
    got = kneser_ney.perplexity_scores(docs).collect()
    assert Counter((*r[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert kneser_ney.perplexity_scores(empty).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_kneser_ney_of_higher_order_against_plain_counts(docs, rows, empty, order):
    every = [(r[0], frames.lower(r[1]).encode().split() + ["</s>"]) for r in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    padded = lambda w: ["<s>"] * (order - 1) + w
    grams = {n: Counter() for n in range(1, order + 1)}
    uni = Counter()
    for i, w in every:
        if not held(i):
            uni.update(w)
            x = padded(w)
            grams[order].update(tuple(x[k : k + order]) for k in range(len(w)))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    v = len(uni)
    d = {n: kneser_ney.discounts(np.array([sum(c == k for c in grams[n].values()) for k in (1, 2, 3, 4)])) for n in grams}
    low = lambda c, x: x[min(c, 3) - 1] if c else 0
    total, left = {n: Counter() for n in grams}, {n: Counter() for n in grams}
    for n in grams:
        for g, c in grams[n].items():
            total[n][g[:-1]] += c
            left[n][g[:-1]] += low(c, d[n])

    def p(n, g):
        lower = p(n - 1, g[1:]) if n > 1 else 1 / (v + 1)
        t = total[n][g[:-1]]
        return max(grams[n][g] - low(grams[n][g], d[n]), 0) / t + left[n][g[:-1]] / t * lower if t else lower

    want = Counter()
    for i, w in every:
        x = padded(w)
        s = sum(math.log10(p(order, tuple(x[k : k + order]))) for k in range(len(w)))
        want[i, held(i), len(w), round(s, 6)] += 1
    got = kneser_ney.perplexity_scores(docs, order=order).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], round(r["score"], 6)) for r in got) == want
    assert kneser_ney.perplexity_scores(empty, order=order).count() == 0


def test_kneser_ney_query_uses_two_words_of_context(spark, docs, monkeypatch):
    asked = {}
    monkeypatch.setattr(queries, "_read", lambda *_: docs)
    monkeypatch.setattr(kneser_ney, "perplexity_scores", lambda _docs, **kw: asked.update(kw))
    queries.op10_kneser_ney(spark, "")
    assert asked == {"order": 3}


def test_kneser_ney_counts_above_a_byte():
    counts = np.array([0, 1, 254, 255, 256, 70_000, 1 << 40], np.uint64)
    at = np.array([6, 3, 0, 2, 5, 4, 1, 3])
    assert (kneser_ney._expand(kneser_ney._compact(counts), at) == counts[at]).all()


def test_kneser_ney_keys_are_found():
    rng = np.random.default_rng(5)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, 30_000, np.uint64), np.uint64(7 << 48) + np.arange(0, 900, 3, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    asked = np.unique(np.concatenate([keys[::3], keys + np.uint64(1), keys - np.uint64(1)]))
    at, found = kneser_ney._find(kneser_ney._key_arrays(keys), asked)
    assert (found == np.isin(asked, keys)).all()
    assert (keys[at[found]] == asked[found]).all()


def test_url_cascade(spark):
    urls = ["https://www.example.com/en/1", "http://a.example.com/en/x?y#z", "http://EXAMPLE.com/EN/", "http://x.net/es/", "http://x.net/e", "net://net/fr/?q", "http://com", "http://com/", "http://casino.org/a", "http://a.casino-b.com/", "nothing", "", None, "http://", "a://b://c/d", "http://xnet/es/", "http://É.net/es/ü", "http://x.net/es", "http://a.com/\nb"]
    pages = spark.createDataFrame([(i % 17, u, "clash") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host, path = frames.lower(rest[:cut]), rest[cut:]
        path = path[: min([k for k in map(path.find, "?#") if k >= 0], default=len(path))]
        fits = [r for r in url_cascade.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        listed = best[2] == "block" if best else bool(set(host.replace("-", ".").split(".")) & set(url_cascade.LISTED_LABELS))
        return host, path, best and best[0] + best[1], "block" if listed else "allow"

    want = Counter((i % 17, *judged(u)) for i, u in enumerate(urls * 2))
    for bits in (url_cascade.MAX_BITS, 8):  # 8: judged in several passes
        got = url_cascade.judge_urls(pages, url_cascade.keys_with_labels(pages), max_bits=bits)
        assert Counter(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
    assert url_cascade.judge_urls(pages.limit(0), url_cascade.keys_with_labels(pages)).count() == 0
    listed = spark.createDataFrame([("h7.org", "/p1"), ("h7.org", "/p1"), ("not.in.the.corpus", "/"), (None, "/"), ("a.com", "/x")], "host string, prefix string")
    many = spark.createDataFrame([(i, f"http://h{i % 50}.org/p{i % 3}") for i in range(400)] + [(400, "http://a.com/x")], "page_id long, url string")
    for bits in (url_cascade.MAX_BITS, 8):  # a table of keys decides where no rule does
        judged_many = {r["page_id"]: r["verdict"] for r in url_cascade.judge_urls(many, listed, max_bits=bits).collect()}
        assert judged_many == {i: "block" if i % 50 == 7 and i % 3 == 1 else "allow" for i in range(400)} | {400: "allow"}


def test_cascade_is_exact(spark):
    for every in (3, 50, 10**6):
        universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(every)) == 0).alias("listed"))
        levels = url_cascade.build(universe)
        assert universe.where(url_cascade.is_listed(F.col("key"), levels) != F.col("listed")).count() == 0


def test_empty_tables(spark, empty):
    assert substring.digest(empty).count() == 0
    assert jaccard.digest(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert token_files.token_file_digest(empty).count() == 0
    assert decontam.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert toxicity.toxicity_scores(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_orders_of_grams_and_hashes():
    rng = np.random.default_rng(8)
    for rows, top in ((0, 9), (1, 9), (500, 3), (5000, 1 << 20), (5000, 1 << 32), (70_000, 1 << 31)):
        packed = [rng.integers(0, top, rows).astype(np.uint64) << np.uint64(32) | rng.integers(0, 4, rows).astype(np.uint64), rng.integers(0, top, rows).astype(np.uint64)]
        assert (kneser_ney._order(packed) == np.lexsort(packed[::-1])).all()
        for keys in (packed[1], rng.integers(0, 1 << 64, rows, dtype=np.uint64) >> np.uint64(rows % 60)):
            assert (kneser_ney._hash_order(keys) == np.argsort(keys, kind="stable")).all()
            values, first, inverse = kneser_ney._distinct(keys)
            assert (values[inverse] == keys).all() and (keys[first] == values).all() and (values[1:] > values[:-1]).all()


def test_blobs_of_grams_press_well():
    """Sorted pairs of words and the third word take well below their 13 bytes, and come back as they were."""
    rng = np.random.default_rng(9)
    words = lambda: np.minimum(rng.zipf(1.3, 50_000), 1 << 20).astype(np.uint64)
    packed, counts = kneser_ney._merged_grams([words() << np.uint64(32) | words(), words()], [np.ones(50_000, np.uint8)])
    ((_shard, blob),) = kneser_ney._gram_blobs(3, np.zeros(len(packed[0]), np.int64), packed, counts)
    got, fields = kneser_ney._grams_of([blob, blob], 3)
    assert all((np.concatenate([x, x]) == y).all() for x, y in zip([*packed, *counts], [*got, *fields], strict=True))
    assert len(blob) < 2.5 * len(packed[0])
