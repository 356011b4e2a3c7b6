"""Periodic runs, spelling variants and line deduplication against plain versions: nulls, copies, repeated rows, ties, long texts, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import lines, oracles, periodic, queries, spelling

from . import frames


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    long_line = " ".join(f"w{rng.randrange(50)}" for _ in range(60))
    more = [
        (500, "\n".join(["A shared line of more than twenty letters", long_line, "x"]), "en", "s", 1, 1, "z"),
        (501, " a shared line of MORE than twenty letters\t\n\nshort", "en", "s", 1, 1, "z"),
        (502, "a shared line of more than twenty letters\r\nnineteen letters 12\nzwanzig Zeichen äöüß .", "en", "s", 1, 1, "z"),
        (503, "zwanzig zeichen äöüß .\n" + long_line, None, "s", 1, 1, "z"),
        (504, "zwanzig zeichen äöüß .\n" * 3, None, "s", 1, 1, "z"),
        (505, ("again and again the same words of a line " * 9_000) + "\n" + long_line, "en", "s", 1, 1, "z"),  # more than 256 KB
        (506, " ".join(["remarkable"] * 40 + ["remarkible"] * 2 + ["remarkabl"] * 3), "en", "s", 1, 1, "z"),
        (507, "Größeres größeres größere größere größeren größeren x" * 2, "en", "s", 1, 1, "z"),
        (None, "a shared line of more than twenty letters", None, None, None, None, None),
    ]
    return frames.rows() + more


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, frames.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], frames.SCHEMA)


# ---- runs ----


def plain_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            s = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - s >= max(q, least - q):
                out.setdefault((s - q, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_against_plain_search():
    rng = random.Random(1)
    for t in range(600):
        kinds, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.choice([0, 1, 5, 13, 40, 100, 200, 400])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 20 else 0):
            a, p = rng.randrange(n), rng.randrange(1, 60)
            for i in range(a, min(n, a + rng.randrange(10, 240))):
                w[i] = w[a + (i - a) % p]
        if t % 3 == 0:
            w = w[:30] * rng.randrange(1, 9) + w[30:]
        assert [tuple(map(int, r)) for r in zip(*periodic.find_runs(np.array(w, np.int64)), strict=True)] == plain_runs(w)


def test_runs_of_a_text_that_repeats_all_over_stay_cheap():
    block = ([*range(10)] * 1000 + [77, 78]) * 10
    start, length, period = periodic.find_runs(np.array(block))
    assert (start[np.argmax(length)], length.max(), period[np.argmax(length)]) == (0, len(block), 10_002)
    assert Counter(period.tolist()) == {10: 10, 10_002: 1}


def test_words_that_polynomial_hashes_confuse_are_no_period():
    """The Thue-Morse word and its mirror have one polynomial hash modulo 2^64 under every base; windows are named exactly, so nothing follows."""
    sign = [bin(i).count("1") & 1 for i in range(2048)]
    w = sign + [1 - x for x in sign]
    assert [tuple(map(int, r)) for r in zip(*periodic.find_runs(np.array(w)), strict=True)] == plain_runs(w)


def plain_collapse(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_period_digest(docs, rows):
    want = Counter()
    for r in rows:
        w = plain_collapse(r[0], r[1])
        if len(w) > 20_000:
            continue
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[r[0], len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(w)] += 1
    got = Counter(map(tuple, periodic.digest(docs).collect()))
    assert Counter({k: n for k, n in got.items() if k[-1] <= 20_000}) == want
    long = next(k for k in got if k[-1] > 20_000)
    assert long[:5] == (505, 1, 0, 81_000, 9) and long[5] == 9_000_000
    assert sum(k[1] > 0 for k in want) >= 5


# ---- spelling ----


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n, len(close[w]), form[w], form[w] and words[form[w]], root(w)) for w, n in words.items()}


def plain_counts(rows):
    out = Counter()
    for doc_id, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = frames.lower(w)
            h = None if doc_id is None else zlib.crc32(f"{doc_id}:{w}".encode())
            out[w if h is None or h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return out


def test_variants_of_documents(docs, rows):
    got = spelling.digest(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants(plain_counts(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(x[3] for x in want)


@pytest.mark.parametrize("block", [50_000, 8])
def test_variants_of_dense_vocabularies(spark, monkeypatch, block):
    """Words over few letters, all with one start, chains of forms, ties; with small blocks every bucket is split over many indexes."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    monkeypatch.setattr(spelling, "SEARCH_WORDS", 16)
    rng = random.Random(4)
    counts = {"abc" + "".join(rng.choice("abé") for _ in range(rng.choice([4, 4, 5, 6, 40]))): rng.choice([1, 2, 2, 3, 30, 400, 5000]) for _ in range(300)}
    counts |= {"zzzzzzz": 2, "zzzzzzzz": 20, "zzzzzzzzz": 200, "zzzzzzzzzz": 2000, "short": 9, "a" * 3000: 2, "a" * 2999 + "b": 70}
    frame = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long").repartition(4)
    got = spelling.spelling_variants(frame).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_variants(counts)


def test_index_finds_every_pair_once():
    rng = random.Random(2)
    for _ in range(40):
        letters = rng.choice(["ab", "abc", "abcdeé"])
        words = list({"".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 9, 12, 30]))) for _ in range(120)})
        index = spelling.Index([w[::-1] for w in words])
        q, t = spelling.near(index, words, np.array([len(w) // 2 for w in words]))
        want = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b) and b[: len(a) // 2] == a[: len(a) // 2])
        assert sorted(zip(q.tolist(), t.tolist(), strict=True)) == want


# ---- lines ----


def plain_lines(rows):
    holders = defaultdict(list)
    key = lambda line: frames.lower(line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: -(1 << 63) if i is None else i
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            holders[k].append(rank(r[0]))
    out = Counter()
    for r in rows:
        all_lines = (r[1] or "").split("\n")
        kept = [x for x in all_lines if len(k := key(x)) < 20 or len(holders[k]) < 3 or rank(r[0]) == max(holders[k])]
        out[r[0], len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("keys", [1 << 20, 2])
def test_lines(docs, rows, monkeypatch, keys):
    monkeypatch.setattr(lines, "SHARD_KEYS", keys)  # 2: many shards, some of them empty
    monkeypatch.setattr(lines, "FLUSH_KEYS", 4)
    monkeypatch.setattr(lines, "PROBE_BYTES", 3000)
    monkeypatch.setattr(lines, "OPEN_SHARDS", 3)
    want = plain_lines(rows)
    assert Counter(map(tuple, lines.digest(docs).collect())) == want
    assert sum(n for k, n in want.items() if k[2]) >= 4


def test_lines_of_rows_without_ids(spark):
    line = "nobody but rows without an id has this line"
    docs = spark.createDataFrame([(None, line)] * 3 + [(None, f"{line}\nand another that stands in one row only")], "doc_id long, text string")
    assert {r["n_dropped"] for r in lines.digest(docs).collect()} == {0}


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        names = np.random.default_rng(n).integers(0, 1 << 64, (n, 2), np.uint64)
        table = lines.build_hash(names[:, 0], names[:, 1])
        assert sorted(lines.places(table, names[:, 0], names[:, 1])) == list(range(n))
        assert sum(x.nbytes for x in table) * 8 <= 4.5 * n + 1000
        other = lines.places(table, ~names[:, 0], names[:, 1])
        assert ((other >= -1) & (other < max(n, 1))).all()


# ---- all ----


def test_empty_tables(empty):
    assert periodic.digest(empty).count() == 0
    assert spelling.digest(empty).count() == 0
    assert lines.digest(empty).count() == 0


def test_sql_is_registered():
    assert {"op11_periodic_runs", "op12_spelling_variants", "op13_line_dedup"} <= set(queries.SQL)
    assert queries.SQL["op13_line_dedup"] == oracles.LINES


def test_null_texts_and_clashing_columns(docs, rows):
    got = periodic.periodic_runs(docs.withColumn("runs", F.lit(1)).withColumn("n_words", F.lit(1))).where("collapsed_text is null").count()
    assert got == 0
    assert lines.dedup_lines(docs.withColumn("high", F.lit(1)).withColumn("last", F.lit(1))).count() == len(rows)
