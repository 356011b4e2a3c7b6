"""Periodic runs of words, found by a sparse dynamic programme over diagonals.

A diagonal is a lag; its cell at word i is the number of words up to i that equal the word a lag before. Only cells of equal words exist. A run with
period q is a diagonal q that ends with q matches or more, so with q words that are matched in one stretch.

Lags below ``SHORT`` are run through word by word, all words at once. A longer lag between 2L and 4L needs at least 2L matches, so its diagonal
covers a whole block of L words (L a power of two, blocks at multiples of L). There the programme steps by blocks: the earlier
occurrences of a block at such lags open a diagonal or extend the open one of that lag by L words; where the next block does not
occur at the lag, the diagonal ends, and its two ends, less than a block away, are found by halving. So a text of n words costs about
n log n also where it repeats one line all over; by single words that would be the square. Windows are named exactly, by ranks
of pairs of half windows; nothing is decided by a hash.

A diagonal whose lag is a multiple of a run's smallest period gives the same words again, so of equal stretches the smallest lag stays.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small

LEAST = 12
#: Lags below this are compared word by word.
SHORT = 8
#: Words that are searched together; a longer text is searched alone.
CHUNK_WORDS = 300_000

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"


def _repeated(key: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names for the places ``at`` by their ``key``: equal keys have one name from 0 on, all other places names of their own below 0; and the sorted
    values ``name * n + place`` of the named places."""
    name = -1 - np.arange(n)
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    cut = np.flatnonzero(new)
    size = np.diff(np.append(cut, len(key)))
    group = np.repeat(np.arange(len(cut)), size)
    often = np.repeat(size > 1, size)
    group, at = group[often], at[often]
    name[at] = group
    return name, group * n + at


def _ends(names: list[np.ndarray], x: np.ndarray, lag: np.ndarray, step: int, n: int) -> np.ndarray:
    """How many words beyond ``x`` (before it where ``step`` is -1) still equal those a lag before, below the length of a block."""
    more = np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        p = x + more if step > 0 else x - more - (1 << k)
        ok = (p < n) & (p >= lag)
        q = np.where(ok, p, 0)
        ok &= (names[k][q] >= 0) & (names[k][q] == names[k][np.where(ok, p - lag, 0)])
        more += ok.astype(np.int64) << k
    return more


def find_runs(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every maximal run of ``least`` words and two periods at least, by start, then period.

    ``ids`` are whole numbers, equal for equal words. Linear memory per doubling of the longest repeated window."""
    n = len(ids)
    found = []
    for lag in range(1, min(SHORT, n)):
        same = ids[lag:] == ids[:-lag]
        edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
        start, matched = edge[::2], edge[1::2] - edge[::2]
        keep = matched >= max(lag, least - lag)
        found.append((start[keep], matched[keep] + lag, np.full(int(keep.sum()), lag)))
    name, places = _repeated(np.asarray(ids, np.int64), np.arange(n), n)
    names, block = [name], 1
    while len(places) and 4 * block <= n:
        if 2 * block >= SHORT:
            x = np.arange(0, n, block)
            x = x[name[x] >= 0]
            lo = np.searchsorted(places, name[x] * n + np.maximum(x - 4 * block + 1, 0))
            hi = np.searchsorted(places, name[x] * n + np.maximum(x - 2 * block, -1), side="right")
            size = np.maximum(hi - lo, 0)
            x = np.repeat(x, size)
            y = places[np.arange(len(x)) + np.repeat(lo - (np.cumsum(size) - size), size)] % n
            lag = x - y
            order = np.lexsort((x, lag))
            x, lag = x[order], lag[order]
            opens = np.ones(len(x), bool)
            opens[1:] = (lag[1:] != lag[:-1]) | (x[1:] != x[:-1] + block)
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(x)) - 1
            lag, first, last = lag[first], x[first], x[last[: len(first)]] + block
            first = first - _ends(names[:-1], first, lag, -1, n)
            last = last + _ends(names[:-1], last, lag, 1, n)
            keep = last - first >= np.maximum(lag, least - lag)
            found.append((first[keep] - lag[keep], last[keep] - first[keep] + lag[keep], lag[keep]))
        at = np.flatnonzero((name[:-block] >= 0) & (name[block:] >= 0))
        name, places = _repeated(name[at] * n + name[at + block], at, n)
        names.append(name)
        block *= 2
    start, length, period = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[own], length[own], period[own]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _search(texts: list[list[bytes]], least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``find_runs`` of several texts at once; a word of its own stands behind each."""
    known: dict[bytes, int] = {}
    number = count()
    ids, starts, total = [], [], 0
    for words in texts:
        starts.append(total)
        ids.append(np.fromiter(map(known.setdefault, words, number), np.int64, len(words)))
        ids.append(np.array([-1 - total], np.int64))
        total += len(words) + 1
    start, length, period = find_runs(np.concatenate(ids), least)
    cuts = np.searchsorted(start, [*starts, total])
    return [(start[a:b] - s, length[a:b], period[a:b]) for s, a, b in zip(starts, cuts[:-1], cuts[1:], strict=True)]


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    if not len(start):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()])


def _finder(least: int):
    def run(batches):
        ids, texts, held = [], [], 0

        def found():
            runs = _search(texts, least)
            flat = [np.concatenate([r[k] for r in runs]) for k in range(3)]
            offsets = np.cumsum([0, *(len(r[0]) for r in runs)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in flat], fields=list(RUN)))
            kept = pa.array([_collapsed(w, *r) for w, r in zip(texts, runs, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), lists, kept.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"])

        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text.split() if text else [])
                held += len(texts[-1])
                if held >= CHUNK_WORDS:
                    yield found()
                    ids, texts, held = [], [], 0
        if ids:
            yield found()

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed_text`` for every row of ``docs``, in one narrow pass without a shuffle.

    ``runs`` lists (start, length, period) of each maximal stretch of words with that smallest period, of two periods and ``least`` words at least, by
    start, then period. ``collapsed_text`` are the words, joined by one space, without those that a run covers behind its first
    period. Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, no runs and an empty collapsed text. Null and repeated ids are rows
    like any other; other columns are not read. A very long text is searched whole, by one task, in memory of about 8 bytes a word for each doubling
    of its longest repeated window."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_finder(least), OUT)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where every tenth document, by crc32 of its id, repeats a period from some word on; a null id is left alone."""
    text = F.col("text").cast("string")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(h % 10 == 0, F.lit(False)).alias("hit"), F.floor(h / 10).alias("g"))
    base = base.withColumn("w", F.when(F.col("hit"), words)).withColumn("n", F.size("w").cast("long"))
    base = base.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    base = base.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    moved = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return base.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(moved, " ")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from the runs and collapsed texts of the planted documents."""
    found = periodic_runs(planted(docs))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"), "n_words",
    )
