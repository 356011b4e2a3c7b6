"""Spelling variants by approximate search in FM-indexes of the vocabulary.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Then one half of the first word stands unchanged at the same
end of the second: the left half in front, or the right half behind. So each word is searched twice, by two search schemes:

* left half exactly, from the start of a word, then on to the right over the other half with one error, to the end of a word;
* right half exactly, from the end of a word, then on to the left over the other half with one error, to the start of a word.

Each direction has an index of its own over the delimited vocabulary: the second over the words, the first over the words read backwards. As both ends
are delimiters, no scheme changes its direction after its exact half, so a step narrows one interval of suffix ranks, and the other
index's interval needs no tracking. A step with a given symbol is two ranks; the symbols that may be an error are read
off the interval's rows, once for all words that share the interval.

The vocabulary is dealt by the first (last) code points of the words that every exact half covers, so a word is searched only where words with its half
are. Where more than ``BLOCK_WORDS`` words share them, they are dealt over several indexes, and the searched words go to each of these.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, pieces, prepare, small, stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word's form is at least so many times as frequent.
FACTOR = 10
#: One run in so many loses a code point before it is counted (0: none does).
DAMAGE = 31
#: Words of one index at most, but for the last bucket that is added to it.
BLOCK_WORDS = 50_000
#: Words that are searched together.
SEARCH_WORDS = 16_384
#: Distinct words that a task combines before it ships them.
FLUSH_WORDS = 400_000
BROADCAST_ROWS = 100_000
LETTERS = "A-Za-zÀ-ÿ"


# ---- counting ----------------------------------------------------------------------------------------------------------------


def _counter(letters: str, least: int, damage: int):
    def run(batches):
        runs = re.compile(f"[{letters}]{{{least},}}")
        total: Counter[str] = Counter()
        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                own: Counter[str] = Counter()
                for piece in pieces(text.lower()):  # bytes.lower changes A-Z only
                    own.update(runs.findall(piece.decode()))
                if damage and doc_id is not None:
                    seed = zlib.crc32(b"%d:" % doc_id)
                    hit = {w: h for w in own if not (h := zlib.crc32(w.encode(), seed)) % damage}
                    for w, h in hit.items():
                        n, at = own.pop(w), h % len(w)
                        if len(w) > least:
                            total[w[:at] + w[at + 1 :]] += n
                for w, n in own.items():
                    total[w] += n
            if len(total) >= FLUSH_WORDS:
                yield _counts(total)
                total = Counter()
        if total:
            yield _counts(total)

    return run


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, least_length: int = LEAST_LENGTH, damage: int = 0) -> DataFrame:
    """``word, n``: the runs of ``letters`` of all texts, A-Z lower-cased, with at least ``least_length`` code points, and how often they occur.

    With ``damage``, a run of a document whose crc32 of ``<id>:<run>`` it divides loses one code point before it is counted; runs of a null id never do."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter(letters, least_length, damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- index -------------------------------------------------------------------------------------------------------------------


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and where each word starts (and the last one ends)."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return code, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


class Index:
    """FM-index of a list of different words, each with a delimiter behind it; the delimiters are ordered by word.

    Symbols are numbered from 1, a delimiter is 0. The delimiters' suffixes come first, so a step from the rows [lo, hi) with symbol c leads to the rows
    ``words + number of symbols below c + rank of c``: the places that the sorted (symbol, row) pairs give at once."""

    def __init__(self, words: list[str]):
        code, starts = _flat(words)
        self.alphabet, symbol = np.unique(code, return_inverse=True)
        length = np.diff(starts)
        self.words = len(words)
        text = np.zeros(len(code) + len(words), np.int64)  # the words, each with its delimiter
        text[np.arange(len(code)) + np.repeat(np.arange(len(words)), length)] = symbol + 1
        rank = self._suffix_ranks(text)
        self.rows = len(text)
        start = starts[:-1] + np.arange(len(words))
        before = np.concatenate([[0], text[:-1]]) if len(text) else text
        bwt = np.empty(len(text), np.int64)
        bwt[rank] = before
        self.bwt, self.following = bwt, np.zeros(len(text), np.int64)
        self.following[rank[1:]] = rank[:-1]
        symbols = np.flatnonzero(bwt)
        self.pairs = bwt[symbols] * self.rows + symbols
        self.pairs.sort()
        self.first_row = np.sort(rank[start])  # rows of whole words
        self.first_word = np.argsort(rank[start])

    @staticmethod
    def _suffix_ranks(text: np.ndarray) -> np.ndarray:
        """Ranks of all suffixes, each up to its delimiter; equal ones by place."""
        n = len(text)
        if not n:
            return text
        bits = int(text.max()).bit_length() or 1
        step = max(1, 63 // bits)
        key = np.zeros(n, np.int64)
        ended = np.zeros(n, bool)
        for k in range(step):
            now = np.zeros(n, np.int64)
            now[: max(n - k, 0)] = text[k:]
            now[ended] = 0
            key = key << bits | now
            ended |= now == 0
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | ended[order][1:]
        while True:
            cut = np.flatnonzero(new)
            rank = np.empty(n, np.int64)
            rank[order] = np.repeat(cut, np.diff(np.append(cut, n)))
            size = np.diff(np.append(cut, n))
            if (size == 1).all():
                return rank
            rows = np.flatnonzero(np.repeat(size > 1, size))
            at = order[rows]
            sub = np.lexsort((rank[at + step], rank[at]))
            order[rows] = at[sub]
            more = rank[np.minimum(order + step, n - 1)]
            new[1:] |= (rank[order][1:] == rank[order][:-1]) & (more[1:] != more[:-1])
            step *= 2

    def encode(self, code: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those of no word."""
        at = np.minimum(np.searchsorted(self.alphabet, code), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == code, at + 1, -1)

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals one symbol on; empty ones have lo = hi."""
        key = symbol * self.rows
        return self.words + np.searchsorted(self.pairs, key + lo), self.words + np.searchsorted(self.pairs, key + hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which interval, symbol, lo, hi) for every symbol that a row of an interval has."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        row = np.arange(len(which)) + np.repeat(lo - (np.cumsum(size) - size), size)
        symbol = self.bwt[row]
        inner = symbol > 0
        which, symbol, row = which[inner], symbol[inner], self.following[row[inner]]
        order = np.lexsort((row, symbol, which))
        which, symbol, row = which[order], symbol[order], row[order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])
        cut = np.flatnonzero(new)
        last = np.append(cut[1:], len(which))[: len(cut)] - 1
        return which[cut], symbol[cut], row[cut], row[last] + 1

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, word) where a row of the interval is a whole word."""
        at = np.searchsorted(self.first_row, lo)
        ok = np.flatnonzero(at < np.searchsorted(self.first_row, hi))
        return ok, self.first_word[at[ok]]


def near(index: Index, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``words``, which of the index's) for all pairs with one error behind the first ``exact`` symbols, read from the back of the index's words.

    Every pair comes once: an inserted or deleted symbol stands at the end of its run of equal ones."""
    code, starts = _flat(words)
    symbol = np.append(index.encode(code), 0)
    length = np.diff(starts)
    q = np.arange(len(words))
    lo, hi = np.zeros(len(words), np.int64), np.full(len(words), index.words, np.int64)
    # Open: searches that have made their error; fields (word, lo, hi) by the symbol they go on with.
    none = np.empty(0, np.int64)
    opened = (none, none, none)
    found_q, found_w = [], []
    depth = 0
    while len(q) or len(opened[0]):
        later = []
        at = starts[q] + depth
        ends = depth == length[q]
        own = np.where(ends, 0, symbol[np.minimum(at, len(symbol) - 1)])
        # One error here: symbols of the interval, once for all searches that share it.
        may = np.flatnonzero(depth >= exact[q])
        if len(may):
            same, of = np.unique(lo[may] * (index.rows + 1) + hi[may], return_inverse=True)
            which, c, lo2, hi2 = index.children(same // (index.rows + 1), same % (index.rows + 1))
            cut = np.searchsorted(which, np.arange(len(same) + 1))
            many = np.diff(cut)[of]
            who = np.repeat(may, many)
            child = np.arange(len(who)) + np.repeat(cut[of] - (np.cumsum(many) - many), many)
            other = c[child] != own[who]
            who, child = who[other], child[other]
            inserted = (q[who], lo2[child], hi2[child])  # goes on with this symbol
            replaced = ~ends[who]
            later.append(tuple(x[replaced] for x in inserted))
            after = symbol[np.minimum(starts[q[may]] + depth + 1, len(symbol) - 1)]
            alone = ~ends[may] & ((depth + 1 >= length[q[may]]) | (after != own[may]))
            skipped = may[alone]
            later.append((q[skipped], lo[skipped], hi[skipped]))
            opened = tuple(np.concatenate([a, b]) for a, b in zip(opened, inserted, strict=True))
        # Searches with their error behind them take this symbol, or end here.
        w, a, b = opened
        end = depth == length[w]
        which, word = index.whole(a[end], b[end])
        found_q.append(w[end][which])
        found_w.append(word)
        w, a, b = w[~end], a[~end], b[~end]
        a, b = index.step(a, b, symbol[starts[w] + depth])
        ok = a < b
        later.append((w[ok], a[ok], b[ok]))
        opened = tuple(np.concatenate([x[k] for x in later]) for k in range(3))
        # Searches without an error go on.
        q, lo, hi, own = q[~ends], lo[~ends], hi[~ends], own[~ends]
        lo, hi = index.step(lo, hi, own)
        ok = lo < hi
        q, lo, hi = q[ok], lo[ok], hi[ok]
        depth += 1
    return np.concatenate(found_q) if found_q else none, np.concatenate(found_w) if found_w else none


# ---- search ------------------------------------------------------------------------------------------------------------------


def _searcher():
    """For a stream sorted by bucket: indexes of whole buckets, and what each searched word finds there."""
    names = ["word", "n", "n_near", "form", "form_n"]

    def indexed(rows):
        back = rows[0][0]
        text, count = [r[3] for r in rows if r[5]], np.array([r[4] for r in rows if r[5]])
        # The first scheme runs from the start of the words, so its index has them backwards, and the other way round.
        return back, text, count, Index(text if back else [w[::-1] for w in text])

    def search(made, rows):
        back, text, count, index = made
        for s in range(0, len(rows) if text else 0, SEARCH_WORDS):
            words, own = zip(*(r[3:5] for r in rows[s : s + SEARCH_WORDS]), strict=True)
            half = [len(w) // 2 for w in words]
            exact = np.array([len(w) - h for w, h in zip(words, half, strict=True)] if back else half)
            q, t = near(index, [w[::-1] for w in words] if back else list(words), exact)
            if back:  # pairs whose left half is unchanged are the other scheme's
                new = np.fromiter((text[j][: half[i]] != words[i][: half[i]] for i, j in zip(q.tolist(), t.tolist(), strict=True)), bool, len(q))
                q, t = q[new], t[new]
            n_near = np.bincount(q, minlength=len(words))
            by = np.array(sorted(range(len(q)), key=lambda k: (q[k], -count[t[k]], text[t[k]])), np.int64)
            q, t = q[by], t[by]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            form, form_n = [None] * len(words), [None] * len(words)
            for i, j in zip(q[first].tolist(), t[first].tolist(), strict=True):
                form[i], form_n[i] = text[j], int(count[j])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(own, pa.int64()), pa.array(n_near, pa.int64()), pa.array(form, pa.string()), pa.array(form_n, pa.int64())], names)

    def run(batches):
        rows, bucket, made = [], None, None  # made: the index of a split bucket's block, whose own words came first
        for batch in small(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != bucket:
                    # A split bucket has an index of its own; small ones share one.
                    if rows and (made or row[0] != bucket[0] or len(rows) >= BLOCK_WORDS or row[2] >= 0 or bucket[2] >= 0):
                        yield from search(made or indexed(rows), rows)
                        rows = []
                    bucket, made = row[:3], None
                elif not row[5] and (made is None or len(rows) >= SEARCH_WORDS):
                    made = made or indexed(rows)
                    yield from search(made, rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from search(made or indexed(rows), rows)

    return run


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words that have a form (``word, form``): each round doubles the length of the way that is followed."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.drop("moved")
        if not moved.where("moved").head(1):
            return now


def spelling_variants(counts: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of ``counts`` (``word, n``; words differ) with the given length and count at least.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code point. ``form`` is the most frequent of these (of equally frequent
    ones the smallest by code points), if it is at least ``factor`` times (two or more) as frequent as the word; ``root`` is where following forms ends. Null words don't count."""
    spark = counts.sparkSession
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = stored(counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count)).select("word", "n"), "vocabulary")
    left, right = least_length // 2, least_length - least_length // 2
    routes = F.array(F.struct(F.lit(False).alias("back"), F.substring("word", 1, left).alias("bucket")), F.struct(F.lit(True).alias("back"), F.expr(f"right(word, {right})").alias("bucket")))
    routed = words.select("word", "n", F.explode(routes).alias("r")).select("r.*", "word", "n")
    # At most two rows for every BLOCK_WORDS words.
    hot = stored(routed.groupBy("back", "bucket").agg(F.ceil(F.count("*") / BLOCK_WORDS).cast("int").alias("blocks")).where("blocks > 1"), "hot-buckets")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = routed.join(checked(hot, BROADCAST_ROWS), ["back", "bucket"], "left").withColumn("own", F.when(blocks > 1, F.pmod(F.xxhash64("word"), blocks).cast("int")).otherwise(-1))
    dealt = dealt.withColumn("block", F.explode(F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(-1)))))
    rows = dealt.select("back", "bucket", "block", "word", "n", (F.col("own") == F.col("block")).alias("text"))
    found = rows.repartition(tasks, "back", "bucket", "block").sortWithinPartitions("back", "bucket", "block", F.col("text").desc()).mapInArrow(_searcher(), "word string, n long, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))))
    merged = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    takes = -F.col("best.n") >= factor * F.col("n")
    merged = stored(merged.select("word", "n", "n_near", F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(merged.where("form is not null"))
    return merged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def digest(docs: DataFrame) -> DataFrame:
    """Variants among the words of the documents, after one run in 31 has lost a code point."""
    return spelling_variants(word_counts(docs, damage=DAMAGE)).select("word", "form", "root", "n", "n_near", "form_n")
