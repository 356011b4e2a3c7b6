"""Substring deduplication by super-k-mer partitioning.

Every window of ``window`` words has a minimiser: the smallest hash of its runs of ``m`` words. Consecutive windows that
share a minimiser travel as one packed string (their words, joined by spaces) to the bucket of that minimiser, so a word is
shipped about three times rather than ``window`` times, and equal windows always meet in one bucket. There the
windows are sorted, and all but the first occurrence of each is marked.

Three measures keep hot groups flat. Within a task, equal packed strings are merged before they are shipped: only the
first goes on, the others are known to be removed. Minimisers with more than their share of distinct strings are found by a
counting pass; their windows travel one by one, dealt by the window's own hash. And there are several times more buckets
than tasks.

Windows are sorted by a 64-bit hash of their words; the words of those that share a hash are then compared themselves, and so are the strings
that a task merges, so nothing is removed for a hash alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare, small, stored, window_hashes, word_hashes

WINDOW = 20
MINIMISER = 6
#: Bytes of packed strings that a task gathers before it ships them.
FLUSH_BYTES = 16 << 20
#: Strings of a bucket whose words are objects at a time.
STRINGS = 8_192
#: Windows in one packed string at most; longer runs are cut into several strings.
RUN = 256
#: Distinct strings of a minimiser that a task reports as possibly hot.
LOCAL_HOT = 16
BUCKETS_PER_TASK = 8
SPANS = "doc_id long, text_key long, start int, end int"


def words_of(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return data.split() if data else []


def _runs(hashes: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer of a document."""
    grams = mix64(window_hashes(hashes, m))
    width = window - m + 1
    low, done = grams, 1  # the smallest of each `width` neighbours, by doubling
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    cut = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(cut, len(low)))
    if size.max() > RUN:
        parts = -(-size // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cut, whole = np.repeat(cut, parts) + nth * RUN, np.repeat(size, parts)
        size = np.minimum(RUN, whole - nth * RUN)
    return cut, size, low[cut]


def _string_keys(hashes: np.ndarray, first: np.ndarray, size: np.ndarray, minimiser: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit key of each packed string, from all its windows in order."""
    whole = mix64(window_hashes(hashes, window))
    nth = (np.arange(len(whole)) - np.repeat(first, size)).astype(np.uint64)
    return mix64(np.add.reduceat(whole * (nth * np.uint64(2) + np.uint64(1)), first) + mix64(minimiser + size.astype(np.uint64)))


class _Task:
    """What a task has gathered: one entry for each super-k-mer of its documents since the last flush."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.first, self.size, self.minimiser, self.key, self.doc = [], [], [], [], []
        self.split: dict[int, list[bytes]] = {}
        self.bytes = 0

    def add(self, doc_id, text_key, data: bytes, window: int, m: int, expand: int = 3) -> None:
        hashes = word_hashes(data)
        if len(hashes) < window:
            return
        first, size, low = _runs(hashes, window, m)
        self.key.append(_string_keys(hashes, first, size, low, window))
        self.first.append(first)
        self.size.append(size)
        self.minimiser.append(low)
        self.doc.append(np.full(len(first), len(self.docs)))
        self.docs.append((doc_id, text_key, data, hashes))
        self.bytes += expand * len(data)

    def words(self, doc: int) -> list[bytes]:
        if doc not in self.split:
            self.split[doc] = words_of(self.docs[doc][2])
        return self.split[doc]

    def distinct(self, window: int = 0) -> tuple:
        """The entries in the order of document and place, and whether each is the first of its key; with ``window``, entries of one key count as
        equal only if their words are."""
        order = sorted(range(len(self.docs)), key=lambda i: (self.docs[i][0] is None, self.docs[i][0] or 0, self.docs[i][1]))
        first, size, low, key = (np.concatenate([x[i] for i in order]) for x in (self.first, self.size, self.minimiser, self.key))
        doc = np.concatenate([self.doc[i] for i in order])
        by = np.argsort(key, kind="stable")
        sorted_key = key[by]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        is_first = np.empty(len(key), bool)
        is_first[by] = new
        # The same row twice is no earlier start: an entry equal to its group's first in document and place stays unmarked.
        head = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        names = [self.docs[i][:2] for i in range(len(self.docs))]
        for i in np.flatnonzero(~new):
            a, b = by[i], head[i]
            if doc[a] != doc[b] and first[a] == first[b] and names[doc[a]] == names[doc[b]]:
                is_first[a] = True
            elif window and (size[a] != size[b] or self.words(doc[a])[first[a] : first[a] + size[a] + window - 1] != self.words(doc[b])[first[b] : first[b] + size[b] + window - 1]):
                is_first[a] = True  # it goes on as a string of its own
        return doc, first, size, low, is_first


def _hot_counter(window: int, m: int):
    def run(batches):
        task = _Task()

        def report():
            doc, _first, _size, low, is_first = task.distinct()
            values, counts = np.unique(low[is_first], return_counts=True)
            often = counts >= LOCAL_HOT
            return int(is_first.sum()), values[often], counts[often]

        def rows(got):
            n, values, counts = got
            return pa.RecordBatch.from_arrays([pa.array([None, *values.view(np.int64).tolist()], pa.int64()), pa.array([n, *counts.tolist()], pa.int64())], ["minimiser", "n"])

        for batch in small(batches):
            for doc_id, text_key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data:
                    task.add(doc_id, text_key, data, window, m)
                if task.bytes >= FLUSH_BYTES and task.docs:
                    yield rows(report())
                    task = _Task()
        if task.docs:
            yield rows(report())

    return run


def _spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "text_key", "start", "end"])


def _join_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word spans in the order of document and start, with those that overlap or touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + doc.astype(np.int64) * far)
    new = np.concatenate([[True], start[1:] + doc[1:].astype(np.int64) * far > reach[:-1]])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def _shipper(window: int, m: int, buckets: int, hot):
    """Rows for the buckets (``blob`` set) and spans that are already known to be removed (``blob`` null, dealt like the others)."""
    names = ["bucket", "blob", "doc_id", "text_key", "start", "end"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def flush(task: _Task):
        doc, first, size, low, is_first = task.distinct(window)
        known = ~is_first
        rows = [(d % buckets, None, *task.docs[d][:2], int(s), int(e)) for d, s, e in zip(*(x.tolist() for x in _join_spans(doc[known], first[known], (first + size + window - 1)[known])), strict=True)]
        doc, first, size, low = (x[is_first] for x in (doc, first, size, low))
        place = (mix64(low) % np.uint64(buckets)).astype(np.int64)
        if len(hot.value):  # windows of hot minimisers go one by one, dealt by their own hash
            single = np.isin(low, hot.value)
            d, f = np.repeat(doc[single], size[single]), np.repeat(first[single], size[single])
            f = f + np.arange(len(f)) - np.repeat(np.cumsum(size[single]) - size[single], size[single])
            own = np.empty(len(d), np.uint64)
            by = np.argsort(d, kind="stable")
            for at in np.split(by, np.flatnonzero(np.diff(d[by])) + 1) if len(by) else ():
                own[at] = window_hashes(task.docs[d[at[0]]][3], window)[f[at]]
            place = np.concatenate([place[~single], (mix64(own) % np.uint64(buckets)).astype(np.int64)])
            doc, first, size = np.concatenate([doc[~single], d]), np.concatenate([first[~single], f]), np.concatenate([size[~single], np.ones(len(d), size.dtype)])
        strings: list[bytes] = []
        order = np.argsort(doc, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        for d, s, n in zip(doc[order].tolist(), first[order].tolist(), size[order].tolist(), strict=True):
            strings.append(b" ".join(task.words(d)[s : s + n + window - 1]))
        by = np.argsort(place, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(place[by]) != 0])) if len(by) else []
        press = zstandard.ZstdCompressor(level=3)
        for own in np.split(by, cuts[1:] if len(cuts) else []):
            if not len(own):
                continue
            d = doc[own].tolist()
            head = pa.record_batch([pa.array([task.docs[i][0] for i in d], pa.int64()), pa.array([task.docs[i][1] for i in d], pa.int64()), pa.array(first[own].astype(np.int32)), pa.array(size[own].astype(np.int32)), pa.array([strings[back[i]] for i in own], pa.binary())], names=["doc_id", "text_key", "start", "size", "words"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            rows.append((int(place[own[0]]), press.compress(sink.getvalue().to_pybytes()), None, None, None, None))
        for i in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 512], strict=True), kinds, strict=True)], names)

    def run(batches):
        task = _Task()
        for batch in small(batches):
            for doc_id, text_key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data:
                    task.add(doc_id, text_key, data, window, m)
                if task.bytes >= FLUSH_BYTES and task.docs:
                    yield from flush(task)
                    task = _Task()
        if task.docs:
            yield from flush(task)

    return run


def _check_words(by: np.ndarray, head: np.ndarray, record: np.ndarray, nth: np.ndarray, strings: pa.ChunkedArray, window: int) -> None:
    """Make ``head`` exact: each window's head (windows in the order ``by``) becomes the first window with the same words.

    ``record`` is each window's string, ``nth`` its number there. Only strings with a window that shares its hash are read."""
    shared = np.flatnonzero(by != head)
    if not len(shared):
        return
    wanted = np.unique(record[np.concatenate([by[shared], head[shared]])])
    numbers, starts, total = {}, np.zeros(len(strings), np.int64), 0
    ids = []
    for i, text in zip(wanted.tolist(), strings.take(pa.array(wanted)).to_pylist(), strict=True):
        words = text.split()
        ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        starts[i] = total
        total += len(words)
    ids = np.concatenate(ids)
    place = lambda e: (starts[record[e]] + nth[e])[:, None] + np.arange(window)
    differs = []
    for at in range(0, len(shared), 1 << 16):
        own = shared[at : at + (1 << 16)]
        differs.append(own[(ids[place(by[own])] != ids[place(head[own])]).any(1)])
    differs = np.concatenate(differs)
    if len(differs):  # windows of one hash with different words: group these by the words
        first: dict[tuple, int] = {}
        for k in np.flatnonzero(np.isin(head, head[differs])).tolist():
            head[k] = first.setdefault((int(head[k]), ids[place(by[k : k + 1])].tobytes()), by[k])


def _judge(blobs: list[bytes], window: int):
    """Spans of the windows of one bucket that start earlier elsewhere."""
    table = pa.concat_tables([pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b)).read_all() for b in blobs])
    table = table.sort_by([("doc_id", "ascending"), ("text_key", "ascending"), ("start", "ascending")])
    doc_id, text_key = (table.column(c).to_pylist() for c in ("doc_id", "text_key"))
    names: dict[tuple, int] = {}
    doc = np.array([names.setdefault(x, len(names)) for x in zip(doc_id, text_key, strict=True)], np.int64)
    who = list(names)
    start, size = (np.asarray(table.column(c)).astype(np.int64) for c in ("start", "size"))
    keys = []
    for at in range(0, len(start), STRINGS):  # the strings' words in a row; windows that lie in two strings are left out
        words = word_hashes(b" ".join(table.column("words").slice(at, STRINGS).to_pylist()))
        n = size[at : at + STRINGS]
        first = np.cumsum(n + window - 1) - (n + window - 1)
        keys.append(window_hashes(words, window)[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
    key = np.concatenate(keys)
    strings = table.column("words")
    del table, keys
    record = np.repeat(np.arange(len(size)), size)
    place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(len(record))
    by = np.argsort(key, kind="stable")
    key = key[by]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    head = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    _check_words(by, head, record, np.arange(len(record)) - (np.cumsum(size) - size)[record], strings, window)
    # A group's first is its earliest start; the same row twice is no earlier start.
    gone = by[(doc[record[by]] != doc[record[head]]) | (place[by] != place[head])]
    d, s, e = _join_spans(doc[record[gone]], place[gone], place[gone] + window)
    return [(*who[i], a, b) for i, a, b in zip(d.tolist(), s.tolist(), e.tolist(), strict=True)]


def _judges(window: int):
    def run(batches):
        at, blobs = None, []
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column(1)))
            if known.num_rows:
                yield known.select(["doc_id", "text_key", "start", "end"])
            for bucket, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if blob is None:
                    continue
                if bucket != at and blobs:
                    if rows := _judge(blobs, window):
                        yield _spans_batch(rows)
                    blobs = []
                at = bucket
                blobs.append(blob)
        if blobs and (rows := _judge(blobs, window)):
            yield _spans_batch(rows)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("data"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """Word spans ``doc_id, text_key, start, end`` that windows of ``window`` words cover whose word sequence also starts
    earlier: in a document of smaller id, or earlier in the same one. ``text_key`` tells rows of one id with different
    texts apart (they stand in its order); the same row twice counts as one document. Null ids stand last. Null and short
    texts have no window. Spans of a document may overlap."""
    spark = docs.sparkSession
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, id_col, text_col)
    counts = keyed.mapInArrow(_hot_counter(window, m), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    counts = stored(counts, "minimisers")
    total = counts.where("minimiser is null").agg(F.sum("n")).first()[0] or 0
    # At most 8 x tasks minimisers have more than this share, so what is broadcast is bounded by the number of tasks.
    share = max(LOCAL_HOT, total // (8 * tasks))
    hot = [r[0] for r in counts.where((F.col("n") > share) & F.col("minimiser").isNotNull()).select("minimiser").collect()]
    hot_values = spark.sparkContext.broadcast(np.sort(np.array(hot, np.int64).view(np.uint64)))
    shipped = keyed.mapInArrow(_shipper(window, m, BUCKETS_PER_TASK * tasks, hot_values), "bucket int, blob binary, " + SPANS)
    return stored(shipped.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_judges(window), SPANS), "spans")


def _kept(data: bytes | None, spans) -> tuple[int, int, bytes]:
    """Number of words, number of words that the spans cover, and the other words joined by one space."""
    words = words_of(data)
    edge = np.zeros(len(words) + 1, np.int32)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[min(s["end"], len(words))] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def _keeper(batches):
    for batch in small(batches):
        out = [(doc_id, text_key, *_kept(data, spans)) for doc_id, text_key, data, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "text_key", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, n_words, n_removed, kept_text`` (kept words joined by one space; empty for null)."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, window=window, m=m)
    of_doc = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # bounded by the document's words
    keyed = _keyed(docs, id_col, text_col)
    joined = keyed.alias("d").join(of_doc.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key")), "left").select("d.doc_id", "d.text_key", "d.data", "s.spans")
    kept = joined.mapInArrow(_keeper, "doc_id long, text_key long, n_words long, n_removed long, kept binary")
    return kept.select("doc_id", "text_key", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with all its columns and without the words that repeated windows cover. A text that loses words has its kept ones joined by
    one space, and its length, if there is such a column, follows; a text that loses nothing stays as it is; a text that loses all words goes."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, **options)
    own = next(n for n in ("_spans" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    of_doc = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias(own)).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = docs.join(of_doc, docs[id_col].cast("long").eqNullSafe(of_doc["_id"]) & (F.xxhash64(docs[text_col].cast("string")) == of_doc["_key"]), "left").select(*(docs[c] for c in docs.columns), of_doc[own])
    names, kinds = docs.columns, docs.schema

    def run(batches):
        for batch in small(batches):
            at = names.index(text_col)
            texts, keep, lengths = batch.column(at).to_pylist(), [], {}
            for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans:
                    _n, _gone, kept = _kept(texts[i].encode(), spans)
                    texts[i] = kept.decode()
                    lengths[i] = len(texts[i])
                keep.append(not spans or bool(texts[i]))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            if length_col in names:
                k = names.index(length_col)
                columns[k] = pa.array([lengths.get(i, v) for i, v in enumerate(columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, kinds)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document."""
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

