"""Line deduplication by a sharded minimal perfect hash.

A first pass counts, for every distinct line key, the documents that hold it and the largest of their ids; tasks combine their own lines before the
shuffle, so a line that stands everywhere is one row a task. Keys are named by 128 bits of a cryptographic hash. They are dealt by their
first bits into shards of about ``SHARD_KEYS`` keys. Each shard becomes one file in the shared folder:

* a minimal perfect hash: levels of bit arrays; a key's place is the rank of the first bit that it holds alone among the keys left;
* compact arrays in that order: 16 bits of the key's name (so that a key of no shard is told apart), and the document count, as far as it matters;
* for keys that reach the count, their places and the largest id.

A second pass reads the texts again, maps the shards that its lines fall into and looks all lines of a few megabytes up at once. No line is joined or
shuffled back, and every line of the corpus has a place of its own, so the answer is exact.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, mix64, prepare, scratch_path, small, stored
from .kneser_ney import map_arrays, write_arrays

LENGTH = 20
DOCUMENTS = 3
#: Keys of one shard on average.
SHARD_KEYS = 1 << 20
#: Distinct lines that a task combines before it ships them.
FLUSH_KEYS = 200_000
#: Bytes of texts whose lines are looked up together.
PROBE_BYTES = 4 << 20
#: Shards that a worker holds mapped.
OPEN_SHARDS = 256
LEAST_ID = -(1 << 63)


def line_key(line: bytes, length: int) -> bytes | None:
    """The line without white space at its ends, A-Z lower-cased; None if that has fewer than ``length`` code points."""
    key = line.strip(SPACES).lower()
    if len(key) < length or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < length):
        return None
    return key


def key_name(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


# ---- minimal perfect hash ----------------------------------------------------------------------------------------------------


def _slots(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix64(high ^ mix64(low + np.uint64(level))) % np.uint64(size)


def build_hash(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Sizes of the levels, their bits (64 a word, level by level), and the number of bits set before each word. Names must differ."""
    sizes, words = [], []
    while len(high):
        size = -(-len(high) // 64) * 64
        slot = _slots(high, low, len(sizes), size).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = ~alone[slot]
        high, low = high[left], low[left]
    bits = np.concatenate(words) if words else np.empty(0, np.uint64)
    before = np.cumsum(np.bitwise_count(bits), dtype=np.uint32) - np.bitwise_count(bits)
    return [np.array(sizes, np.uint64), bits, before.astype(np.uint32)]


def places(table: list[np.ndarray], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The place of each name; names that the table was not built from have any place, or none (-1)."""
    sizes, bits, before = table
    out = np.full(len(high), -1, np.int64)
    left, base = np.arange(len(high)), 0
    for level, size in enumerate(sizes.tolist()):
        slot = _slots(high[left], low[left], level, size)
        word = (slot >> np.uint64(6)).astype(np.int64) + base
        bit = slot & np.uint64(63)
        own = bits[word]
        hit = (own >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(own[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
        out[left[hit]] = before[word[hit]].astype(np.int64) + below
        left = left[~hit]
        base += size // 64
        if not len(left):
            break
    return out


# ---- counting ----------------------------------------------------------------------------------------------------------------


def _counter(length: int):
    names = ["high", "low", "docs", "last"]

    def run(batches):
        seen: dict[bytes, list] = {}

        def combined():
            name = np.frombuffer(b"".join(seen), np.int64).reshape(-1, 2)
            docs, last = zip(*seen.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(name[:, 0])), pa.array(np.ascontiguousarray(name[:, 1])), pa.array(docs, pa.int64()), pa.array(last, pa.int64())], names)

        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                keys = {k for line in text.split(b"\n") if len(line) >= length and (k := line_key(line, length))} if text else ()
                for key in map(key_name, keys):
                    if old := seen.get(key):
                        old[0] += 1
                        if doc_id is not None and (old[1] is None or doc_id > old[1]):
                            old[1] = doc_id
                    else:
                        seen[key] = [1, doc_id]
                if len(seen) >= FLUSH_KEYS:
                    yield combined()
                    seen = {}
        if seen:
            yield combined()

    return run


def _shard_of(high: np.ndarray, bits: int) -> np.ndarray:
    return (high.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)


def _writer(folder: str, documents: int):
    """One file for each shard of a stream that is sorted by shard; gives each shard's number of keys."""

    def save(shard, parts):
        high, low, docs, last = (np.concatenate([p[k] for p in parts]) for k in range(4))
        high, low = high.view(np.uint64), low.view(np.uint64)
        table = build_hash(high, low)
        at = places(table, high, low)
        often = np.flatnonzero(docs >= documents)
        often = often[np.argsort(at[often])]
        prints, counts = np.zeros(len(at), np.uint16), np.zeros(len(at), np.uint8 if documents < 256 else np.uint64)
        prints[at] = (low >> np.uint64(48)).astype(np.uint16)
        counts[at] = np.minimum(docs, documents)
        write_arrays(f"{folder}/{shard}", [*table, prints, counts, at[often].astype(np.uint32), last[often].view(np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(high)], pa.int64())], ["shard", "keys"])

    def run(batches):
        at, parts = None, []
        for batch in batches:
            shard, high, low, docs, last = (np.asarray(c) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if s == e:
                    continue
                if at is not None and shard[s] != at:
                    yield save(int(at), parts)
                    parts = []
                at = shard[s]
                parts.append((high[s:e].copy(), low[s:e].copy(), docs[s:e].copy(), last[s:e].copy()))
        if parts:
            yield save(int(at), parts)

    return run


def index_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, documents: int = DOCUMENTS) -> tuple[str, int]:
    """Write the shards of the lines of ``docs``; the folder below the shared one, and the number of bits that name a shard.

    A row is a document. Lines of fewer than ``length`` code points are not indexed. A null id counts as smaller than every other."""
    spark = docs.sparkSession
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counter(length), "high long, low long, docs long, last long")
    counted = stored(counted.groupBy("high", "low").agg(F.sum("docs").alias("docs"), F.coalesce(F.max("last"), F.lit(LEAST_ID)).alias("last")), "lines")
    bits = max(0, (counted.count() // SHARD_KEYS).bit_length())
    folder = scratch_path(spark, "line-shards")
    shard = F.shiftrightunsigned("high", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = counted.select(shard.alias("shard"), "high", "low", "docs", "last").repartition(min(tasks, 1 << bits), "shard").sortWithinPartitions("shard")
    dealt.mapInArrow(_writer(folder, documents), "shard long, keys long").agg(F.sum("keys")).collect()
    return folder, bits


# ---- probing -----------------------------------------------------------------------------------------------------------------

_MAPPED: OrderedDict[str, list[np.ndarray]] = OrderedDict()


def _mapped(path: str) -> list[np.ndarray]:
    if path in _MAPPED:
        _MAPPED.move_to_end(path)
    else:
        if len(_MAPPED) >= OPEN_SHARDS:
            _MAPPED.popitem(last=False)
        _MAPPED[path] = map_arrays(path)
    return _MAPPED[path]


def look_up(folder: str, bits: int, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each name reaches the count of documents, and then the largest id."""
    name = np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)
    reaches, last = np.zeros(len(name), bool), np.zeros(len(name), np.int64)
    shard = _shard_of(np.ascontiguousarray(name[:, 0]), bits)
    order = np.argsort(shard, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        arrays = _mapped(f"{folder}/{shard[own[0]]}") if len(own) else []
        if not arrays:
            continue
        *table, prints, counts, often, ids = arrays
        at = places(table, name[own, 0], name[own, 1])
        known = (at >= 0) & (prints[at] == (name[own, 1] >> np.uint64(48)).astype(np.uint16))
        k = np.minimum(np.searchsorted(often, np.maximum(at, 0)), max(len(often) - 1, 0))
        hit = np.flatnonzero(known & (often[k] == at)) if len(often) else np.empty(0, np.int64)
        reaches[own[hit]] = True
        last[own[hit]] = ids[k[hit]].astype(np.int64)
    return reaches, last


def _prober(folder: str, bits: int, length: int):
    def run(batches):
        rows, size = [], 0

        def judged():
            asked: dict[bytes, int] = {}
            split = []
            for doc_id, text in rows:
                lines = text.split(b"\n") if text else [b""]
                split.append((doc_id, lines, [asked.setdefault(key_name(k), len(asked)) if len(x) >= length and (k := line_key(x, length)) else -1 for x in lines]))
            reaches, last = look_up(folder, bits, list(asked)) if asked else (np.zeros(1, bool), np.zeros(1, np.int64))
            out = []
            for doc_id, lines, at in split:
                at = np.array(at)
                drop = (at >= 0) & reaches[at] & (last[at] != (LEAST_ID if doc_id is None else doc_id))
                kept = b"\n".join([x for x, d in zip(lines, drop.tolist(), strict=True) if not d]) if drop.any() else b"\n".join(lines)
                out.append((doc_id, len(lines), int(drop.sum()), kept))
            ids, lines, dropped, kept = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                rows.append((doc_id, text))
                size += len(text or b"") + 64
                if size >= PROBE_BYTES:
                    yield judged()
                    rows, size = [], 0
        if rows:
            yield judged()

    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, documents: int = DOCUMENTS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for every row of ``docs``.

    Texts are cut at \\n; a null or empty text is one empty line. A line's key is the line without white space at its ends, A-Z lower-cased. Keys of
    ``length`` code points or more that stand in ``documents`` rows or more lose all their lines but those of the largest id; rows of that
    id all keep theirs, also if the id repeats. A null id is smaller than every other id, so null rows keep such a line only where nobody else has it.
    Very long texts are cut and judged whole, in one task. Other columns are not read."""
    folder, bits = index_lines(docs, id_col=id_col, text_col=text_col, length=length, documents=documents)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_prober(folder, bits, length), "doc_id long, n_lines long, n_dropped long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from the lines that stay."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
