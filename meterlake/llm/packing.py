"""Packing of token sequences by minimum bin slack.

A document of more than one window gives whole windows and a rest. The rests are packed by their lengths alone:
for the longest length left, a subset-sum dynamic program over bit sets finds the multiset of further lengths that
fills the window closest to its capacity, the counts are traced back, and the same filling is repeated as often as the
counts allow. So the plan depends on the histogram of rests (at most ``window`` lengths), however many documents
there are. Rests are then dealt to the planned slots by their rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, small, stored, text_batches
from .tokens import default_path, tokenizer

WINDOW = 2048
END_ID = 1
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, rank long"


def padding(filled: int, window: int) -> int:
    """Padding of a sequence: none at a power of two, else up to the window."""
    return 0 if filled & (filled - 1) == 0 else window - filled


def fill(counts: dict[int, int], first: int, window: int) -> dict[int, int]:
    """Copies of each length that, with one of ``first``, come closest to a full window (least padding, then most tokens)."""
    rest = window - first
    steps: list[tuple[int, int, int]] = []  # sums reachable before the step, length, copies
    reach, mask = 1, (1 << (rest + 1)) - 1
    for length in sorted((x for x in counts if x <= rest), reverse=True):
        left = min(counts[length] - (length == first), rest // length)
        take = 1
        while left > 0 and not reach >> rest & 1:
            n = min(take, left)
            steps.append((reach, length, n))
            reach = (reach | reach << n * length) & mask
            left -= n
            take *= 2
        if reach >> rest & 1:
            break
    best = rest
    if not reach >> rest & 1:
        sums = {reach.bit_length() - 1} | {x - first for x in (1 << k for k in range(window.bit_length())) if x >= first and reach >> (x - first) & 1}
        best = min(sums, key=lambda s: (padding(first + s, window), -s))
    got = {first: 1}
    for before, length, n in reversed(steps):
        if not before >> best & 1:
            best -= n * length
            got[length] = got.get(length, 0) + n
    assert best == 0
    return got


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, copies in a sequence, first sequence, offset of the first copy).

    The rests of a length are numbered from 0; rank r of a slot goes to sequence ``first + (r - from) // copies``."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(counts, 0)
    slots, sequence = [], 0
    while counts:
        got = fill(counts, max(counts), window)
        times = min(counts[k] // n for k, n in got.items())
        offset = 0
        for length in sorted(got, reverse=True):
            n = got[length]
            slots.append((length, used[length], used[length] + n * times, n, sequence, offset))
            offset += n * length
            used[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return slots


def _cutter(path: str, end_id: int, window: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        encode = tokenizer(path)
        for batch in small(batches):
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encode.encode(text_batches(batch)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, int(seen[len(piece)])))
                    seen[len(piece)] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names)

    return run


def _dealer(slots: np.ndarray, window: int, rests: int):
    """Sequence and offset of each piece. slots: rows of plan(), sorted by length and first rank."""

    def run(batches):
        table = slots.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("length"))).astype(np.int64)
            rank = np.asarray(batch.column(batch.schema.get_field_index("global_rank"))).astype(np.int64)
            sequence, offset = rests + rank, np.zeros(len(rank), np.int64)  # a whole window is a sequence of its own
            rest = length < window
            at = np.searchsorted(keys, length[rest] << 44 | rank[rest], side="right") - 1
            slot = table[at]
            turn = rank[rest] - slot[:, 1]
            sequence[rest] = slot[:, 4] + turn // slot[:, 3]
            offset[rest] = slot[:, 5] + turn % slot[:, 3] * length[rest]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep[:2], keep[2].cast(pa.int64()), *keep[3:], pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each text is encoded once and closed with ``end_id``; only the pieces' numbers are shuffled. Null and empty texts
    are one piece of the end id; null ids are kept; repeated rows are packed like any other rows. An empty table gives no rows.
    Sequences of whole windows come after those of the rests; offsets of a sequence start at 0 without gaps. Other
    columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    cut = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cutter(tokenizer_path or default_path(), end_id, window), PIECES), "pieces")
    # One row for each partition and length; the ranks of a partition follow those of the partitions before it.
    counts = cut.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    slots = plan({k: v for k, v in histogram.items() if k < window}, window)
    rests = max((s[4] + (s[2] - s[1]) // s[3] for s in slots), default=0)
    table = spark.sparkContext.broadcast(np.array(sorted(slots), np.int64).reshape(-1, 6))  # bounded by the window, not by the rows
    ranked = cut.join(counts.select("length", "part", "before"), ["length", "part"]).withColumn("global_rank", F.col("before") + F.col("rank"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "global_rank").mapInArrow(
        _dealer(table, window, rests), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
