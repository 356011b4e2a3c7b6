"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package

#: Bytes of one text that are split into words at once, so that a very long text never becomes one long list.
PIECE_BYTES = 1 << 18
#: Words that a worker's cache holds before it starts afresh.
CACHE_WORDS = 200_000
#: Rows of a batch that are Python objects at a time.
SLICE_ROWS = 512
SPACES = b" \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and settle the shared folder."""
    ship_package(spark)
    shared_dir(spark, "x")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names."""
    return shared_dir(spark, f"llm-{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the unfinished tasks only, and later
    stages read a fixed table whose rows don't depend on how a task was repeated."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """``stored``; the shuffle files behind it go as soon as it is written (a setting of the session that holds while this job runs)."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


def checked(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it counts ``rows`` rows at most."""
    return F.broadcast(df) if df.count() <= rows else df


def hold_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold`` modulo ``folds``. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def lower_ascii(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``data`` cut behind white space into pieces of about ``size`` bytes; no word is cut."""
    at, end = 0, len(data)
    while end - at > size:
        cut = at + size
        while cut < end and data[cut] not in SPACES:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            out = np.full(max(n, 1 << 16), base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit polynomial hashes of every run of ``n`` words, in order; none if there are fewer.

    From the running sum of the words' hashes times the base's powers, so the cost does not depend on ``n``."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return (total[n:] - total[:count]) * down[:count]


_IS_WORD = np.array([b not in SPACES for b in range(256)])
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight
#: Bytes of a word up to which its blocks are mixed together with the other words'; longer words are hashed one by one.
LONG_WORD = 128


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order.

    Every block of eight bytes goes through a round of multiplications and shifts, all words' first blocks at once, then their second ones and so
    on, so no two words share a hash by their structure (as polynomial hashes modulo 2^64 do, whatever their base)."""
    out = [np.empty(0, np.uint64)]
    for piece in pieces(data):
        a = np.frombuffer(piece, np.uint8)
        edge = np.flatnonzero(np.diff(_IS_WORD[a].view(np.int8), prepend=0, append=0))
        start, size = edge[::2], edge[1::2] - edge[::2]
        eight = np.ndarray((len(a),), np.uint64, piece + bytes(8), 0, (1,))  # the eight bytes from each place on
        value = size.astype(np.uint64) * _M1 + _M2
        left, at, rest = np.arange(len(start)), start, size
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            keep = size <= LONG_WORD
            left, at, rest = left[keep], at[keep], rest[keep]
        while len(left):
            value[left] = mix64(value[left] ^ (eight[at] & _TAIL[np.minimum(rest, 8)]))
            more = rest > 8
            left, at, rest = left[more], at[more] + 8, rest[more] - 8
        for i in long.tolist():
            value[i] = int.from_bytes(hashlib.blake2b(piece[start[i] : start[i] + size[i]], digest_size=8).digest(), "little")
        out.append(value)
    return out[-1] if len(out) < 3 else np.concatenate(out)


def give_back() -> None:
    """Memory that earlier tasks of this worker freed and the C library kept goes back to the system (glibc; others have no such call)."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small(batches) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few hundred rows, so that only these become Python objects. The worker's Arrow memory goes back to the system when it is free."""
    pa.set_memory_pool(pa.system_memory_pool())
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def text_batches(batch: pa.RecordBatch, column: str = "text") -> list:
    """The texts of a batch; None where null."""
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
