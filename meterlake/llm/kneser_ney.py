"""Interpolated modified Kneser-Ney model of any order from 2, counted in Spark over all training texts.

The model is a folder of shards below the shared folder. A vocabulary shard holds the sorted 64-bit hashes of its words with, for each word, its count,
the number of different words before it, and what its contexts need (total and the numbers of followers seen once, twice and more often). A shard
of n-grams holds their sorted keys with their counts; below the highest order, with the number of different words before them and what they need as
contexts. Workers map the shards into memory and look a batch's distinct words and n-grams up in sorted order; nothing is collected but one
line of totals per shard.

    p(w | u v) = max(c(uvw) - D(c(uvw)), 0) / c(uv) + (D1 N1(uv) + D2 N2(uv) + D3 N3+(uv)) / c(uv) * p(w | v)
    p(w)       = max(N(*w) - E(N(*w)), 0) / N(**) + (E1 M1 + E2 M2 + E3 M3+) / N(**) / (V + 1)

At the highest order c counts places; below it c(vw) is N(*vw), the number of different words before vw, and c(v) their sum over w. Each order has its own D.
A text has order - 1 starts before it, so each of its words has a context of that length; the start is never predicted.

Every order is counted from the one above: a shard's n-grams give their contexts' and their last n - 1 words' counts. N-grams are dealt by their middle words, or
where all of these have more than their share of all tokens, by the first or the last word also, so that no shard is hot.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import urllib.parse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold_out, lower_ascii, mix64, prepare, scratch_path, small, stored, stored_alone, word_hashes

END = np.uint64(0x656E64206F662074)  # of no word in particular
FLUSH_TOKENS = 1_500_000
#: Counts in a vocabulary shard, one array each after the hashes.
FIELDS = ("count", "before", "context", "once", "twice", "more")
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_PRESS, _OPEN = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, pressed. All values' first bytes come first, then their second ones and so on, which presses better."""
    head = ",".join([str(len(arrays[0])), *(a.dtype.str for a in arrays)]).encode()
    body = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return _PRESS.compress(b"".join([len(head).to_bytes(4, "little"), head, *body]))


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    each = []
    for data in map(_OPEN.decompress, blobs):
        at = 4 + int.from_bytes(data[:4], "little")
        n, *kinds = data[4:at].decode().split(",")
        arrays, n = [], int(n)
        for kind in map(np.dtype, kinds):
            size = n * kind.itemsize
            arrays.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).reshape(n))
            at += size
        each.append(arrays)
    return each[0] if len(each) == 1 else [np.concatenate(x) for x in zip(*each, strict=True)]


def _hash_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of evenly spread 64-bit values: their upper bits and places are sorted as one number, all bits only where that does not do."""
    room = np.uint64(max(len(keys) - 1, 1).bit_length())
    by = np.sort(keys >> room << room | np.arange(len(keys), dtype=np.uint64))
    by = (by & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    got = keys[by]
    return by if (got[1:] >= got[:-1]).all() else np.argsort(keys, kind="stable")


def _order(packed: list[np.ndarray]) -> np.ndarray:
    """What ``np.lexsort`` gives for columns of pairs of 32-bit numbers, the first column first: numbers and places are sorted as one number of 64 bits."""
    rows = len(packed[0])
    room = max(rows - 1, 1).bit_length()
    places, mask = np.arange(rows, dtype=np.uint64), np.uint64((1 << room) - 1)
    value, used = np.zeros(rows, np.uint64), 0
    for c in (x for p in packed for x in (p >> _HALF, p & _LOW)):
        width = int(c.max()).bit_length() if rows else 0
        if used + width + room > 64:  # numbers for the values so far
            if 2 * room + width > 64:
                return np.lexsort(packed[::-1])
            got = np.sort(value << np.uint64(room) | places)
            value[(got & mask).astype(np.int64)] = np.cumsum(np.diff(got >> np.uint64(room), prepend=got[:1] >> np.uint64(room)) > 0).astype(np.uint64)
            used = room
        value, used = value << np.uint64(width) | c, used + width
    return (np.sort(value << np.uint64(room) | places) & mask).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct evenly spread values, the first place of each, and by place the value's number."""
    by = _hash_order(keys)
    got = keys[by]
    new = np.ones(len(got), bool)
    new[1:] = got[1:] != got[:-1]
    inverse = np.empty(len(got), np.int64)
    inverse[by] = np.cumsum(new) - 1
    return got[new], by[new], inverse


def _delta(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.zeros(1, sorted_keys.dtype))


# ---- files -------------------------------------------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if urllib.parse.urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(path).path)
    return pafs.FileSystem.from_uri(path)


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """One file with the arrays' lengths and bytes a value in front; written aside and moved, so a task that runs again leaves the same file."""
    fs, at = _filesystem(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    aside = f"{at}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
    with fs.open_output_stream(aside) as f:
        f.write(np.array([len(arrays), *(len(a) for a in arrays), *(a.itemsize for a in arrays)], np.int64).tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(bytes(-a.nbytes % 8))
    fs.move(aside, at)


def map_arrays(path: str) -> list[np.ndarray]:
    """The unsigned arrays of a file, mapped into memory. A store without paths is copied to an unnamed local file first."""
    fs, at = _filesystem(path)
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return []
    if isinstance(fs, pafs.LocalFileSystem):
        f = open(at, "rb")
    else:
        f = tempfile.TemporaryFile()
        with fs.open_input_stream(at) as src:
            while block := src.read(1 << 22):
                f.write(block)
        f.flush()
    with f:
        size = os.fstat(f.fileno()).st_size
        try:
            held = mmap.mmap(f.fileno(), size, access=mmap.ACCESS_READ, trackfd=False)
        except TypeError:  # before Python 3.13
            held = mmap.mmap(f.fileno(), size, access=mmap.ACCESS_READ)
    n = int(np.frombuffer(held, np.int64, 1)[0])
    lengths, sizes = np.frombuffer(held, np.int64, 2 * n, 8).reshape(2, n)
    starts = 8 * (1 + 2 * n) + np.concatenate([[0], np.cumsum((lengths * sizes + 7) // 8 * 8)])
    return [np.frombuffer(held, f"u{size}", int(k), int(s)) for k, size, s in zip(lengths, sizes, starts, strict=False)]


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in 1, 4 or 8 bytes each."""
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.uint64)


def _compact(counts: np.ndarray) -> list[np.ndarray]:
    """The counts in a byte each; 255 is in the list of places and counts that follows."""
    over = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype(np.uint8), over.astype(np.uint64), counts[over].astype(np.uint64)]


def _expand(compact: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """The counts at some places of what ``_compact`` gave."""
    byte, places, counts = compact
    out = byte[at].astype(np.uint64)
    over = out == 255
    out[over] = counts[np.searchsorted(places, at[over].astype(np.uint64))]
    return out


# ---- words -------------------------------------------------------------------------------------------------------------------


def _tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words, then the end."""
    return np.append(word_hashes(lower_ascii(text)) if text else np.empty(0, np.uint64), END)


def _flushes(batches, column: int = 0, size: int = FLUSH_TOKENS):
    """Lists of token arrays of about ``size`` tokens."""
    held, n = [], 0
    for batch in small(batches):
        for text in batch.column(column).to_pylist():
            held.append(_tokens(text))
            n += len(held[-1])
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])


def _split(shard: np.ndarray, *arrays: np.ndarray):
    """The arrays shard by shard, each in its old order."""
    by = np.argsort(shard.astype(np.uint16 if len(shard) and shard.max() < 1 << 16 else np.int64), kind="stable")
    cuts = np.flatnonzero(np.diff(shard[by])) + 1
    for own in np.split(by, cuts):
        if len(own):
            yield int(shard[own[0]]), [a[own] for a in arrays]


def _word_counter(bits: int):
    def run(batches):
        for held in _flushes(batches):
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            shard = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
            yield _blob_batch([(k, _pack(_delta(w), c.astype(np.uint32))) for k, (w, c) in _split(shard, words, counts)])

    return run


def _by_shard(batches):
    at, blobs = None, []
    for batch in small(batches):
        for shard, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != at and blobs:
                yield at, blobs
                blobs = []
            at = shard
            blobs.append(blob)
    if blobs:
        yield at, blobs


def _merged(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return [keys[at], *(np.add.reduceat(c[by].astype(np.uint64), at) if len(at) else c.astype(np.uint64) for c in counts)]


def _keys_of(blobs: list[bytes]) -> list[np.ndarray]:
    """Keys (written as differences, blob by blob) and counts."""
    each = [_unpack([b]) for b in blobs]
    return [np.concatenate([np.cumsum(x[0]) for x in each]), *(np.concatenate([x[i] for x in each]) for i in range(1, len(each[0])))]


def _word_writer(folder: str):
    def run(batches):
        for shard, blobs in _by_shard(batches):
            words, counts = _merged(*_keys_of(blobs))
            write_arrays(f"{folder}/words-{shard}", [words, counts])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(words)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["shard", "words", "tokens"])

    return run


class Words:
    """The vocabulary: words' numbers from their hashes. ``starts`` has the number of the first word of each shard, and at the end the vocabulary's size."""

    def __init__(self, folder: str, bits: int, starts: np.ndarray, name: str):
        self.bits, self.starts = bits, starts
        self.shards = [map_arrays(f"{folder}/{name}-{k}") for k in range(1 << bits)]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes; -1 where unknown."""
        out = np.full(len(words), -1, np.int64)
        cuts = np.searchsorted(words, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else []
        for k, (s, e) in enumerate(zip([0, *cuts], [*cuts, len(words)], strict=True)):
            if e > s and self.shards[k]:
                known = self.shards[k][0]
                i = np.minimum(np.searchsorted(known, words[s:e]), len(known) - 1)
                out[s:e] = np.where(known[i] == words[s:e], i + self.starts[k], -1)
        return out

    def fields(self, numbers: np.ndarray) -> np.ndarray:
        """The counts of known words, a row for each field of the shard."""
        shard = np.searchsorted(self.starts, numbers, side="right") - 1
        out = np.zeros((len(FIELDS), len(numbers)))
        for k, (at, own) in _split(shard, np.arange(len(numbers)), numbers - self.starts[shard]):
            for f in range(len(FIELDS)):
                out[f, at] = self.shards[k][1 + f][own]
        return out


_OPENED: dict[tuple, Words] = {}


def _words(folder: str, bits: int, starts: np.ndarray, name: str) -> Words:
    key = (folder, name)
    if key not in _OPENED:
        if len(_OPENED) > 2:
            _OPENED.clear()
        _OPENED[key] = Words(folder, bits, starts, name)
    return _OPENED[key]


# ---- n-grams -----------------------------------------------------------------------------------------------------------------


def _packed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns of words' numbers two by two, the middle words first: what n-grams are sorted by."""
    c = [x.astype(np.uint64) for x in ([*columns[1:-1], columns[0], columns[-1]] if len(columns) > 2 else columns)]
    return [*(a << _HALF | b for a, b in zip(c[::2], c[1::2], strict=False)), *c[len(c) // 2 * 2 :]]


def _columns(packed: list[np.ndarray], n: int) -> list[np.ndarray]:
    c = [x for p in packed[: n // 2] for x in (p >> _HALF, p & _LOW)] + packed[n // 2 :]
    return [c[-2], *c[:-2], c[-1]] if n > 2 else c


def _gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """64 evenly spread bits: both numbers of a pair scrambled, a hash of more words."""
    key = mix64(columns[0] << _HALF | columns[1])
    for c in columns[2:]:
        key = mix64(key ^ mix64(c + np.uint64(0x9E3779B97F4A7C15)))
    return key


def _key_arrays(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted scrambled keys in six bytes each: how many have each of the upper 16 bits, then the next 32 bits and the lower 16 of each key."""
    return [*_compact(np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=1 << 16)), (keys >> np.uint64(16)).astype(np.uint32), keys.astype(np.uint16)]


def _find(arrays: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of sorted keys in what ``_key_arrays`` gave, and whether they are there."""
    upper, lower = arrays[3:]
    sizes = arrays[0].astype(np.int64)
    sizes[arrays[1].astype(np.int64)] = arrays[2].astype(np.int64)
    head = (keys >> np.uint64(48)).astype(np.int64)
    end = np.cumsum(sizes)[head]
    lo, hi = end - sizes[head], end
    want = keys & np.uint64((1 << 48) - 1)
    at = lambda i: upper[i].astype(np.uint64) << np.uint64(16) | lower[i]
    while (on := lo < hi).any():
        mid = np.where(on, (lo + hi) // 2, 0)
        less = at(mid) < want
        lo, hi = np.where(on & less, mid + 1, lo), np.where(on & ~less, mid, hi)
    here = np.flatnonzero(lo < end)
    found = np.zeros(len(keys), bool)
    found[here] = at(lo[here]) == want[here]
    return lo, found


def _place(columns: list[np.ndarray], hot: np.ndarray, bits: int) -> np.ndarray:
    """The shard of n-grams: by the middle words, and where these are all hot, by the first word, the last word if the first is hot, or both if both are."""
    if not bits:
        return np.zeros(len(columns[0]), np.int64)
    own, loose = np.zeros(len(columns[0]), np.uint64), np.ones(len(columns[0]), bool)
    table = np.zeros(int(hot.max()) + 1, bool)  # the start, which is hot, has the largest number
    table[hot.astype(np.int64)] = True
    for c in columns[1:-1]:
        own = mix64(own ^ mix64(c + np.uint64(1)))
        loose &= table[c.astype(np.int64)]
    first, last = (table[columns[k].astype(np.int64)] for k in (0, -1))
    own = np.where(loose & (last | ~first), mix64(own ^ mix64(columns[0] + np.uint64(1 << 33))), own)
    own = np.where(loose & first, mix64(own ^ mix64(columns[-1] + np.uint64(1 << 34))), own)
    return (mix64(own) >> np.uint64(64 - bits)).astype(np.int64)


def _merged_grams(packed: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams in order, and the sums of their counts."""
    if not len(packed[0]):
        return packed, counts
    by = _order(packed)
    packed = [p[by] for p in packed]
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in packed])
    at = np.flatnonzero(new)
    return [p[at] for p in packed], [_narrow(np.add.reduceat(c[by].astype(np.uint64), at)) for c in counts]


def _gram_blobs(n: int, shard: np.ndarray, packed: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple]:
    k, odd = len(packed), n % 2 and n > 1  # an odd column stands alone and has 32 bits
    return [(at, _pack(_delta(own[0]), *own[1 : k - 1], *([own[k - 1].astype(np.uint32) if odd else own[k - 1]] if k > 1 else []), *own[k:])) for at, own in _split(shard, *packed, *counts)]


def _grams_of(blobs: list[bytes], n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    got, k = _keys_of(blobs), (n + 1) // 2
    return [x.astype(np.uint64) for x in got[:k]], got[k:]


def _numbers(held: list[np.ndarray], words: Words, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of all texts' words (-1 where unknown), each text behind ``pad`` starts (the vocabulary's size); the places of the words;
    and the numbers of the distinct words, which ascend but for unknown ones, with each word's row there."""
    distinct, _first, at = _distinct(np.concatenate(held))
    numbers = words.numbers(distinct)
    places = np.arange(len(at)) + np.repeat(np.arange(1, len(held) + 1) * pad, [len(x) for x in held])
    flat = np.full(len(at) + pad * len(held), words.starts[-1], np.int64)
    flat[places] = numbers[at]
    return flat, places, numbers, at


def _gram_counter(folder: str, bits: int, starts: np.ndarray, hot: np.ndarray, order: int):
    def run(batches):
        words = None
        for held in _flushes(batches, size=2 * FLUSH_TOKENS // order):
            words = words or _words(folder, bits, starts, "words")
            flat, at, _numbered, _row = _numbers(held, words, order - 1)
            packed, counts = _merged_grams(_packed([flat[at - k] for k in range(order - 1, -1, -1)]), [np.ones(len(at), np.uint8)])
            yield _blob_batch(_gram_blobs(order, _place(_columns(packed, order), hot, bits), packed, counts))

    return run


def _gram_writer(folder: str, bits: int, starts: np.ndarray, hot: np.ndarray, n: int):
    """Writes the shards of n-grams; passes on what the order below needs, and counts of counts (shard -n)."""

    def run(batches):
        sums, counts_of = [], np.zeros(4, np.int64)
        for shard, blobs in _by_shard(batches):
            if shard < 0:  # of an order above
                yield _blob_batch([(shard, b) for b in blobs])
                continue
            packed, fields = _merged_grams(*_grams_of(blobs, n))
            columns = _columns(packed, n)
            keys = _gram_key(columns)
            by = _hash_order(keys)
            write_arrays(f"{folder}/grams-{n}-{shard}", [*_key_arrays(keys[by]), *(x for f in fields for x in _compact(f[by]))])
            seen = fields[0] > 0  # others are contexts only
            columns, counts = [c[seen] for c in columns], fields[0][seen]
            counts_of += np.array([(counts == k).sum() for k in (1, 2, 3, 4)])
            one, two = (counts == 1).astype(np.uint8), (counts == 2).astype(np.uint8)
            more = np.uint8(1) - one - two
            zero = np.zeros(len(counts), np.uint8)
            below = [np.concatenate(x) for x in zip(_packed(columns[:-1]), _packed(columns[1:]), strict=True)]
            sums.append(_merged_grams(below, [np.concatenate(x) for x in ((zero, zero + np.uint8(1)), (counts, zero), (one, zero), (two, zero), (more, zero))]))
        if sums:
            packed, fields = _merged_grams(*([np.concatenate(x) for x in zip(*(s[k] for s in sums), strict=True)] for k in (0, 1)))
            if n > 2:
                shard = _place(_columns(packed, n - 1), hot, bits)
            else:
                shard = np.minimum(np.searchsorted(starts, packed[0].astype(np.int64), side="right") - 1, len(starts) - 1)
            yield _blob_batch([*_gram_blobs(n - 1, shard, packed, fields), (-n, _pack(counts_of))])

    return run


def _stats_writer(folder: str, bits: int, starts: np.ndarray):
    """Writes the vocabulary shards with all fields; gives counts of the numbers of words before, and the totals of the start."""

    def run(batches):
        for shard, blobs in _by_shard(batches):
            if shard < 0:
                n = np.sum([_unpack([b])[0] for b in blobs], axis=0)
                yield _totals(shard, [*n, 0, 0])
                continue
            got = _merged(*_keys_of(blobs))
            if shard == 1 << bits:  # the start has no shard of words
                yield _totals(shard, [0, *(int(x[0]) for x in got[1:])])
                continue
            words, counts = map_arrays(f"{folder}/words-{shard}")
            fields = np.zeros((5, len(words)), np.uint64)
            fields[:, got[0].astype(np.int64) - starts[shard]] = got[1:]
            write_arrays(f"{folder}/model-{shard}", [words, counts, *fields])
            before = fields[0]
            yield _totals(shard, [*((before == k).sum() for k in (1, 2, 3, 4)), (before > 0).sum(), before.sum()])

    def _totals(shard, values):
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([[int(v) for v in values]], pa.list_(pa.int64()))], ["shard", "totals"])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney's D1, D2, D3+ from the numbers of counts of 1 to 4; 0.5, 1 and 1.5 where a number is 0."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not all((n1, n2, n3, n4)):
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    got = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([min(max(d, 0.01), k) for d, k in zip(got, (1, 2, 3), strict=True)])


class Model:
    """What a worker needs beside the shards. ``gram_discounts`` by order."""

    def __init__(self, folder, bits, starts, hot, tokens, gram_discounts, word_discounts, pairs, word_mass, start):
        self.folder, self.bits, self.starts, self.hot, self.tokens = folder, bits, starts, hot, tokens
        self.gram_discounts, self.word_discounts, self.pairs, self.word_mass, self.start = gram_discounts, word_discounts, pairs, word_mass, start

    @property
    def vocabulary(self) -> int:
        return int(self.starts[-1])

    @property
    def order(self) -> int:
        return max(self.gram_discounts)

    def _grams(self, flat: np.ndarray, n: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the n-grams that end at some places, a row for each field and a column for each n-gram; and by place the column (the last: unknown)."""
        places = places[places >= n - 1]
        places = places[np.logical_and.reduce([flat[places - k] >= 0 for k in range(n)])]
        columns = [flat[places - k].astype(np.uint64) for k in range(n - 1, -1, -1)]
        keys, first, inverse = _distinct(_gram_key(columns))
        out = np.zeros((1 if n == self.order else len(FIELDS) - 1, len(keys) + 1))
        for k, (at, own) in _split(_place([c[first] for c in columns], self.hot, self.bits), np.arange(len(keys)), keys):
            arrays = _mapped(f"{self.folder}/grams-{n}-{k}")
            if arrays:
                i, hit = _find(arrays[:5], own)
                for f in range(len(out)):
                    out[f, at[hit]] = _expand(arrays[5 + 3 * f : 8 + 3 * f], i[hit])
        column = np.full(len(flat), len(keys))
        column[places] = inverse
        return out, column

    def score(self, held: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """Tokens, known tokens, base score and score of each text."""
        words = _words(self.folder, self.bits, self.starts, "model")
        flat, at, numbers, row = _numbers(held, words, self.order - 1)
        known = numbers >= 0
        distinct = numbers[known]
        fields = np.zeros((len(FIELDS), len(distinct) + 2))  # at the end: unknown, start
        fields[:, : len(distinct)] = words.fields(distinct)
        fields[2:, -1] = self.start
        column = np.full(len(flat), len(distinct) + 1)
        column[at] = np.where(known, np.cumsum(known) - 1, len(distinct))[row]
        count, continued = fields[0][column[at]], fields[1][column[at]]
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
        low = lambda c, d: np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0)))
        p = np.maximum(continued - low(continued, self.word_discounts), 0) / max(self.pairs, 1) + self.word_mass / (self.vocabulary + 1)
        fields = fields[1:]
        for n in range(2, self.order + 1):
            total, once, twice, more = (fields[k][column[at - 1]] for k in (1, 2, 3, 4))
            d, safe = self.gram_discounts[n], np.maximum(total, 1)
            left = (d[0] * once + d[1] * twice + d[2] * more) / safe
            fields, column = self._grams(flat, n, at if n == self.order else np.arange(len(flat)))
            c = fields[0][column[at]]
            p = np.where(total > 0, np.maximum(c - low(c, d), 0) / safe + left * p, p)
        ends = np.cumsum([len(x) for x in held])
        starts = ends - [len(x) for x in held]
        return list(zip((ends - starts).tolist(), np.add.reduceat(count > 0, starts, dtype=np.int64).tolist(), np.add.reduceat(base, starts).tolist(), np.add.reduceat(np.log10(p), starts).tolist(), strict=True))


_MAPPED: dict[str, list[np.ndarray]] = {}


def _mapped(path: str) -> list[np.ndarray]:
    if path not in _MAPPED:
        if len(_MAPPED) > 4096:
            _MAPPED.clear()
        _MAPPED[path] = map_arrays(path)
    return _MAPPED[path]


def _scorer(model: Model):
    def run(batches):
        held, keys = [], []

        def flush():
            got = list(zip(*model.value.score(held), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2]), pa.array(got[3])], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        n = 0
        for batch in small(batches):
            for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_tokens(text))
                keys.append((doc_id, held_out))
                n += len(held[-1])
                if n >= 2 * FLUSH_TOKENS // model.value.order:
                    yield flush()
                    held, keys, n = [], [], 0
        if held:
            yield flush()

    return run


def fit(texts: DataFrame, order: int = 2) -> Model:
    """Count all texts (one string column; null is an empty text, which has the end alone) and write the model below the shared folder."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = texts.sparkSession
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (2 * tasks - 1).bit_length())
    folder = scratch_path(spark, "kneser-ney")
    blobs = "shard int, blob binary"

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "shard").sortWithinPartitions("shard")

    words = stored_alone(dealt(texts.mapInArrow(_word_counter(bits), blobs)).mapInArrow(_word_writer(folder), "shard int, words long, tokens long"), "words").collect()  # one row per shard
    sizes = np.zeros(1 << bits, np.int64)
    for r in words:
        sizes[r["shard"]] = r["words"]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    tokens = sum(r["tokens"] for r in words)
    if starts[-1] >= 1 << 32:
        raise ValueError("word numbers of 32 bits are too few for this vocabulary")
    hot = _hot_words(spark, folder, bits, starts, tokens, tasks)
    grams = texts.mapInArrow(_gram_counter(folder, bits, starts, hot, order), blobs)
    for n in range(order, 1, -1):
        grams = stored_alone(dealt(grams).mapInArrow(_gram_writer(folder, bits, starts, hot, n), blobs), f"grams-{n}")
    totals = {r["shard"]: np.array(r["totals"]) for r in stored(dealt(grams).mapInArrow(_stats_writer(folder, bits, starts), "shard int, totals array<long>"), "totals").collect()}
    zero = np.zeros(6, np.int64)
    start = totals.pop(1 << bits, zero)[2:]
    d = {n: discounts(totals.pop(-n, zero)[:4]) for n in range(2, order + 1)}
    n = sum(totals.values(), zero)
    e = discounts(n[:4])
    number_of_pairs = int(n[5])
    mass = float(e[0] * n[0] + e[1] * n[1] + e[2] * (n[4] - n[0] - n[1])) / number_of_pairs if number_of_pairs else 1.0
    return Model(folder, bits, starts, hot, tokens, d, e, number_of_pairs, mass, start)


def _hot_words(spark, folder: str, bits: int, starts: np.ndarray, tokens: int, tasks: int) -> np.ndarray:
    """Numbers of the words with more than a 16th of a task's share of all tokens, at most 16 x tasks, and of the start."""
    share = max(1, tokens // (16 * tasks))

    def find(batches):
        for batch in small(batches):
            for k in batch.column(0).to_pylist():
                arrays = map_arrays(f"{folder}/words-{k}")
                if arrays:
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(arrays[1] > share) + starts[k])], ["number"])

    rows = spark.range(1 << bits).repartition(min(tasks, 64)).mapInArrow(find, "number long").collect()
    return np.array([*sorted(r["number"] for r in rows), int(starts[-1])], np.uint64)


def perplexity_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, fold: int = 0, order: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``docs``.

    A word's context is the ``order`` - 1 words before it. The model is learnt from the rows whose crc32(id as text) modulo ``folds`` is not ``fold``. Null texts are empty: one end token. A null id is
    not held out; repeated rows count as often as they stand; other columns are not read. Where no row is left to learn from, all
    words are unknown and ``score`` is 0 for each token, V + 1 being 1."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), hold_out(F.col(id_col), folds, fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = fit(own.where("not held_out").select("text"), order)
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = own.mapInArrow(_scorer(held), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
