"""Set-similarity join of word n-grams as a blocked sparse matrix product.

The rows of the incidence matrix are the distinct shingle sets (copies are one row), its columns the shingles. A link needs an overlap
that follows from the two sizes, so only the columns of a row's prefix, in one order of all shingles, can be the first that two linked
rows share. The order puts shingles of rare words first and shingles that many documents hold last; both are estimated by a counting
pass over all documents, and any order gives the same links.

Prefix columns are dealt by shingle. Two cheap rounds find most links: in every column the most central row is the pivot of the others, every
row is verified over the whole sets against the pivot that it shares most columns with, in blocks of at most ``BLOCK`` rows; then the most
central row of each component in a column likewise. What is left are columns with rows of several components. Rows that may link there, by
label, place and the distance of their signatures, are gathered into clusters, and each cluster's incidence matrix is multiplied by its transpose in blocks of ``SIDE`` rows, chunk of columns by chunk,
accumulating overlap counts; pairs below the bound from their sizes are discarded. So every pair that can be linked lies in one
component already or is counted exactly, and no pairs leave a task but links that join components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lower_ascii, mix64, prepare, small, stored_alone, window_hashes, word_hashes
from .components import components

N = 5
PERCENT = 80
#: Rows of one verification block.
BLOCK = 256
#: Rows of one side of a block of the product.
SIDE = 512
#: Columns of the incidence matrix that are multiplied at once.
CHUNK = 2_048
#: Entries of the tables of frequent words and shingles that are broadcast, at most.
WORDS, SHINGLES = 1 << 14, 1 << 20
#: Entries of a column that one task pairs in the first round.
COLUMN = 100_000
#: Documents that are broadcast for verification, at most; more are joined by shuffle.
BROADCAST_ROWS = 300_000
FLUSH_BYTES = 8 << 20
#: Rows of a column that one task compares with as many others to form clusters; a longer column is dealt in pairs of its parts.
NARROW = 8_192
#: Bits of a signature, at most. Sets of up to about five times as many shingles are told apart by it.
SIGNATURE = 2_048


def shingle_set(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, sorted distinct hashes of the n-word shingles, and the first window of each. A shorter text is one shingle."""
    words = word_hashes(data)
    grams = mix64(window_hashes(words, min(n, len(words)))) if len(words) else words
    grams, at = np.unique(grams, return_index=True)
    return words, grams, at


def node_of(grams: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit values of a set; the first names it."""
    with np.errstate(over="ignore"):
        a = int(mix64(np.array([np.bitwise_xor.reduce(mix64(grams + np.uint64(2 * seed + 1))) + np.uint64(len(grams))]))[0])
        b = int(np.add.reduce(mix64(grams ^ np.uint64(0xA5A5A5A5 + seed))))
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def signature(grams: np.ndarray) -> bytes:
    """Of each place of a bit table whether an odd number of shingles falls there; about as many places as shingles. A shingle that only one of two
    sets holds turns one bit, so the signatures differ in no more places than the sets do."""
    bits = min(max(64, 1 << (len(grams) - 1).bit_length()), SIGNATURE)
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Signatures:
    """Signatures of some rows, the longer ones also folded in halves to each shorter length."""

    def __init__(self, each):
        self.words = np.array([len(x) for x in each]) // 8
        self.levels: dict[int, np.ndarray] = {}
        width, above = int(self.words.max(initial=0)), None
        while width:
            level = np.zeros((len(each), width), np.uint64)
            own = np.flatnonzero(self.words == width)
            if len(own):
                level[own] = np.frombuffer(b"".join([each[i] for i in own]), np.uint64).reshape(-1, width)
            if above is not None:
                level |= above[:, :width] ^ above[:, width:]
            self.levels[width] = above = level
            width //= 2

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Least number of shingles that only one of the rows ``i`` and ``j`` holds."""
        out = np.zeros(len(i), np.int64)
        width = np.minimum(self.words[i], self.words[j])
        for w in np.unique(width):
            at, level = np.flatnonzero(width == w), self.levels[int(w)]
            for k in range(0, len(at), 1 << 16):
                own = at[k : k + (1 << 16)]
                out[own] = np.bitwise_count(level[i[own]] ^ level[j[own]]).sum(1)
        return out


def needed(n1, n2, percent: int):
    """Least overlap of a link between sets of these sizes."""
    return (percent * (n1 + n2) + 99 + percent) // (100 + percent)


def prefix_size(n, percent: int):
    """Columns of a row of which a link shares one at least."""
    return n - (percent * n + 99) // 100 + 1


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


_SURVEY = ["kind", "doc_id", "text_key", "n", "node", "check", "hash", "count", "signature"]
_SURVEY_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _surveyor(n: int, seed: int):
    """Sizes, names and signatures of all sets; words and shingles that a task meets often among distinct sets."""

    def run(batches):
        words, grams, held, seen = [], [], 0, set()

        def often():
            rows = []
            for kind, arrays, least in ((1, words, 64), (2, grams, 4)):
                if arrays:
                    values, counts = np.unique(np.concatenate(arrays), return_counts=True)
                    keep = counts >= least
                    rows += [(kind, None, None, None, None, None, v, c, None) for v, c in zip(values[keep].view(np.int64).tolist(), counts[keep].tolist(), strict=True)]
            return rows

        for batch in small(batches):
            rows = []
            for doc_id, text_key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = lower_ascii(text) if text else b""
                w, g, _at = shingle_set(data, n)
                node, check = node_of(g, seed) if len(g) else (None, None)
                rows.append((0, doc_id, text_key, len(g), node, check, None, None, signature(g) if len(g) else None))
                if len(g) and node not in seen:
                    seen.add(node)
                    words.append(w)
                    grams.append(g)
                    held += len(data)
                if held >= FLUSH_BYTES:
                    rows += often()
                    words, grams, held, seen = [], [], 0, set()
            if rows:
                yield _batch(rows, _SURVEY_KINDS, _SURVEY)
        if rest := often():
            yield _batch(rest, _SURVEY_KINDS, _SURVEY)

    return run


def _ordered_prefix(words, grams, at, n, percent, common_words, weights, common_grams):
    """The prefix columns of a set in the order of all shingles."""
    size = prefix_size(len(grams), percent)
    weight = np.zeros(len(words), np.uint64)
    if len(common_words):
        i = np.minimum(np.searchsorted(common_words, words), len(common_words) - 1)
        weight = np.where(common_words[i] == words, weights[i], 0).astype(np.uint64)
    total = np.cumsum(np.concatenate([[0], weight])).astype(np.uint64)
    score = total[np.minimum(at + n, len(words))] - total[at]
    often = np.zeros(len(grams), np.uint64)
    if len(common_grams):
        i = np.minimum(np.searchsorted(common_grams, grams), len(common_grams) - 1)
        often = (common_grams[i] == grams).astype(np.uint64)
    key = often << np.uint64(63) | np.minimum(score, np.uint64(255)) << np.uint64(55) | grams >> np.uint64(9)
    return grams[np.argsort(key, kind="stable")[:size]]


def _entries(n: int, percent: int, seed: int, tables):
    def run(batches):
        common_words, weights, common_grams, grams_df = tables.value
        seen: set[int] = set()
        for batch in small(batches):
            h, node, size, pos, salt = [], [], [], [], []
            for _id, _key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, grams, at = shingle_set(lower_ascii(text) if text else b"", n)
                if not len(grams) or (name := node_of(grams, seed)[0]) in seen:
                    continue
                seen.add(name)
                got = _ordered_prefix(words, grams, at, n, percent, common_words, weights, common_grams)
                part = np.full(len(got), -1, np.int64)  # -1: the column is in one piece
                if len(common_grams):
                    i = np.minimum(np.searchsorted(common_grams, got), len(common_grams) - 1)
                    parts = np.where(common_grams[i] == got, -(-grams_df[i] // COLUMN), 1)
                    part = np.where(parts > 1, abs(name) % parts, -1)
                h.append(got)
                node.append(np.full(len(got), name, np.int64))
                size.append(np.full(len(got), len(grams), np.int64))
                pos.append(np.arange(len(got)))
                salt.append(part)
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(size) << 32 | np.concatenate(pos)), pa.array(np.concatenate(salt).astype(np.int32))], ["h", "node", "size_pos", "salt"])

    return run


ENTRY = "h long, node long, size_pos long, salt int"


def _columns(batches, keys: int):
    """The columns of a stream sorted by its first ``keys`` fields, as (whole columns' arrays, first row of each column)."""
    give_back()
    rest = None
    for batch in batches:
        now = [np.asarray(c) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate([a, b]) for a, b in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        new = np.zeros(len(now[0]), bool)
        new[0] = True
        for k in range(keys):
            new[1:] |= now[k][1:] != now[k][:-1]
        cuts = np.flatnonzero(new)
        rest = [a[cuts[-1] :] for a in now]
        if len(cuts) > 1:
            yield [a[: cuts[-1]] for a in now], cuts[:-1]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _may_link(n1, p1, n2, p2, percent):
    """Whether two rows that first meet in a column at these places can have the overlap that their sizes need."""
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (1 + np.minimum(n1 - p1, n2 - p2) - 1 >= needed(n1, n2, percent))


def _stars(percent: int):
    """For each column: pairs of its most central row with the rows it may link to, and so on with what is left (kind 0, with the number of
    columns of the batch in ``size_pos``); and the entries of columns with several rows (kind 1)."""
    names = ["kind", "a", "b", "h", "size_pos"]

    def run(batches):
        for (h, salt, node, size_pos), cuts in _columns(batches, 2):
            ends = np.append(cuts[1:], len(h))
            n, p = size_pos >> 32, size_pos & 0xFFFFFFFF
            keep = np.zeros(len(h), bool)
            a, b = [], []
            two = cuts[ends - cuts == 2]
            two = two[node[two] != node[two + 1]]
            keep[two] = keep[two + 1] = True
            keep |= salt >= 0
            two = two[_may_link(n[two], p[two], n[two + 1], p[two + 1], percent)]
            a.append(node[two])
            b.append(node[two + 1])
            for s, e in zip(cuts[ends - cuts > 2].tolist(), ends[ends - cuts > 2].tolist(), strict=True):
                _own, first = np.unique(node[s:e], return_index=True)
                at = s + first
                at = at[np.lexsort((node[at], p[at]))]
                if len(at) > 1:
                    keep[at] = True
                while len(at) > 1:
                    pivot, others = at[0], at[1:]
                    ok = _may_link(n[pivot], p[pivot], n[others], p[others], percent)
                    a.append(np.full(int(ok.sum()), node[pivot]))
                    b.append(node[others[ok]])
                    at = others[~ok]
            pairs, count = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0, return_counts=True)
            k = int(keep.sum())
            if len(pairs) + k:
                none = np.zeros(len(pairs), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(pairs), k]).astype(np.int32)), pa.array(np.concatenate([pairs[:, 0], node[keep]])), pa.array(np.concatenate([pairs[:, 1], np.zeros(k, np.int64)])), pa.array(np.concatenate([none, h[keep]])), pa.array(np.concatenate([count, size_pos[keep]]))], names)

    return run


def _may_overlap(near: Signatures, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether two rows' signatures allow the overlap that their sizes need."""
    return near.apart(i, j) <= n[i] + n[j] - 2 * needed(n[i], n[j], percent)


def _near_pairs(percent: int):
    def run(batches):
        for batch in small(batches):
            k, (a, b, n_a, n_b, own, other) = batch.num_rows, batch.columns
            near, at = Signatures([*own.to_pylist(), *other.to_pylist()]), np.arange(k)
            ok = _may_overlap(near, np.concatenate([np.asarray(n_a), np.asarray(n_b)]).astype(np.int64), at, at + k, percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x)[ok]) for x in (a, b)], ["a", "b"])

    return run


def _cluster_edges(percent: int):
    """Edges, fewer than entries, that connect the rows of a column which may link although their components differ. The rows come by column and
    pair of its parts; of two parts (``r`` below ``s``) the rows of one (``side``) are compared with those of the other."""

    def run(batches):
        for (_h, r, s, node, label, size_pos, side, each), cuts in _columns(batches, 3):
            ends = np.append(cuts[1:], len(node))
            cell = np.repeat(np.arange(len(cuts)), ends - cuts)
            by = np.lexsort((node, size_pos >> 32, cell))  # within each cell
            node, label, size_pos, side, each = (x[by] for x in (node, label, size_pos, side, each))
            n, p, end, whole = size_pos >> 32, size_pos & 0xFFFFFFFF, ends[cell], r == s
            near = Signatures(each)
            own, at = np.unique(node, return_inverse=True)
            parent = np.arange(len(own))  # what the edges connect already is not compared
            a, b, i, d = [], [], np.arange(len(node)), 0
            while len(i):  # rows d places apart
                d += 1
                i = i[i + d < end[i]]
                i = i[100 * n[i] >= percent * n[i + d]]  # sizes ascend
                x = i[(label[i] != label[i + d]) & (whole[i] | (side[i] != side[i + d]))]
                x = x[(parent[at[x]] != parent[at[x + d]]) & _may_link(n[x], p[x], n[x + d], p[x + d], percent)]
                x = x[_may_overlap(near, n, x, x + d, percent)]
                for y in x.tolist():
                    u, v = at[y], at[y + d]
                    while parent[u] != u:
                        u = parent[u]
                    while parent[v] != v:
                        v = parent[v]
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        a.append(node[y])
                        b.append(node[y + d])
                while len(x) and not np.array_equal(up := parent[parent], parent):
                    parent = up
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (a, b)], ["a", "b"])

    return run


def _block_sender(n: int):
    def run(batches):
        for batch in small(batches):
            rows = []
            for node, text, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = shingle_set(lower_ascii(text), n)[1].tobytes()
                rows += [(x["cluster"], x["r"], x["s"], x["side"], node, x["label"], grams) for x in blocks]
            for i in range(0, len(rows), 1024):
                yield _batch(rows[i : i + 1024], [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.binary()], ["cluster", "r", "s", "side", "node", "label", "grams"])

    return run


def _block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join components among the rows of one block of the product, by overlap counts over all shingles."""
    rows = list({r[1]: r for r in rows}.values())  # a row that stands twice in the table is one
    side = np.array([r[0] for r in rows])
    label = np.array([r[2] for r in rows])
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    size = np.array([len(x) for x in sets])
    grams, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    del grams
    row = np.repeat(np.arange(len(rows)), size)
    shared = df[column] > 1  # a shingle of one row adds nothing
    rank = np.cumsum(df > 1) - 1
    row, column = row[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if len(right) else left
    count = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        lo, hi = np.searchsorted(column, [at, at + CHUNK])
        part = np.zeros((len(rows), CHUNK), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        count += part[left] @ part[right].T
    union = size[left][:, None] + size[right][None, :] - count
    i, j = np.nonzero((100 * count >= percent * union) & (label[left][:, None] != label[right][None, :]))
    joined: dict[int, int] = {}
    out = []
    for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
        a, b = int(label[x]), int(label[y])
        while a in joined:
            a = joined[a]
        while b in joined:
            b = joined[b]
        if a != b:
            joined[max(a, b)] = min(a, b)
            out.append((rows[x][1], rows[y][1]))
    return out


def _blocks(percent: int):
    def run(batches):
        give_back()
        at, rows = None, []
        for batch in batches:
            for cluster, r, s, side, node, label, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (cluster, r, s) and rows:
                    yield _batch(_block_links(rows, percent), [pa.int64(), pa.int64()], ["a", "b"])
                    rows = []
                at = (cluster, r, s)
                rows.append((side, node, label, grams))
        if rows:
            yield _batch(_block_links(rows, percent), [pa.int64(), pa.int64()], ["a", "b"])

    return run


def _set_sender(n: int):
    def run(batches):
        for batch in small(batches):
            rows = []
            for node, text, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = shingle_set(lower_ascii(text), n)[1].tobytes()
                rows += [(x["p"], x["salt"], int(x["p"] != node), node, grams) for x in blocks]
            for i in range(0, len(rows), 4096):
                yield _batch(rows[i : i + 4096], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], ["p", "salt", "member", "node", "grams"])

    return run


def _verifier(percent: int):
    """Links of a pivot with the rows of its block. The pivot's own row comes first."""

    def run(batches):
        at, pivot = None, None
        for batch in small(batches):
            rows = []
            for p, salt, member, node, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(grams, np.uint64)
                if not member:
                    at, pivot = (p, salt), own
                    continue
                if at != (p, salt):
                    raise ValueError("a block without its pivot")
                i = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
                overlap = int((pivot[i] == own).sum())
                if 100 * overlap >= percent * (len(own) + len(pivot) - overlap):
                    rows.append((p, node))
            yield _batch(rows, [pa.int64(), pa.int64()], ["a", "b"])

    return run


def _texts_of(keyed: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text, blocks`` of the wanted nodes, from their representatives; few are broadcast, more are joined by shuffle."""
    wanted = stored_alone(wanted.join(classes, "node").select(F.col("rep.doc_id").alias("r_id"), F.col("rep.text_key").alias("r_key"), "node", "blocks"), "wanted")
    rows = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()
    side = F.broadcast(wanted) if rows[0] + rows[1] <= BROADCAST_ROWS else wanted
    return keyed.join(side, keyed.doc_id.eqNullSafe(side.r_id) & (keyed.text_key == side.r_key)).select("node", "text", "blocks")


def _verify(keyed: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int, tasks: int) -> DataFrame:
    """The links among ``pairs`` (pivot a, row b). Pairs whose signatures are too far apart are not sent."""
    for k in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("signature").alias(f"signature_{k}")), k)
    pairs = pairs.select("a", "b", "n_a", "n_b", "signature_a", "signature_b").mapInArrow(_near_pairs(percent), "a long, b long")
    pairs = stored_alone(pairs, "pairs")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "a").select(F.col("b").alias("node"), F.col("a").alias("p"), F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("salt"))
    pivots = blocks.select(F.col("a").alias("node"), F.col("a").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    wanted = dealt.unionByName(pivots).groupBy("node").agg(F.collect_list(F.struct("p", "salt")).alias("blocks"))
    sent = _texts_of(keyed, classes, wanted)
    sets = sent.mapInArrow(_set_sender(n), "p long, salt int, member int, node long, grams binary")
    return stored_alone(sets.repartition(tasks, "p", "salt").sortWithinPartitions("p", "salt", "member").mapInArrow(_verifier(percent), "a long, b long"), "links")


def _survey(keyed: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows of the survey, the classes, and the seed under which no two sets share a name."""
    for seed in range(8):
        survey = stored_alone(keyed.mapInArrow(_surveyor(n, seed), "kind int, doc_id long, text_key long, n int, node long, check long, hash long, count long, signature binary"), "survey")
        # The representative is the first row of the class; a null id stands last.
        own = survey.where("kind = 0 and node is not null")
        classes = stored_alone(own.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"), F.min("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.max("signature").alias("signature")), "classes")
        if not classes.where("low != high").head(1):
            return survey, classes, seed
    raise RuntimeError("sets share a name under every seed")


def similarity_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership ``doc_id, text_key, n, node`` of every row, classes ``node, rep, n``, and links ``a, b`` between different sets that
    connect what is connected: every pair of linked sets is linked here or lies in one component of these links."""
    spark = docs.sparkSession
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_key"), text.alias("text"))
    survey, classes, seed = _survey(keyed, n)

    often = survey.where("kind > 0").groupBy("kind", "hash").agg(F.sum("count").alias("count"))
    total = {r["kind"]: r["c"] for r in often.groupBy("kind").agg(F.sum("count").alias("c")).collect()}
    incidences = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # sum(count) <= incidences, so at most SHINGLES (WORDS) entries reach their share.
    common = often.where(((F.col("kind") == 1) & (F.col("count") > total.get(1, 0) // WORDS)) | ((F.col("kind") == 2) & (F.col("count") > max(16, incidences // SHINGLES)))).toPandas()
    words, grams = (common[common.kind == k] for k in (1, 2))
    order = [np.argsort(x["hash"].to_numpy(np.int64).view(np.uint64)) for x in (words, grams)]
    tables = spark.sparkContext.broadcast((
        words["hash"].to_numpy(np.int64).view(np.uint64)[order[0]], np.log2(words["count"].to_numpy(float)[order[0]] + 1).astype(np.int64),
        grams["hash"].to_numpy(np.int64).view(np.uint64)[order[1]], grams["count"].to_numpy(np.int64)[order[1]]))

    entries = keyed.mapInArrow(_entries(n, percent, seed, tables), ENTRY)

    def stars(of: DataFrame) -> DataFrame:
        dealt = of.select("h", "salt", "node", "size_pos").repartition(tasks, "h", "salt").sortWithinPartitions("h", "salt")
        return stored_alone(dealt.mapInArrow(_stars(percent), "kind int, a long, b long, h long, size_pos long"), "stars")

    def best_pivots(found: DataFrame) -> DataFrame:
        counted = found.where("kind = 0").groupBy("a", "b").agg(F.sum("size_pos").alias("c"))
        return counted.groupBy("b").agg(F.max(F.struct("c", "a")).alias("p")).select("p.a", "b")

    found = stars(entries)
    links = _verify(keyed, classes, best_pivots(found), n, percent, tasks)
    labels = components(links)
    kept = found.where("kind = 1").select("h", F.col("a").alias("node"), "size_pos").distinct()
    marked = kept.join(labels, "node", "left").select("h", "node", "size_pos", F.coalesce("label", "node").alias("label"))
    place = F.struct(F.col("size_pos").bitwiseAND(0xFFFFFFFF).alias("p"), "node", "size_pos")
    heads = marked.groupBy("h", "label").agg(F.min(place).alias("r"))
    found2 = stars(heads.select("h", F.lit(-1).alias("salt"), "r.node", "r.size_pos"))
    links = links.unionByName(_verify(keyed, classes, best_pivots(found2), n, percent, tasks))
    labels = components(links)

    marked = stored_alone(kept.join(labels, "node", "left").select("h", "node", F.coalesce("label", "node").alias("label"), "size_pos"), "marked")
    mixed = marked.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / NARROW).cast("int").alias("parts")).where("low != high").select("h", "parts")
    met = marked.join(mixed, "h").join(classes.select("node", "signature"), "node").withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("h", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("s"), "node", "label", "size_pos", (F.col("own") > F.col("other")).cast("int").alias("side"), "signature")
    edges = met.repartition(tasks, "h", "r", "s").sortWithinPartitions("h", "r", "s").mapInArrow(_cluster_edges(percent), "a long, b long")
    cluster = components(edges).withColumnRenamed("label", "cluster")
    cluster = stored_alone(cluster.join(labels, "node", "left").select("node", "cluster", F.coalesce("label", "node").alias("label")), "clusters")
    sides = cluster.groupBy("cluster").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("cluster", "sides")
    cells = cluster.join(sides, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), "sides").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    block = F.struct("cluster", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("s"), (F.col("own") > F.col("other")).cast("int").alias("side"), "label")
    sent = _texts_of(keyed, classes, cells.groupBy("node").agg(F.collect_list(block).alias("blocks")))
    sets = sent.mapInArrow(_block_sender(n), "cluster long, r int, s int, side int, node long, label long, grams binary")
    links = links.unionByName(stored_alone(sets.repartition(tasks, "cluster", "r", "s").sortWithinPartitions("cluster", "r", "s").mapInArrow(_blocks(percent), "a long, b long"), "links"))
    members = survey.where("kind = 0").select("doc_id", "text_key", "n", "node")
    return members, classes, links


def similarity_components(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links. Texts without words and null texts have no shingles and only their own id;
    shorter texts are one shingle. Rows with equal sets are linked; null ids take part, but are never the smallest."""
    return labelled_components(docs, **options).drop("label")


def labelled_components(docs: DataFrame, **options) -> DataFrame:
    """``similarity_components`` with a ``label`` that differs from component to component, also where ids are null or repeat; null without shingles."""
    members, classes, links = similarity_links(docs, **options)
    labels = components(links)
    placed = classes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    smallest = placed.groupBy("label").agg(F.min("rep.doc_id").alias("component_id"))
    of_node = placed.join(smallest, "label").select("node", "component_id", "label")
    linked = members.where("node is not null").join(of_node, "node").select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "component_id", "label")
    alone = members.where("node is null").select("doc_id", "text_key", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return linked.unionByName(alone)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document, for four-word shingles and a similarity of 0.85."""
    return similarity_components(docs, n=4, percent=85).drop("text_key")
