"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of itself, all hashed into one table; a text's vector is the mean of its words';
a linear softmax over it gives the score. Table and softmax are trained together in numpy on a bounded sample of labelled texts, whose
subword bags Spark makes. As everything before the softmax is linear, scoring needs one number per subword: workers hold that table and
remember words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, hold_out, mix64, pieces, prepare, small, window_hashes

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSIONS = 4
#: Labelled texts of either class in the training sample (as many are expected at most; all rows are scored).
SAMPLE_TOXIC, SAMPLE_OTHER = 1_500, 2_500
STEPS, MIN_EPOCHS, MAX_EPOCHS, BATCH, RATE = 1_200, 10, 40, 64, 1.0
#: Norm to which the sample's texts are scaled.
SCALE = 10.0
THRESHOLD = 0.7
_EDGE = b".,;:!?\"'()[]{}<>|*&$%#"


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams, with the words' borders marked, and of the words themselves; and the word of each."""
    points = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    values = mix64(points + np.uint64(1))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    number = np.arange(len(words))
    whole = np.add.reduceat(window_hashes(values, 1) * (np.arange(len(values), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64) + np.uint64(7)), start)
    hashes, of = [mix64(whole + size.astype(np.uint64))], [number]
    for n in SIZES:
        count = np.where(size > n, size - n + 1, 0)
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        hashes.append(mix64(window_hashes(values, n)[at] + np.uint64(n)))
        of.append(np.repeat(number, count))
    return (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64), np.concatenate(of)


def _words(text: str | None):
    """Lower-cased words of a text without punctuation at their ends, piece by piece."""
    if text:
        for piece in pieces(text.lower().encode("utf-8", "replace")):
            yield [w.decode("utf-8", "replace") for w in (x.strip(_EDGE) for x in piece.split()) if w]


def _bagger(buckets: int):
    """Each text's subwords and their weights, which sum to 1 (none for a text without words)."""

    def run(batches):
        for batch in small(batches):
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, value, n = [], [], 0
                for words in _words(text):
                    if not words:
                        continue
                    n += len(words)
                    counts = Counter(words)
                    bucket, of = subwords(list(counts), buckets)
                    share = np.fromiter(counts.values(), float, len(counts)) / np.bincount(of)
                    index.append(bucket)
                    value.append(share[of])
                at, back = np.unique(np.concatenate(index) if n else np.empty(0, np.int64), return_inverse=True)
                weight = np.bincount(back, np.concatenate(value) / n, len(at)) if n else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([weight.astype(np.float32)], pa.list_(pa.float32()))], ["label", "index", "value"])

    return run


@dataclass
class Model:
    weights: np.ndarray  # the softmax's margin for each bucket
    bias: float


def train(labels: np.ndarray, index: list[np.ndarray], value: list[np.ndarray], *, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, steps: int = STEPS, rate: float = RATE, share: float | None = None, seed: int = 7) -> Model:
    """Fit the embeddings and the softmax together by stochastic gradient descent with a falling rate.

    Subwords of one sample text alone are left out. A subword counts by the inverse root of its root mean square, between raw averages, where the commonest words would set the
    pace, and whitened ones, where the rarest would. ``share`` is the class 1's share of all labelled texts, if the sample has another: the bias is
    shifted to it. With labels of one class only, that class's share (of one extra text of either) is the score."""
    rng = np.random.default_rng(seed)
    n, n1 = len(labels), int(labels.sum())
    prior = float(np.log((n1 + 1) / (n - n1 + 1)))
    if n1 in (0, n):
        return Model(np.zeros(buckets, np.float32), prior)
    texts, square = np.zeros(buckets, np.int64), np.zeros(buckets)
    for i, v in zip(index, value, strict=True):  # text by text, so that no copy of the whole sample is made
        np.add.at(texts, i, 1)
        np.add.at(square, i, (v**2).astype(float))
    keep = texts >= 2
    square /= n
    factor = np.where(keep, np.maximum(square, 1e-12) ** -0.25, 0)
    used = np.flatnonzero(keep)
    factor *= SCALE / max(np.sqrt((square * factor**2).sum()), 1e-12)
    embed = rng.normal(0, 0.01, (len(used), dimensions))
    out = rng.normal(0, 0.5, (dimensions, 2))
    bias = np.array([0.0, prior])
    order, batches = rng.permutation(n), []
    # The entries of all batches lie in three arrays, which go back to the system as a whole; many small ones leave holes that the driver keeps.
    size, done = int(texts[keep].sum()), 0
    row, back, val = np.empty(size, np.uint16), np.empty(size, np.int32), np.empty(size, np.float32)
    for k in range(0, n, BATCH):
        rows = order[k : k + BATCH]
        kept = [index[i][keep[index[i]]] for i in rows]
        column, places = np.unique(np.concatenate(kept), return_inverse=True)
        own = slice(done, done := done + len(places))
        row[own] = np.repeat(np.arange(len(rows)), [len(x) for x in kept])
        back[own] = places
        val[own] = np.concatenate([value[i][keep[index[i]]] for i in rows]) * factor[column][places]
        batches.append((labels[rows].astype(int), row[own], np.searchsorted(used, column).astype(np.int32), back[own], val[own]))
    del kept, places
    epochs = max(MIN_EPOCHS, min(MAX_EPOCHS, steps // len(batches)))
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for b in rng.permutation(len(batches)):
            y, of, column, at, amount = batches[b]
            own = embed[column]
            text = np.stack([np.bincount(of, amount * own[at, d], len(y)) for d in range(dimensions)], 1)
            logits = text @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = p / len(y)
            d_text = g @ out.T
            embed[column] -= lr * np.stack([np.bincount(at, amount * d_text[of, d], len(column)) for d in range(dimensions)], 1)
            out -= lr * 0.1 * (text.T @ g)
            bias -= lr * 0.1 * g.sum(0)
    weights = np.zeros(buckets, np.float32)
    weights[used] = (embed @ (out[:, 1] - out[:, 0])) * factor[used]
    shift = float(np.log(share / (1 - share))) - float(np.log(n1 / (n - n1))) if share and share < 1 else 0.0
    return Model(weights, float(bias[1] - bias[0]) + shift)


class _Scores(dict):
    """Margins of words, remembered; NaN for what is punctuation alone."""

    def __init__(self, model: Model):
        self.model = model

    def _learn(self, words: list[bytes]) -> None:
        core = [w.strip(_EDGE).decode("utf-8", "replace") for w in words]
        real = [c for c in core if c]
        means = iter(())
        if real:
            bucket, of = subwords(real, len(self.model.weights))
            means = iter((np.bincount(of, self.model.weights[bucket]) / np.bincount(of)).tolist())
        self.update((w, next(means) if c else np.nan) for w, c in zip(words, core, strict=True))

    def texts(self, texts: list[str | None]) -> list[float]:
        """The scores of whole texts; their new words are learnt together."""
        if len(self) > CACHE_WORDS:
            self.clear()
        each = [[piece.split() for piece in pieces(t.lower().encode("utf-8", "replace"))] if t else [] for t in texts]
        new = {w for text in each for words in text for w in words} - self.keys()
        if new:
            self._learn(list(new))
        out = []
        for text in each:
            got = np.fromiter((self[w] for words in text for w in words), float)
            got = got[~np.isnan(got)]
            margin = self.model.bias + (float(got.mean()) if len(got) else 0.0)
            out.append(float(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))
        return out


def _scorer(model):
    def run(batches):
        scores = _Scores(model.value)
        for batch in small(batches):
            doc_id, held_out, texts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(scores.texts(texts), pa.float64())], ["doc_id", "held_out", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_other: int = SAMPLE_OTHER, **options) -> Model:
    """Train on a sample of labelled texts: of either class every row, or rows drawn by a hash of the id so that the stated number is expected.

    Null labels and ids are left out; an id with several labels counts as toxic if one of them is."""
    prepare(docs.sparkSession)
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    count = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(sample_toxic / max(count.get(1, 0), 1))).otherwise(F.lit(sample_other / max(count.get(0, 0), 1)))
    drawn = own.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")  # bounded by the sample
    bags = texts.select("label", "text").mapInArrow(_bagger(BUCKETS), "label int, index array<int>, value array<float>").toArrow()
    index, value = (bags.column(c) for c in ("index", "value"))
    lists = lambda col, kind: [np.asarray(x.values, kind) for x in col]
    if not bags.num_rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    index, value, label = lists(index, np.int32), lists(value, np.float32), np.array(bags.column("label").to_pylist())
    order = sorted(range(len(label)), key=lambda i: (label[i], len(index[i]), zlib.crc32(index[i].tobytes())))  # the fit doesn't depend on the order of arrival
    share = count.get(1, 0) / sum(count.values())
    del bags
    return train(label[order], [index[i] for i in order], [value[i] for i in order], share=share, **options)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    Learns from labels of ids whose crc32 as text modulo ``folds`` is not ``fold``. Null texts and texts without words get the softmax's bias alone;
    a null id is not held out; repeated rows get equal scores; other columns are not read."""
    held = hold_out(F.col(id_col), folds, fold)
    model = fit(docs, labels.where(~held), id_col=id_col, text_col=text_col, **options)
    table = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = own.mapInArrow(_scorer(table), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below the threshold."""
    table = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = _Scores(table.value)
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([s < threshold for s in scores.texts(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
