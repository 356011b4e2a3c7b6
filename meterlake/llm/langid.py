"""Language identification by unigram models over a fixed public vocabulary, summed over all segmentations.

For each language every piece of the vocabulary has a probability. A word's probability is the sum, over all its segmentations into pieces, of the
products of their probabilities; the forward algorithm gives it. A text's is the product over its words, and Bayes' rule gives the language.
The probabilities are fitted by expectation maximisation (forward-backward over the words of a bounded sample of labelled texts).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold_out, mix64, prepare, small, window_hashes
from .tokens import default_path

VOCABULARY = "piece_bpe_32k.model"
#: Texts of a language that the sample is expected to hold at most (all texts are predicted).
SAMPLE = 600
ROUNDS = 3
#: Characters of a word up to which probabilities are multiplied as they are; those of longer words would underflow, so their logarithms are added.
PLAIN = 24
#: Cells of the table of prefixes of words that are segmented together, at most (one word at least).
CELLS = 1 << 20
#: Added to every expected count.
PRIOR = 0.05
WORDS_HELD = 200_000
PIECE_CHARS = 1 << 20
#: Words that are segmented together.
CHUNK = 8_192
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str):
    """Lower-cased runs of letters, some at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text) and text[end - 1].isalnum():
            end += 1
        found = _LETTERS.findall(text[at:end].lower())
        # The pattern takes numeric signs such as a half for letters; they end a run.
        yield found if all(map(str.isalpha, found)) else [w for run in found for w in ("".join(c if c.isalpha() else " " for c in run)).split()]
        at = end


def _points(texts: list[str]) -> np.ndarray:
    return mix64(np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1))


class Pieces:
    """The vocabulary's pieces by text; a word starts with its border mark. Every character stands for itself at least."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        keep = dict.fromkeys(t for t in texts if all(c == "▁" or c.isalpha() for c in t))
        self.number = {t: i for i, t in enumerate(keep)}
        self.unknown = len(self.number)  # any character that is no piece
        self.by_length = {}
        for n in sorted({len(t) for t in self.number}):
            own = [t for t in self.number if len(t) == n]
            hashes = window_hashes(_points(own), n)[:: n]
            order = np.argsort(hashes)
            self.by_length[n] = hashes[order], np.array([self.number[t] for t in own])[order]


class Lattice:
    """All pieces that stand in some words (borders included): edges from a place to a later one, in the order of their ends."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.count = len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = _points(words)
        start = np.repeat(np.cumsum(size) - size, size)
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(points)) - start
        left = np.repeat(size, size) - place
        parts = []
        for n, (hashes, numbers) in pieces.by_length.items():
            at = np.flatnonzero(left >= n)
            own = window_hashes(points, n)[at] if len(at) else np.empty(0, np.uint64)
            i = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            found = hashes[i] == own
            number = numbers[i]
            if n == 1:
                number = np.where(found, number, pieces.unknown)
                found[:] = True
            parts.append((word[at[found]], place[at[found]], place[at[found]] + n, number[found]))
        self.word, self.start, self.end, self.piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((self.word, self.end))
        self.word, self.start, self.end, self.piece = (x[order] for x in (self.word, self.start, self.end, self.piece))
        self.size = size

    def _steps(self, place: np.ndarray, order: np.ndarray):
        """Edges grouped by a place, and by word within it: (place, edges, first edge of each word)."""
        cuts = np.flatnonzero(np.diff(place[order])) + 1
        for own in np.split(order, cuts) if len(order) else ():
            yield int(place[own[0]]), own, np.flatnonzero(np.concatenate([[True], np.diff(self.word[own]) != 0]))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of each prefix, [word, place, language]. prob: [piece, language]."""
        alpha = np.zeros((self.count, int(self.size.max()) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for j, own, first in self._steps(self.end, np.arange(len(self.end))):
            alpha[self.word[own[first]], j] = np.add.reduceat(alpha[self.word[own], self.start[own]] * prob[self.piece[own]], first, axis=0)
        return alpha

    def forward_logs(self, log_prob: np.ndarray) -> np.ndarray:
        """``forward`` in logarithms."""
        alpha = np.full((self.count, int(self.size.max()) + 1, log_prob.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for j, own, first in self._steps(self.end, np.arange(len(self.end))):
            alpha[self.word[own[first]], j] = _sum_logs(alpha[self.word[own], self.start[own]] + log_prob[self.piece[own]], first)
        return alpha

    def totals(self, prob: np.ndarray) -> np.ndarray:
        return self.forward(prob)[np.arange(self.count), self.size]

    def log_totals(self, prob: np.ndarray) -> np.ndarray:
        """Log probabilities of the words, over all their segmentations."""
        if self.size.max() <= PLAIN:
            return np.log(np.maximum(self.totals(prob), 1e-300))
        return self.forward_logs(np.log(prob))[np.arange(self.count), self.size]

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The pieces' expected numbers, [piece, language], if the words stand ``counts`` [word, language] times."""
        rows, order = np.arange(self.count), np.lexsort((self.word, self.start))
        if self.size.max() <= PLAIN:
            alpha = self.forward(prob)
            beta = np.zeros_like(alpha)
            beta[rows, self.size] = counts / np.maximum(alpha[rows, self.size], 1e-300)
            for i, own, first in reversed(list(self._steps(self.start, order))):
                beta[self.word[own[first]], i] += np.add.reduceat(beta[self.word[own], self.end[own]] * prob[self.piece[own]], first, axis=0)
            share = alpha[self.word, self.start] * prob[self.piece] * beta[self.word, self.end]
        else:
            logs = np.log(prob)
            alpha = self.forward_logs(logs)
            beta = np.full_like(alpha, -np.inf)
            beta[rows, self.size] = 0
            for i, own, first in reversed(list(self._steps(self.start, order))):
                beta[self.word[own[first]], i] = _sum_logs(beta[self.word[own], self.end[own]] + logs[self.piece[own]], first)
            share = np.exp(alpha[self.word, self.start] + logs[self.piece] + beta[self.word, self.end] - alpha[rows, self.size][self.word]) * counts[self.word]
        return np.stack([np.bincount(self.piece, share[:, k], len(prob)) for k in range(prob.shape[1])], 1)


def _sum_logs(logs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of groups that start at ``first``."""
    most = np.maximum.reduceat(logs, first, axis=0)
    size = np.diff(np.append(first, len(logs)))
    return most + np.log(np.add.reduceat(np.exp(logs - np.repeat(most, size, axis=0)), first, axis=0))


def chunked(words: list[str]):
    """Parts of a list of words (as their numbers) that are segmented together: the short ones in their order, the long ones by length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(size <= PLAIN)
    yield from (short[k : k + CHUNK] for k in range(0, len(short), CHUNK))
    long = np.flatnonzero(size > PLAIN)
    long = long[np.argsort(size[long], kind="stable")]
    while len(long):
        n = max(1, int((np.arange(1, len(long) + 1) * size[long] <= CELLS).sum()))
        yield long[:n]
        long = long[n:]


def marked(word: str) -> str:
    """The word with its border mark; all of it is segmented, whatever its length."""
    return "▁" + word


@dataclass
class Model:
    languages: list[str]
    prob: np.ndarray  # [piece, language]
    prior: np.ndarray  # log
    path: str


def train(counts: dict[str, dict[str, int]], texts: dict[str, int], path: str, rounds: int = ROUNDS) -> Model:
    """Fit from each language's word counts. ``texts``: numbers of texts, for the prior."""
    languages = sorted(texts)
    pieces = Pieces(path)
    seen: dict[str, np.ndarray] = {}
    for k, language in enumerate(languages):
        for word, n in counts.get(language, {}).items():
            seen.setdefault(marked(word), np.zeros(len(languages)))[k] += n
    words = list(seen)
    chunks = [(Lattice([words[i] for i in part.tolist()], pieces), np.array([seen[words[i]] for i in part.tolist()])) for part in chunked(words)]

    def settled(expectation: np.ndarray) -> np.ndarray:
        return (expectation + PRIOR) / (expectation + PRIOR).sum(0)

    # The first probabilities: as often as a piece stands anywhere in the words.
    first = np.zeros((len(pieces.number) + 1, len(languages)))
    for lattice, n in chunks:
        for k in range(len(languages)):
            first[:, k] += np.bincount(lattice.piece, n[lattice.word, k], len(first))
    prob = settled(first)
    for _ in range(rounds):
        prob = settled(sum((lattice.expected(prob, n) for lattice, n in chunks), np.zeros_like(prob)))
    total = sum(texts.values())
    return Model(languages, prob, np.log(np.array([texts[x] / total for x in languages])), path)


class Scorer:
    """Log probabilities of words, remembered."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.path)
        self.at: dict[str, int] = {}
        self.logs = np.empty((0, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        flat = [marked(w) for w in words]
        logs = np.empty((len(flat), self.logs.shape[1]))
        for part in chunked(flat):
            logs[part] = Lattice([flat[i] for i in part.tolist()], self.pieces).log_totals(self.model.prob)
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.logs = np.concatenate([self.logs, logs])

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The languages' log probabilities of texts; None for a text without a letter. The texts' new words are learnt together."""
        if len(self.at) > WORDS_HELD:
            self.at, self.logs = {}, self.logs[:0]
        each = [list(words_of(t)) if t else [] for t in texts]
        if new := {w for text in each for words in text for w in words} - self.at.keys():
            self.learn(list(new))
        out = []
        for text in each:
            at = np.fromiter((self.at[w] for words in text for w in words), np.int64)
            out.append(self.logs[at].sum(0) if len(at) else None)
        return out


def _counter(batches):
    for batch in small(batches):
        counts: dict[tuple[str, str], int] = {}
        for language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for words in words_of(text or ""):
                for w in words:
                    counts[language, w] = counts.get((language, w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def _predictor(model):
    def run(batches):
        scorer = None
        for batch in small(batches):
            scorer = scorer or Scorer(model.value)
            languages, prior = model.value.languages, model.value.prior
            doc_id, held_out, texts = (c.to_pylist() for c in batch.columns)
            predicted, scores = [], []
            for logs in scorer.texts(texts) if languages else [None] * len(texts):
                if logs is None:
                    predicted.append("und")
                    scores.append(0.0)
                    continue
                logs = logs + prior
                p = np.exp(logs - logs.max())
                k = int(np.argmax(logs))
                predicted.append(languages[k])
                scores.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, path: str | None = None) -> Model:
    """Learn from rows with a language: of each language all rows, or rows drawn by a hash of id and text so that ``sample`` are expected."""
    prepare(docs.sparkSession)
    path = path or default_path(VOCABULARY)
    own = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"))
    texts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not texts:
        return Model([], np.zeros((1, 0)), np.zeros(0), path)
    share = F.create_map(*(x for lang, n in texts.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))))[F.col("lang")]
    drawn = own.where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    rows = drawn.mapInArrow(_counter, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True)):
        counts.setdefault(lang, {})[word] = n
    return train(counts, texts, path)


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per row of ``docs``.

    Learns from rows with a language whose crc32(id as text) modulo ``folds`` is not ``fold``; the language is not read otherwise. Null texts and texts
    without a letter are ``und`` with score 0, and so is every text where nothing can be learnt. Runs of letters of any length are segmented whole, a very
    long text's in pieces of about a million characters between words. ``score`` is the posterior of the language. Ties go to the
    language that sorts first."""
    held = hold_out(F.col(id_col), folds, fold)
    model = fit(docs.where(~held), id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    table = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_predictor(table), "doc_id long, held_out boolean, lang_pred string, score double")
