"""Quality rules whose cutoffs come with a bound on false rejections.

A rule rejects a text if one of its measures lies above a cutoff. Labelled texts are split by a hash of the id: one part proposes, for each
stratum and rule, the cutoff that catches most bad texts for the good ones it costs; the other part certifies. Cutoffs are tested
from the strictest to the proposed one in a fixed order, each by the exact binomial test of "more than ``risk`` / rules of the good texts are
rejected", and testing stops at the first that fails, so the order needs no correction; the tests of all strata and rules share the
error ``delta`` by Bonferroni's correction. With probability 1 - ``delta`` no stratum then loses more than ``risk`` of its good texts to the rules.
A rule without a certified cutoff rejects nothing, and neither does a stratum without labels.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small, stored, window_hashes, word_hashes

RISK, DELTA = 0.03, 0.1
#: Good texts that a proposed cutoff may cost for each bad one it catches.
COST = 0.2
REPEAT_WINDOW = 8
#: Cutoffs of every measure, the strictest first.
GRID = tuple(float(x) for x in np.geomspace(1.0, 0.005, 24)[1:])
RULES = ("symbols", "upper", "marks", "repeats", "dup_lines", "one_word")
BROADCAST_ROWS = 100_000
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, symbols double, upper double, marks double, repeats double, dup_lines double, one_word double"


def measure(text: str | None) -> tuple:
    """The five counts, then the rules' measures (shares between 0 and 1): symbols, upper-case letters and exclamation or question marks by
    characters of words, words in repeated windows by words, repeated lines by lines, and the commonest word by words."""
    if not text:
        return 0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    data = text.encode("utf-8", "replace")
    words = word_hashes(data)
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, _SPACES)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines, seen, dup = 0, set(), 0
    for line in data.split(b"\n"):
        if line.strip(_SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n >= REPEAT_WINDOW:
        _values, back, count = np.unique(window_hashes(words, REPEAT_WINDOW), return_inverse=True, return_counts=True)
        edge = np.zeros(n + 1, np.int64)
        twice = np.flatnonzero(count[back] > 1)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + REPEAT_WINDOW, -1)
        repeated = int((np.cumsum(edge)[:-1] > 0).sum())
    upper = sum(1 for c in text if c.isupper()) if not text.isascii() else len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(data) - len(data.translate(None, b"!?"))
    top = int(np.unique(words, return_counts=True)[1].max()) if n else 0
    share = lambda a, b: min(1.0, a / b) if b else 0.0
    return n, chars, symbols, dup, repeated, share(symbols, chars), share(upper, chars), share(marks, chars), share(repeated, n), share(dup, lines), share(top, n) if n >= 20 else 0.0


def _measurer(batches):
    names = ["doc_id", "text_key", "stratum", *(x.split()[0] for x in MEASURES.split(", "))]
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 6]
    for batch in small(batches):
        doc_id, text_key, stratum, texts = (c.to_pylist() for c in batch.columns)
        rows = [(i, k, s, *measure(t)) for i, k, s, t in zip(doc_id, text_key, stratum, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


def certified(rejected: list[int], n: int, risk: float, error: float) -> int:
    """How many cutoffs, from the strictest on, are shown to reject at most ``risk`` of good texts: each test's error is ``error``."""
    for k, r in enumerate(rejected):
        if n == 0 or binomial_tail(r, n, risk) > error:
            return k
    return len(rejected)


def _chooser(risk: float, delta: float, cost: float, tests: int):
    """One row per stratum: the cutoffs of its rules; infinite where a rule is not used."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": [key[0]]}
        for rule in RULES:
            own = rows[rows["rule"] == rule]
            above = {(part, quality): np.cumsum(np.bincount(g["bin"], g["n"], len(GRID) + 1)[::-1])[::-1] for (part, quality), g in own.groupby(["part", "quality"])}
            none = np.zeros(len(GRID) + 1)
            get = lambda part, quality: above.get((part, quality), none)[::-1]  # noqa: E731, B023
            # Bin b holds the measures above b cutoffs (counted from the loosest), so a cutoff's rejections are a tail of bins.
            gain = get("propose", 0)[:-1] - get("propose", 1)[:-1] / cost
            best = int(np.argmax(gain)) + 1 if gain.max(initial=0) > 0 else 0
            good = get("certify", 1)
            sure = certified([int(x) for x in good[:best]], int(good[-1]), risk / len(RULES), delta / tests)
            out[f"cut_{rule}"] = [GRID[sure - 1] if sure else float("inf")]
        return pd.DataFrame(out)

    return run


def cutoffs(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", risk: float = RISK, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """``stratum`` and ``cut_<rule>`` of every stratum that has labels. Only counts by stratum, rule and cutoff leave the join with the labels.

    Null labels and ids are left out; an id with several labels is good only if all say so."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("quality"))
    bins = [F.struct(F.lit(r).alias("rule"), functools.reduce(lambda a, b: a + b, ((F.col(r) > x).cast("int") for x in GRID)).alias("bin")) for r in RULES]
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0, "propose").otherwise("certify")
    counted = measured.select("doc_id", "stratum", *RULES).join(own, "doc_id").select("stratum", "quality", part.alias("part"), F.explode(F.array(*bins)).alias("b"))
    counts = stored(counted.groupBy("stratum", "quality", "part", "b.rule", "b.bin").agg(F.count("*").alias("n")), "quality-counts")
    strata = counts.select("stratum").distinct().count()
    schema = "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES)
    return counts.groupBy("stratum").applyInPandas(_chooser(risk, delta, cost, max(1, strata * len(RULES))), schema)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, ``rejected_by`` (the first rule that rejects, else null), one row per row of ``docs``.

    Null texts have no words and fail the base rules; a null stratum is a stratum of its own; repeated rows are judged alike, and count
    as often as they stand among the labelled ones; other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_key"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\u0000null")).alias("stratum"), text.alias("text"))
    measured = stored(own.mapInArrow(_measurer, "doc_id long, text_key long, stratum string, " + MEASURES), "measures")
    cuts = stored(cutoffs(measured, labels, **options), "cutoffs")
    side = F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts
    joined = measured.join(side, "stratum", "left")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    by = F.coalesce(*(F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES), F.lit(None).cast("string"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & by.isNull()).alias("kept"), by.alias("rejected_by"))
