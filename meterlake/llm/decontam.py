"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every window of ``window`` consecutive item words (an item of fewer words is one window) is the set of its shingles of up to ``SHINGLE``
words. Containment is exact, so a window's necessary prefix is one shingle: the rarest one, counted over all documents. Document shingles
join the prefixes by hash; the shingle's place in the window gives the place where the window must start, which has to lie in the document
(positional and length bounds). The candidates of a document are then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, prepare, stored

WINDOW = 13
SHINGLE = 4
#: Rows of a broadcast side, at most; a larger side is joined by shuffle.
BROADCAST_ROWS = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(lowered, _BREAKS), "")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows ``wid, w, len, items`` of the items; the ids are strings."""
    own = items.select("item", "words").where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = own.select("item", "words", F.explode(F.sequence(F.lit(1), last + 1)).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(window)).alias("w"))
    return cut.groupBy("w").agg(F.collect_set("item").alias("items")).select(F.sha2(F.concat_ws(" ", "w"), 256).alias("wid"), "w", F.size("w").alias("len"), "items")


def _hashes(size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.col(f"z.{k}") for k in range(size)))


def _shingles(rows: DataFrame, keep: list[str], array: str, sizes: list[int]) -> DataFrame:
    """``keep``, the place ``pos`` and the hash ``h`` of every shingle of the sizes. Shingles never carry the whole array along."""
    widest = max(sizes)
    shifted = [F.col(array), *(F.slice(array, F.lit(k + 1), F.greatest(F.size(array), F.lit(1))) for k in range(1, widest))]
    at = rows.select(*keep, F.posexplode(F.arrays_zip(*(c.alias(str(k)) for k, c in enumerate(shifted)))).alias("pos", "z"))
    if sizes == [widest]:
        return at.where(F.col(f"z.{widest - 1}").isNotNull()).select(*keep, "pos", _hashes(widest).alias("h"))
    each = F.array_compact(F.array(*(F.when(F.col(f"z.{k - 1}").isNotNull(), _hashes(k)) for k in sizes)))
    return at.select(*keep, "pos", F.explode(each).alias("h"))


def item_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, n_words, hits`` for every row of ``docs``; ``hits`` has ``start`` (from 0), ``len`` and ``items`` of each
    occurrence of an item window, empty where none occurs.

    Null texts have no words; items without words have no windows; a null item id counts as the empty string. Rows of one id with
    different texts are told apart by ``text_key``; the same row twice gets the same result twice. Other columns are not read."""
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_key"), words(text).alias("words"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("words"))
    windows = stored(_windows(items, window), "item-windows")
    lengths = [r["len"] for r in windows.select("len").distinct().collect()]  # at most `window` values
    sizes = sorted({min(SHINGLE, k) for k in lengths})
    if not sizes:
        return own.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.array().cast("array<struct<start:int,len:int,items:array<string>>>").alias("hits"))
    parts = None
    for size in sizes:
        of = windows.where((F.col("len") >= size) & ((F.col("len") < SHINGLE) if size < SHINGLE else F.lit(True)) & (F.least("len", F.lit(SHINGLE)) == size))
        own_parts = _shingles(of, ["wid"], "w", [size])
        parts = own_parts if parts is None else parts.unionByName(own_parts)
    parts = stored(parts.withColumnRenamed("pos", "offset"), "item-shingles")

    found = _shingles(own.withColumn("n", F.size("words")), ["doc_id", "text_key", "n"], "words", sizes).join(checked(parts.select("h").distinct(), BROADCAST_ROWS), "h")
    found = stored(found, "shingle-places")
    rarity = found.groupBy("h").agg(F.count("*").alias("n_places"))
    rarest = parts.join(rarity, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n_places", F.lit(0)).alias("n"), "h", "offset")).alias("r"))
    prefixes = rarest.where("r.n > 0").join(windows, "wid").select(F.col("r.h").alias("h"), F.col("r.offset").alias("offset"), "len", "w", "items")
    prefixes = stored(prefixes, "prefixes")
    start = F.col("pos") - F.col("offset")
    candidates = found.join(checked(prefixes, BROADCAST_ROWS), "h").where((start >= 0) & (start + F.col("len") <= F.col("n"))).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(start.alias("start"), "len", "w", "items")).alias("candidates"))  # bounded by the document's words
    candidates = stored(candidates.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "candidates"), "candidates")
    # The texts are dealt by document at every size; words are cut again behind the shuffle, which moves the plain text.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_key"), text.alias("text"))
    side = candidates.hint("merge")
    joined = texts.join(side, texts.doc_id.eqNullSafe(side.c_id) & (texts.text_key == side.c_key), "left").select("doc_id", "text_key", words(F.col("text")).alias("words"), "candidates")
    same = F.filter(F.coalesce("candidates", F.array()), lambda c: F.slice("words", c["start"] + 1, c["len"]) == c["w"])
    return joined.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.transform(same, lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["items"].alias("items"))).alias("hits"))


def hit_words(hits: Column) -> Column:
    """Number of words that lie in any hit."""
    order = F.array_sort(F.transform(hits, lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["len"]).alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(order, zero, lambda a, c: F.struct((a["n"] + F.greatest(c["end"] - F.greatest(c["start"], a["reach"]), F.lit(0))).alias("n"), F.greatest(a["reach"], c["end"]).alias("reach")))["n"].cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated``: a document is contaminated if a twentieth of its words, and one at least, is hit."""
    hits = item_hits(docs, benchmark, **options)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda c: c["items"]))))
    counted = hits.select("doc_id", "text_key", "n_words", hit_words(F.col("hits")).alias("n_hit"), items.alias("items"))
    return counted.select("doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
