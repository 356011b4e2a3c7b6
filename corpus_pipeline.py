"""A corpus through five of the training-data operators.

Documents that the toxicity model rejects go; one document of each group of linked documents stays; words of repeated windows are removed;
contaminated documents go; what is left is packed into sequences. Every stage but the last returns the columns of ``documents``.
``run`` writes each stage's rows to the shared folder and gives the next stage what it reads back.
"""

from pyspark.sql import functions as F

from meterlake.llm import decontam, jaccard, packing, substring, toxicity
from meterlake.llm.common import checked, hold_out, prepare, stored

BROADCAST_ROWS = 500_000


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs, gone):
    """``docs`` without the rows that ``gone`` names by ``doc_id`` and ``text_key``; few names are broadcast, more are joined by shuffle."""
    names = stored(gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "gone")
    side = checked(names, BROADCAST_ROWS)
    key = F.coalesce(F.xxhash64(docs["text"].cast("string")), F.lit(0))
    return docs.join(side, docs["doc_id"].eqNullSafe(side["_id"]) & (key == side["_key"]), "left_anti")


def drop_toxic(spark, docs, sf_dir):
    """Documents that the model, learnt from the labels outside its held-out fold, does not reject."""
    prepare(spark)
    held = hold_out(F.col("doc_id"), 3, 1)
    return toxicity.keep(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held)))


def one_of_each_group(spark, docs, sf_dir):
    """Of each component of linked documents (five-word shingles, similarity 0.8) the one with the smallest id, null ids last, and
    of those with that id the one with the smallest text key; of rows that are equal in id and text, one. Texts without words stay."""
    groups = stored(jaccard.labelled_components(docs), "groups")
    linked = groups.where("label is not null").withColumn("none", F.col("doc_id").isNull())
    first = linked.groupBy("label").agg(F.min(F.struct("none", "doc_id", "text_key")).alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.text_key").alias("_key"))
    gone = linked.join(first, linked["doc_id"].eqNullSafe(first["_id"]) & (linked["text_key"] == first["_key"]), "left_anti")
    kept = _without(docs, gone)
    if groups.groupBy("doc_id", "text_key").count().where("count > 1").head(1):
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def remove_repeats(spark, docs, sf_dir):
    """Documents without the words that repeated windows cover."""
    return substring.without_repeats(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that are not contaminated by the benchmark."""
    return _without(docs, decontam.contamination(docs, _table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack(spark, docs, sf_dir):
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", one_of_each_group), ("substring dedup", remove_repeats), ("decontamination", drop_contaminated), ("packing", pack)]

#: The toxicity model and the packing plan are not SQL; tests/llm holds the operators and the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    for k, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
