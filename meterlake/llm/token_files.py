"""Token-ID output: Parquet files with an integer list column per document.

``write_token_files`` encodes whole texts and writes one row per document in ascending id order. The files use
Parquet's own encodings: dictionary pages for the ids (a vocabulary of some ten thousand values) or, with writer
version 2 and the dictionary off, delta encoding; row groups and pages are of stated sizes, and Parquet's column
and offset indexes let a reader take the metadata columns alone, or the ids of a range of documents alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, scratch_path, small, text_batches
from .tokens import default_path, tokenizer

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 1 << 16
PAGE_ROWS = 2_000
#: Ids that go to the writer in one batch.
BATCH_IDS = 1 << 20
FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encoder(path: str, end_id: int):
    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        encode = tokenizer(path)
        out: list[tuple] = []

        def flush():
            keys, starts, arrays = zip(*out, strict=True)
            sizes = [len(a) for a in arrays]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), ids], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

        held = 0
        for batch in small(batches):
            for key, ids in zip(batch.column(0).to_pylist(), encode.encode(text_batches(batch)), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                out.append((key, start, ids))
                start += len(ids)
                held += len(ids)
                if held >= BATCH_IDS:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, partitions: int | None = None) -> None:
    """Encode every whole text and write ``doc_id, part, start_in_part, n_tokens, ids`` below ``path``.

    The documents are dealt by ranges of their id and sorted within a range, so files in the order of ``part``
    hold ascending ids; no task sees more than its range. ``encoding`` is ``dictionary`` or ``delta``. Null and empty
    texts give the end id alone; a null id stands first; rows with the same id stand beside each other in the order
    of their texts. Other columns are not read."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding}")
    spark = docs.sparkSession
    prepare(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(_encoder(tokenizer_path or default_path(), end_id), FILE_SCHEMA)
    (files.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.dictionary.page.size", 1 << 20).option("parquet.writer.version", "v2" if encoding == "delta" else "v1").parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids before a document in the whole output.

    A part's total comes from its metadata columns alone; there is one total per part, so the table of offsets is bounded by
    the number of partitions and is joined by broadcast."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, before long"))
    return files.join(offsets, "part").withColumn("start", F.col("before") + F.col("start_in_part")).select("doc_id", "start", "n_tokens", "ids")


def _digest(batches):
    """Unsigned crc32 of each id list as little-endian unsigned 32-bit integers."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        crcs = [zlib.crc32(np.asarray(ids.slice(i, 1).flatten()).astype("<u4").tobytes()) for i in range(len(ids))]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_digest(docs: DataFrame, **options) -> DataFrame:
    """Write all documents as token files, read the files back and give one row per document from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, **options)
    return read_token_files(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
