"""Hourly energy (E2) maintained incrementally with Structured Streaming.

Every micro-batch's new readings are rolled up to (key, hour) kWh and written to a folder of their own
in the shared folder; the value of an hour is the sum of its parts (``current_hourly``). So there is no state between batches, and readings
count however late they arrive. A batch that runs again overwrites its folder, and restarting from
the same checkpoint location resumes exactly where the stream stopped.

Gap filling (empty hours = 0) is a batch step over the materialised table
(``resample.hourly_energy`` semantics); a stream cannot emit rows for hours
in which nothing arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.functions.energy import SAMPLES_PER_HOUR
from meterlake.session import shared_dir


def stream_path(path: str) -> str:
    """File-stream sources watch a folder or a glob. A single file is given
    as a glob that matches only itself (its last character as a class)."""
    import os
    if os.path.isdir(path) or any(ch in path for ch in "*?["):
        return path
    return f"{path[:-1]}[{path[-1]}]"


def hourly_energy_stream(spark: SparkSession, source: str, schema: T.StructType, value_col: str,
                         keys: list[str], ts_col: str = "ts", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of (keys, hour, kwh) of every reading; ``run_to_table`` adds them up."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(stream_path(source))
    hour = F.date_trunc("hour", F.col(ts_col)).cast("timestamp_ntz").alias("hour")
    return src.select(*keys, hour, (F.col(value_col) / F.lit(float(SAMPLES_PER_HOUR))).alias("kwh"))


def run_to_table(stream: DataFrame, table_path: str, checkpoint: str, available_now: bool = True,
                 processing_time: str | None = None):
    """Start the stream: every micro-batch is rolled up by keys and hour and written to a folder of its own below
    ``table_path``. ``available_now`` processes what is there and stops.

    A batch that runs again overwrites its own folder, so nothing counts twice. No state is kept between batches and no watermark is needed: a
    reading that arrives however late is a part of its hour in the batch that brings it."""
    groups = [c for c in stream.columns if c != "kwh"]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*groups).agg(F.sum("kwh").alias("kwh")).write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")

    w = stream.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def current_hourly(spark: SparkSession, table_path: str, keys: list[str]) -> DataFrame:
    """The value of every (keys, hour): the sum of its parts in the batches so far."""
    return spark.read.parquet(table_path).groupBy(*keys, "hour").agg(F.sum("kwh").alias("kwh"))


def stream_hourly_once(spark: SparkSession, source: str, schema: T.StructType, value_col: str,
                       keys: list[str], name: str, ts_col: str = "ts") -> DataFrame:
    """Run the stream over everything available into ``<shared>/streams/<name>``
    and return the current hourly table."""
    base = shared_dir(spark, f"streams/{name}")
    q = run_to_table(hourly_energy_stream(spark, source, schema, value_col, keys, ts_col),
                     f"{base}/table", f"{base}/checkpoint")
    q.awaitTermination()
    return current_hourly(spark, f"{base}/table", keys)
