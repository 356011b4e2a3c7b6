"""Registered streaming query: E2 maintained incrementally."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meterlake.plans.catalog import query
from meterlake.sources.tables import read_table
from meterlake.streaming.hourly import stream_hourly_once


@query("e02s_hourly_energy_stream", """select event_type as device, date_trunc('hour', ts) as hour,
  sum(value) / 60.0 as kwh from events group by all""")
def e02s(spark, sf):
    """E2 as a stream: the events file read by a file-stream source, rolled up
    per (device, hour) batch by batch, and the parts added up."""
    schema = read_table(spark, sf, "events").schema
    out = stream_hourly_once(spark, f"{sf.rstrip('/')}/events.parquet", schema, "value", ["event_type"],
                             f"events-hourly-{uuid.uuid4().hex}")
    return out.select(F.col("event_type").alias("device"), "hour", "kwh")
