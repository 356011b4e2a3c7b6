"""Ordered scan: running positions and running last valid values over a whole table, without a window over it.

1. The rows are dealt by range of (keys, order) and sorted inside each range. Ties stand in the order of a hash of the row, which is part of the
   range key too, so a value that a third of all rows share is still cut into many ranges.
2. Every range is run through once, batch by batch: each row gets its position within its key and the last valid values so far, and
   the rows are written to the shared folder. A range also writes two marker rows beside them: its first key, and its last key with the state reached there.
3. The markers (two rows a range, whatever the number of rows) are read alone, and the state that a range's first key brings along from
   the ranges before it is settled from them. It is joined to the rows by range, as a broadcast of one row a range.

So the input is read for the range bounds (Spark's sampling) and once for the rows. What is scanned backwards is sorted descending.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.operators._util import col
from meterlake.session import shared_dir

ROWS, FIRST, LAST = 0, 1, 2
# Columns that the written table has beside the input's; prefixed so that they don't meet the caller's.
_KIND, _RANGE, _AT, _HEAD = "_scan_kind", "_scan_range", "_scan_at", "_scan_head"


def changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Whether each row's keys differ from the row before; NULL equals NULL. The first row counts as no change."""
    out = np.zeros(n, bool)
    for c in columns:
        differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), False)
        one_null = pc.not_equal(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1)))
        out[1:] |= pc.or_(differs, one_null).to_numpy(zero_copy_only=False)
    return out


def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.concat_arrays([a, b])


def _runner(columns: list[str], keys: list[str], fills: list[str], schema: pa.Schema):
    """Rows of one range with running state, then the two marker rows."""

    def marker(part: int, kind: int, key: list[pa.Array], at: int, head: bool, fill: list[pa.Array]) -> pa.RecordBatch:
        given = dict(zip(keys, key, strict=True)) | dict(zip(fills, fill, strict=True))
        given |= {_KIND: pa.array([kind], pa.int32()), _RANGE: pa.array([part], pa.int32()), _AT: pa.array([at], pa.int64()), _HEAD: pa.array([head])}
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(1, f.type) for f in schema], schema=schema)

    def run(batches):
        part = TaskContext.get().partitionId()
        first = key = fill = None
        at, head = 0, True  # rows of the present key so far; whether it is the range's first key
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            now = [batch.column(columns.index(k)) for k in keys]
            values = [batch.column(columns.index(f)) for f in fills]
            if first is None:
                first = key = [c.slice(0, 1) for c in now]
                fill = [pa.nulls(1, v.type) for v in values]
            change = changes([_joined(k, c) for k, c in zip(key, now, strict=True)], n + 1)[1:]
            start = np.maximum.accumulate(np.where(change, np.arange(n), -1))  # first row of the row's key here; -1: it goes on from before
            place = np.arange(n) - np.maximum(start, 0) + np.where(start < 0, at, 0)
            out_fill = []
            for f, v in zip(fill, values, strict=True):
                both = _joined(f, v)  # the state, then the rows
                valid = both.is_valid().to_numpy(zero_copy_only=False)
                last = np.maximum.accumulate(np.where(valid, np.arange(n + 1), -1))[1:]
                known = last >= np.where(start < 0, 0, start + 1)
                out_fill.append(both.take(pa.array(np.where(known, last, 0), mask=~known)))
            heads = (start < 0) & head
            done = dict(zip(columns, batch.columns, strict=True)) | dict(zip(fills, out_fill, strict=True))
            done |= {_KIND: pa.array(np.full(n, ROWS, np.int32)), _RANGE: pa.array(np.full(n, part, np.int32)), _AT: pa.array(place), _HEAD: pa.array(heads)}
            yield pa.RecordBatch.from_arrays([done[f.name].cast(f.type) for f in schema], schema=schema)
            key, fill, at, head = [c.slice(n - 1, 1) for c in now], [f.slice(n - 1, 1) for f in out_fill], int(place[-1]) + 1, bool(heads[-1])
        if first is not None:
            yield marker(part, FIRST, first, 0, True, [pa.nulls(1, f.type) for f in fill])
            yield marker(part, LAST, key, at, head, fill)

    return run


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with NULL allowed inside."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType), True)
    return kind


def ordered_scan(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), *, position: str | None = None, last_valid: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with the 0-based ``position`` of each row within its key in the given order, and for each of ``last_valid`` the last non-NULL
    value of that expression up to the row (the row's own included), NULL where there is none.

    ``order`` are sort expressions (``F.col(..).asc()`` and the like); rows that tie stand in the order of a hash of all their columns, so equal rows alone are
    interchangeable and the answer does not depend on how the input is partitioned. NULL keys are a key like any other.
    The result is a written table; ``ranges`` is the number of ranges (default: ``spark.sql.shuffle.partitions``)."""
    spark, keys, last_valid = df.sparkSession, list(keys), dict(last_valid or {})
    names = df.columns
    fills = [f"_scan_v{i}" for i in range(len(last_valid))]
    rows = df.withColumns({f: v for f, v in zip(fills, last_valid.values(), strict=True)}).withColumn("_scan_tie", F.xxhash64(*[col(c) for c in names]))
    rows = rows.select(*[col(f.name).cast(_nullable(f.dataType)).alias(f.name) for f in rows.schema.fields])
    sort = [*[col(k).asc_nulls_first() for k in keys], *order, F.col("_scan_tie").asc()]
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *sort).sortWithinPartitions(*sort).drop("_scan_tie")
    fields = [T.StructField(f.name, _nullable(f.dataType), True) for f in dealt.schema.fields]
    schema = T.StructType([*fields, T.StructField(_RANGE, T.IntegerType()), T.StructField(_AT, T.LongType()), T.StructField(_HEAD, T.BooleanType()), T.StructField(_KIND, T.IntegerType())])
    # The same schema as the workers see it.
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    path = shared_dir(spark, f"scan/{uuid.uuid4().hex}")
    dealt.mapInArrow(_runner(dealt.columns, keys, fills, arrow), schema).write.partitionBy(_KIND).parquet(path)
    written = spark.read.schema(schema).option("basePath", path).parquet(path)

    # Two markers a range: what each range's first key brings along.
    markers = written.where(F.col(_KIND) != ROWS).select(*[col(k) for k in keys], *fills, _RANGE, _AT, _HEAD, _KIND).collect()
    ends = sorted(markers, key=lambda r: (r[_RANGE], r[_KIND]))
    carried, state = [], None  # state: (key, rows, values) at the end of the ranges so far
    for r in ends:
        key = tuple(r[k] for k in keys)
        if r[_KIND] == FIRST:
            brought = state if state and state[0] == key else (key, 0, [None] * len(fills))
            carried.append((r[_RANGE], brought[1], *brought[2]))
        else:
            own = [r[f] for f in fills]
            if r[_HEAD]:  # one key fills the whole range
                own = [b if o is None else o for o, b in zip(own, carried[-1][2:], strict=True)]
            state = (key, r[_AT] + (carried[-1][1] if r[_HEAD] else 0), own)
    carry_schema = T.StructType([T.StructField("_scan_r", T.IntegerType()), T.StructField("_scan_before", T.LongType()), *[T.StructField(f"_scan_c{i}", schema[f].dataType) for i, f in enumerate(fills)]])
    carry = F.broadcast(spark.createDataFrame(carried, carry_schema))
    out = written.where(F.col(_KIND) == ROWS).join(carry, F.col(_RANGE) == F.col("_scan_r"), "left")
    done = {name: F.coalesce(F.col(f), F.when(F.col(_HEAD), F.col(f"_scan_c{i}"))) for i, (name, f) in enumerate(zip(last_valid, fills, strict=True))}
    if position:
        done[position] = F.col(_AT) + F.when(F.col(_HEAD), F.coalesce("_scan_before", F.lit(0))).otherwise(0)
    return out.select(*[col(c) for c in names if c not in done], *[c.alias(name) for name, c in done.items()])
