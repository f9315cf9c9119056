"""Exact places of rows inside their groups, with no task that holds a group.

Rows are dealt by ranges of (group, order), so a group that holds a third of
the table is spread over many tasks, and numbered in one pass inside each
range. The rows of a group that spans several ranges are then shifted by the
counts of the ranges before. Rows equal in every column of the order are
spread by a random number: they are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featflow.llm.store import written
from featflow.operators.joins import broadcast_if_small


def changes(batch: pa.RecordBatch, by: Sequence[str], last: list | None) -> np.ndarray:
    """True where a row's group differs from that of the row before."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[0] = last != [batch.column(c)[0].as_py() for c in by]
    for c in by:
        col = batch.column(c)
        a, b = col.slice(1), col.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def _numbered(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    last, count = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        i = np.arange(n)
        start = np.maximum.accumulate(np.where(changes(batch, by, last), i, -1))
        place = np.where(start < 0, i + count + 1, i - start + 1)
        last, count = [batch.column(c)[n - 1].as_py() for c in by], int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "__place"])


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str, tag: str) -> DataFrame:
    """``rows`` with ``name``: the 1-based place (long) of each in its group
    ``by``, ascending by ``order``, nulls first; null keys are a group. The
    numbered rows are written to the shared folder, so the order stands."""
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    spread = rows.withColumn("__tie", F.rand(11))
    dealt = spread.repartitionByRange(*keys, F.col("__tie")).sortWithinPartitions(*keys, "__tie").drop("__tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __place long"
    table, _ = written(dealt.mapInArrow(partial(_numbered, by=list(by)), schema).withColumn("__part", F.spark_partition_id()), tag)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy(*by, "__part").agg(F.max("__place").alias("__n"))
    shift = counts.withColumn("__shift", F.sum("__n").over(before)).where("__shift > 0")
    shift = shift.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), "__shift")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    placed = table.join(broadcast_if_small(shift), same, "left")
    return placed.select(*rows.columns, (F.col("__place") + F.coalesce("__shift", F.lit(0))).alias(name))
