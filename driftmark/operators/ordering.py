"""Ordered computations over groups of any size, by prefix sums over range partitions.

A window puts a whole group into one task, and one season or one company may hold a third of all
documents. So rows are sorted by (group, order) into range partitions: a group may fill many partitions
and a partition hold many groups, whatever their sizes. The sorted rows are written once, with the
number of their partition and their place in it, and read from there. One total per (group, partition),
summed along the partitions, is joined back as the offset of what lies inside. The number of partitions is
Spark's own (``spark.sql.shuffle.partitions``, merged by adaptive execution where they are small); nothing
is cut by literals, and nothing limits it.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftmark.session import checkpointed

PART, PLACE = "part_no", "place_no"
Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
# monotonically_increasing_id counts the rows of a partition in its lower 33 bits
_IN_PARTITION = (1 << 33) - 1


def with_columns(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], names=[*batch.schema.names, *columns])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None, *, then: Sequence[str] = (),
           scan: Scan | None = None, adds: str = "") -> DataFrame:
    """``df`` sorted by (keys, order) and written, with ``part_no`` and the row's ``place_no`` in that partition.

    Rows equal in all of (keys, order) share a partition, sorted by ``then``. ``slices`` fixes the number of partitions.
    ``scan`` goes along the sorted batches of a partition and adds the columns ``adds`` to them.
    """
    columns = [*keys, *order]
    dealt = df.repartitionByRange(slices, *columns) if slices else df.repartitionByRange(*columns)
    dealt = dealt.sortWithinPartitions(*columns, *then)
    if scan:
        dealt = dealt.mapInArrow(scan, StructType([*df.schema.fields, *StructType.fromDDL(adds).fields]))
    return checkpointed(dealt.select(
        "*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias(PLACE)))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``inside``: the sum of ``weight_n`` over the rows before, whatever their group."""
    done = 0
    for batch in batches:
        upto = done + np.cumsum(weight := batch.column("weight_n").to_numpy())
        done = int(upto[-1]) if len(upto) else done
        yield with_columns(batch, inside=upto - weight)


def _along(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def _carried(placed: DataFrame, keys: Sequence[str], n: Column) -> DataFrame:
    """``(keys…, part_no, carried, total, first_place)``: what lies in the partitions before, and in all."""
    totals = placed.groupBy(*keys, PART).agg(F.sum(n).alias("slice_n"), F.min(PLACE).alias("first_place"))
    return totals.select(*keys, PART, "first_place", F.coalesce(F.sum("slice_n").over(_along(keys)), F.lit(0)).alias("carried"),
                         F.sum("slice_n").over(Window.partitionBy(*keys)).alias("total"))


def running_counts(df: DataFrame, keys: Sequence[str], order: str, n: str | Column, slices: int | None = None) -> DataFrame:
    """Add ``below`` (sum of ``n`` over earlier rows of the group) and ``total``.

    Rows must be unique in (keys, order).
    """
    weight = F.coalesce((F.col(n) if isinstance(n, str) else n).cast("long"), F.lit(0).cast("long"))
    placed = ranged(df.withColumn("weight_n", weight), keys, [order], slices, scan=_running, adds="inside long")
    # where a group begins in a partition, the running sum tells what other groups lie before it
    totals = placed.groupBy(*keys, PART).agg(F.sum("weight_n").alias("slice_n"), F.min("inside").alias("others"))
    carried = F.coalesce(F.sum("slice_n").over(_along(keys)), F.lit(0)) - F.col("others")
    offsets = totals.select(*keys, PART, carried.alias("carried"), F.sum("slice_n").over(Window.partitionBy(*keys)).alias("total"))
    return (placed.join(offsets, [*keys, PART])
            .withColumn("below", F.col("carried") + F.col("inside"))
            .drop("carried", "inside", "weight_n", PART, PLACE))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Add the 1-based ``position`` of each row in its group and the group's ``total``.

    A row's place in its partition is known from the sort, so no window is opened over rows.
    """
    placed = ranged(df, keys, order, slices)
    return (placed.join(_carried(placed, keys, F.lit(1)), [*keys, PART])
            .withColumn("position", F.col("carried") + F.col(PLACE) - F.col("first_place") + 1)
            .drop("carried", "first_place", PART, PLACE))


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str, slices: int | None = None) -> DataFrame:
    """Add ``out``: the value of ``column`` on the group's row before this one."""
    placed = ranged(df, keys, order, slices)
    ends = placed.groupBy(*keys, PART).agg(F.max_by(F.struct(column), PLACE).alias("slice_end"), F.min(PLACE).alias("first_place"))
    carry = ends.select(*keys, PART, "first_place", F.lag("slice_end").over(Window.partitionBy(*keys).orderBy(PART)).getField(column).alias("carried"))
    inside = F.lag(column).over(Window.partitionBy(*keys, PART).orderBy(PLACE))
    return (placed.withColumn("inside", inside).join(carry, [*keys, PART])
            .withColumn(out, F.when(F.col(PLACE) == F.col("first_place"), F.col("carried")).otherwise(F.col("inside")))
            .drop("carried", "inside", "first_place", PART, PLACE))
