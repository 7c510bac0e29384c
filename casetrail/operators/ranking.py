"""Top-k, first-per-group and ordered-limit helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group.

    Spark turns ``row_number() <= k`` into a group limit that runs before the shuffle, so a hot
    group sends at most ``k`` rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The smallest row of every group by the ``order`` columns.

    ``min`` of a struct combines on the map side, so a hot group is reduced where it lies and
    no window has to sort it.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), ordered).alias("_first"))
        .select(*keys, *[F.col("_first")[c].alias(c) for c in rest])
    )


def newest_first(df: DataFrame, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Ordered list; with a ``limit`` planned as a distributed take of the best rows."""
    ordered = df.orderBy(*order)
    return ordered.limit(limit) if limit else ordered


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """``rows`` with their number (from 1) among the rows of their key in the given order, which has to tell rows apart.

    Rows are sorted over all tasks by key and order, so that a key of any size spreads over tasks; numbers are the place
    within a task plus the rows of the key in the tasks before it. Rows with a null key are left out.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    placed = write_through(rows.where(known).repartitionByRange(*keys, *order).withColumn(
        "_task", F.spark_partition_id()), "numbered")   # as a table, so that the tasks are those that sorted
    counts = placed.groupBy(*keys, "_task").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(*keys, "_task").orderBy(*order))
    return placed.join(base, [*keys, "_task"]).withColumn(out, F.col("_base") + within).drop("_task", "_base")
