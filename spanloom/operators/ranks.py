"""Exact ranks over a whole table without one sorted task: range partitions, their counts, and running sums of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.scratch import kept


def ranked(rows: DataFrame, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` (from 0) and ``size``: a row's exact place in its group (or the table), and the group's rows.

    Rows are range-partitioned by group and order and sorted there; what stands
    before a partition is the sum of the counts before it, a row for each
    partition and group. So neither a group nor the table is sorted in one task,
    and rows alike in order are dealt out by their place in the input.
    """
    group = group or []
    by = [*(F.col(c).asc_nulls_first() for c in group), *order, F.col("_tie").asc()]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = kept(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), part.alias("_part")).agg(F.min("_place").alias("_least"), F.count("*").alias("_n"))
    keys = [f"_g{i}" for i in range(len(group))]
    own = Window.partitionBy(*keys)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("_n").over(own))
    same = part == F.col("_part")
    for c, k in zip(group, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return placed.join(counts, same).withColumn("rank", F.col("_place") - F.col("_least") + F.col("_before")).drop("_place", "_part", "_least", "_n", "_before", *keys)


def firsts(rows: DataFrame, order: list[Column], most: Column | int, group: list[str] | None = None) -> DataFrame:
    """The rows of a rank below ``most``, which may be a column; rank and size are dropped."""
    return ranked(rows, order, group).filter(F.col("rank") < most).drop("rank", "size")
