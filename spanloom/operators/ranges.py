"""Range joins inside a document: equi-joins on document and position bucket, so long documents stay linear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a bucket: a span of ordinary length lies in one or two.
BUCKET = 64


def _bucketed(rows: DataFrame, name: str, start: Column, end: Column, size: int) -> DataFrame:
    first, last = F.floor(start / size), F.floor(F.greatest(end - 1, start) / size)
    return rows.withColumn(f"{name}_first", first).withColumn("bucket", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], reach: int = 0, size: int = BUCKET, key: str = "doc_id") -> DataFrame:
    """Pairs in one document whose spans overlap, or lie within ``reach`` characters.

    Each side is dealt to the buckets it touches; a pair counts in the first
    bucket that both touch. Column names of the two sides must differ, but for ``key``.
    """
    l = _bucketed(left, "l", F.col(left_span[0]) - reach, F.col(left_span[1]) + reach, size)  # noqa: E741
    r = _bucketed(right, "r", F.col(right_span[0]), F.col(right_span[1]), size)
    near = (F.col(left_span[0]) - reach < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1]) + reach)
    return l.join(r, [key, "bucket"]).filter(near & (F.col("bucket") == F.greatest("l_first", "r_first"))).drop("bucket", "l_first", "r_first")
