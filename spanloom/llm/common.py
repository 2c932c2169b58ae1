"""Helpers shared by the text-corpus operators: tables, scratch space, Arrow batches."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: keep a batch of long documents small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; also bounds Arrow batches for this session."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode a temporary one where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised by a reliable checkpoint; Spark removes the files when the frame is gone."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_hot(left: DataFrame, right: DataFrame, key: str, least: int = 10_000, share: float = 1e-4) -> DataFrame:
    """Inner join with a ``right`` of distinct keys, whose rows for common keys are broadcast.

    A key is common if it has more than ``least`` rows of ``left`` and more than
    ``share`` of all, so there are at most 1 / share of them; their rows of
    ``left`` stay where they are and only the others are dealt out by the key.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("_rows"))
    total = left.count()
    common = F.broadcast(cut(sizes.filter(F.col("_rows") > max(least, int(share * total))).select(key)))
    hot = left.join(F.broadcast(right.join(common, key, "left_semi")), key)
    return left.join(common, key, "left_anti").join(right, key).unionByName(hot)


class Scratch:
    """Parquet tables in the shared folder for the time of a ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def save(self, df: DataFrame, name: str, **options: Any) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_: Any) -> None:
        self.drop()


def held_out(column: Any, modulus: int, remainder: int) -> Any:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as held out."""
    return F.coalesce(F.crc32(column.cast("string")) % modulus == remainder, F.lit(True))


#: A column for keys of rows, whose name no table has.
ROW_KEY = "_row_key"


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a 64-bit key of each row's id and text in ``ROW_KEY``.

    Decisions on a text are joined on it, as ids may be null or shared by
    different texts; rows alike in both have one key and get one decision.
    """
    return docs.withColumn(ROW_KEY, F.xxhash64(docs["doc_id"].isNull(), docs["doc_id"], docs["text"].isNull(), docs["text"]))


#: Columns of documents, which stages know by name; all others travel as one.
OWN = ("doc_id", "text", "lang", "source", "n_chars")
_REST = "_other_columns"


def apart(stage: Any) -> Any:
    """A pipeline stage for which the columns that documents do not have are one struct, so that none clashes with its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in OWN]
        if not others:
            return stage(spark, docs, sf_dir)
        quoted = [f"`{c}`" for c in docs.columns]
        held = docs.select(*(f"`{c}`" for c in docs.columns if c in OWN), F.struct(*(f"`{c}`" for c in others)).alias(_REST))
        found = stage(spark, held, sf_dir)
        return found.select(*(F.col(q if c in OWN else f"{_REST}.{q}").alias(c) for c, q in zip(docs.columns, quoted, strict=True)))

    return run


_held: dict[str, dict] = {}


def cache_of(operator: str) -> dict:
    """The cache of one operator in this Python worker. Workers outlive stages, so the others' are emptied."""
    for name, cache in _held.items():
        if name != operator:
            cache.clear()
    return _held.setdefault(operator, {})


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters."""
    return text.lower().split()


def per_batch(function: Any, *args: Any) -> Any:
    """A ``mapInArrow`` function that applies ``function(batch, *args)`` to each non-empty batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch, *args)

    return run
