"""Inputs of the queries, derived from the given tables by plain arithmetic on both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scores as S


#: Bytes in an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; also bounds Arrow batches for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_name(number: Column) -> Column:
    return F.when(number == 0, "O").otherwise(F.concat(F.lit("C"), number.cast("string")))


def _slice(first: int) -> Column:
    return F.transform(F.slice("embedding", first, 10), lambda x: x.cast("double"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate spans: ten components of each embedding are logits, fifty more five stochastic passes."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cand_id"),
        F.floor(F.col("vec_id") / 20).alias("doc_id"),
        class_name(F.col("label")).alias("gold"),
        class_name((F.col("label") + F.col("vec_id") % 3) % 10).alias("answer"),
        F.create_map(*(x for i, form in enumerate(("00", "01", "10", "11")) for x in (F.lit(form), class_name((F.col("label") + (F.col("vec_id") + i) % 5 % 3) % 10)))).alias("answers"),
        _slice(1).alias("logits"),
        F.array(*(_slice(i) for i in range(11, 60, 10))).alias("passes"),
    )
    rows = rows.withColumn("p", S.softmax(F.col("logits")))
    p = F.col("p")
    return rows.withColumns({"p1": S.top1(p), "p2": S.top2(p), "local": class_name(S.top1_class(p)), "second": class_name(S.top2_class(p)), "p_o": p[0]}).withColumn("margin", F.col("p1") - F.col("p2"))


#: The same candidates in DuckDB, as common table expressions.
CANDIDATES_SQL = """
c0 AS (
  SELECT vec_id AS cand_id, vec_id // 20 AS doc_id,
         CASE WHEN label = 0 THEN 'O' ELSE 'C' || label END AS gold,
         CASE WHEN (label + vec_id % 3) % 10 = 0 THEN 'O' ELSE 'C' || ((label + vec_id % 3) % 10) END AS answer,
         [CASE WHEN x = 0 THEN 'O' ELSE 'C' || x END FOR x IN [(label + (vec_id + i) % 5 % 3) % 10 FOR i IN [0, 1, 2, 3]]] AS answers,
         CAST(embedding[1:10] AS DOUBLE[]) AS logits, [CAST(embedding[i + 1:i + 10] AS DOUBLE[]) FOR i IN [10, 20, 30, 40, 50]] AS passes
  FROM embeddings
), c1 AS (
  SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM c0
), c2 AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM c1),
c3 AS (SELECT *, list_position(p, list_max(p)) - 1 AS i1, list_max(p) AS p1, list_sort(p, 'DESC')[2] AS p2, p[1] AS p_o FROM c2),
c4 AS (SELECT *, list_position(list_transform(p, lambda x, i: CASE WHEN i - 1 = i1 THEN -1.0 ELSE x END), p2) - 1 AS i2 FROM c3),
cand AS (
  SELECT *, CASE WHEN i1 = 0 THEN 'O' ELSE 'C' || i1 END AS local, CASE WHEN i2 = 0 THEN 'O' ELSE 'C' || i2 END AS second, p1 - p2 AS margin FROM c4
)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their labels: each is a query against all others."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))


REFERENCES_SQL = """
r AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
