"""Precision, recall and F1 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def prf(tp: Column, fp: Column, fn: Column, percent: bool = False, empty: float = 0.0) -> dict[str, Column]:
    """precision, recall and f1 of counts; ``empty`` is the value where a denominator is 0."""
    scale = 100.0 if percent else 1.0
    found = {"precision": ratio(tp, tp + fp, empty), "recall": ratio(tp, tp + fn, empty), "f1": ratio(2.0 * tp, 2 * tp + fp + fn, empty)}
    return {name: F.round(scale * value, 6) for name, value in found.items()}


def by_system(rows: DataFrame, systems: list[str], gold: str = "gold") -> DataFrame:
    """(system, class, tp, fp, fn) of label columns against ``gold``, without O: one pass over the rows."""
    long = rows.select(F.col(gold).alias("gold"), F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.col(s).alias("label")) for s in systems))).alias("x")).select("gold", "x.*")
    long = long.withColumn("class", F.explode(F.array_distinct(F.array("gold", "label")))).filter("class <> 'O'")
    g, p = F.col("gold") == F.col("class"), F.col("label") == F.col("class")
    return long.groupBy("system", "class").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))


def system_scores(counts: DataFrame) -> DataFrame:
    """(system, tp, fp, fn, precision, recall, f1, macro_f1): micro scores and the mean of the classes' F1."""
    one = prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]
    sums = counts.withColumn("class_f1", one).groupBy("system").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg("class_f1"), 6).alias("macro_f1"))
    return sums.select("system", "tp", "fp", "fn", *(v.alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()), "macro_f1")


def deltas(scores: DataFrame, before: str, after: str) -> DataFrame:
    """One row: how much precision, recall, F1 and macro F1 the system ``after`` gains over ``before``."""
    of = lambda name, system: F.max(F.when(F.col("system") == system, F.col(name)))
    return scores.agg(*(F.round(of(c, after) - of(c, before), 6).alias(c) for c in ("precision", "recall", "f1", "macro_f1")))
