"""Nearest references, novelty scores and exemplars over embedding vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scores import logistic
from spanloom.sources.scratch import kept

from .neighbours import SHARD_ROWS, PivotIndex, best, meet

#: Queries that meet all of a few references in a task.
QUERY_ROWS = 1_024


def nearest(queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool = False, by_class: bool = False) -> DataFrame:
    """query_id, rank, ref_id, ref_label, distance: the ``k`` references at the least cosine distance, ties to smaller ids.

    queries: (id, v) and, with ``by_class``, ``wanted``: the labels that get k
    references each. refs: (id, label, v). References that fit one task meet the
    queries in blocks; more of them are searched through a pivot index. Null vectors take no part.
    """
    queries, refs = queries.filter("v is not null"), refs.filter("v is not null")
    if refs.count() > SHARD_ROWS:
        return PivotIndex(refs, k).search(queries, exclude_self, by_class)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    wanted = F.col("wanted") if by_class else F.lit(None).cast("array<string>")
    left = queries.select("id", "v", wanted.alias("wanted"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("block"))
    right = refs.select(F.col("id").alias("ref_id"), F.col("label").cast("string").alias("ref_label"), F.col("v").alias("ref_v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    return best(left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(meet(k, exclude_self), "query_id long, ref_id long, ref_label string, distance double"), k, by_class)


def _means(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("query_id").alias("id")).agg(F.avg("distance").alias("knn"))


def knn_distance(queries: DataFrame, refs: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """(id, knn): mean distance to the k nearest references."""
    return _means(nearest(queries, refs, k, exclude_self))


def _densities(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    return pairs.join(reach, "ref_id").groupBy("query_id").agg((1 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("lrd"))


def _outlier_factors(pairs: DataFrame, among: DataFrame) -> DataFrame:
    """Factors of the queries of ``pairs``, from the references' neighbours ``among`` themselves."""
    reach = among.groupBy(F.col("query_id").alias("ref_id")).agg(F.max("distance").alias("k_distance"))
    own = _densities(among, reach).select(F.col("query_id").alias("ref_id"), F.col("lrd").alias("ref_lrd"))
    return pairs.join(own, "ref_id").groupBy("query_id").agg(F.avg("ref_lrd").alias("m")).join(_densities(pairs, reach), "query_id").select(F.col("query_id").alias("id"), (F.col("m") / F.col("lrd")).alias("lof"))


def local_outlier_factor(queries: DataFrame, refs: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """(id, lof) of queries against references; the references' own densities leave each point out.

    Where the queries are the references and leave themselves out, one search serves both.
    """
    among = kept(nearest(refs.select("id", "v"), refs, k, exclude_self=True))
    pairs = among if queries is refs and exclude_self else kept(nearest(queries, refs, k, exclude_self))
    return _outlier_factors(pairs, among)


def knn_and_outlier_factor(refs: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """(id, knn, lof) of the references themselves: both scores from one search."""
    among = kept(nearest(refs.select("id", "v"), refs, k, exclude_self=True))
    pairs = among if exclude_self else kept(nearest(refs.select("id", "v"), refs, k))
    return _means(pairs).join(_outlier_factors(pairs, among), "id")


def calibration(scores: DataFrame, column: str) -> DataFrame:
    """One row: population mean and deviation of a reference score."""
    return scores.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))


def novelty(queries: DataFrame, refs: DataFrame, k: int = 10, alpha: float = 0.5, exclude_self: bool = False) -> DataFrame:
    """(id, knn, lof, raw, novelty): the combined score, calibrated on the references' own scores.

    In the calibration each reference is its own neighbour at distance 0;
    ``exclude_self`` leaves queries that are references out of their own
    neighbours. One search of the references for k + 1 neighbours gives those
    with and without themselves, and serves the queries too where they are the references.
    """
    both = kept(nearest(refs.select("id", "v"), refs, k + 1))
    among = kept(best(both.filter("query_id <> ref_id").drop("rank"), k, False))
    itself = both.filter(F.col("rank") <= k)
    asked = (among if exclude_self else itself) if queries is refs else kept(nearest(queries, refs, k, exclude_self))
    score = lambda pairs: _means(pairs).join(_outlier_factors(pairs, among), "id").withColumn("raw", alpha * F.col("knn") + (1 - alpha) * F.col("lof"))
    mean, deviation = calibration(score(itself), "raw").first() or (None, None)
    return score(asked).withColumn("novelty", logistic(F.col("raw"), F.lit(mean or 0.0), F.lit(deviation or 0.0)))


def centroid_distance(vectors: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, id, centroid_distance): distance to the references' mean vector over the document's 95th percentile, at most 1.

    The mean is one row, formed by partial sums, and meets the vectors by broadcast.
    """
    as_vector = lambda v: array_to_vector(F.transform(v, lambda x: x.cast("double")))
    mean = refs.agg(vector_to_array(Summarizer.mean(as_vector(F.col("v")))).alias("mean"))
    square = F.aggregate(F.zip_with("v", "mean", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
    d = vectors.join(F.broadcast(mean), F.lit(True)).select("doc_id", "id", F.sqrt(square).alias("d"))
    p95 = d.groupBy("doc_id").agg(F.percentile("d", 0.95).alias("p95"))
    return d.join(p95, "doc_id").select("doc_id", "id", F.least(F.lit(1.0), F.col("d") / (F.col("p95") + 1e-9)).alias("centroid_distance"))


def exemplars(queries: DataFrame, refs: DataFrame, k: int = 1, exclude_self: bool = False) -> DataFrame:
    """Contrastive exemplars: the nearest references of each class that competes (``wanted``)."""
    return nearest(queries, refs, k, exclude_self, by_class=True)


def similar(queries: DataFrame, refs: DataFrame, n: int = 3, threshold: float = 0.8, exclude_self: bool = False) -> DataFrame:
    """query_id, rank, ref_id, similarity, and whether the best one reaches the threshold."""
    found = nearest(queries, refs, n, exclude_self).withColumn("similarity", 1 - F.col("distance"))
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    return found.withColumn("duplicate", best >= threshold)


def sampled_key(vector: F.Column, size: int, samples: int = 8, digits: int = 4) -> F.Column:
    """Key of a vector: ``samples`` coordinates at even steps, rounded to ``digits``; vectors of one key count as one."""
    step, samples = max(1, size // samples), min(size, samples)
    return F.array_join(F.transform(F.array(*(F.lit(i * step + 1) for i in range(samples))), lambda i: F.format_string(f"%.{digits}f", F.round(F.element_at(vector, i).cast("double"), digits) + 0.0)), "|")
