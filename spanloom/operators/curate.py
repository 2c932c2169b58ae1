"""Corpus curation: statistics, balanced subsets, splits and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.scratch import kept

from .ranks import ranked


def document_statistics(entities: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, n_chars, majority_class, majority_count, total_entities, purity) of (doc_id, label) and (doc_id, n_chars)."""
    counts = entities.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    top = counts.groupBy("doc_id").agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label"))).alias("top"), F.sum("n").alias("total_entities"))
    rows = lengths.join(top, "doc_id").select("doc_id", "n_chars", F.col("top.label").alias("majority_class"), F.col("top.n").alias("majority_count"), "total_entities")
    return rows.withColumn("purity", F.round(100.0 * F.col("majority_count") / F.col("total_entities"), 6))


def density(rows: DataFrame) -> DataFrame:
    """Adds entities for each thousand characters."""
    return rows.withColumn("density", 1000.0 * F.col("total_entities") / F.greatest(F.col("n_chars"), F.lit(1)))


def density_statistics(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """n, mean, top, and the density picked at place int(share * n) of the sorted values; 0 falls back to the top, then to 1.

    The place is found from counts of equal values, so all rows are never sorted in one task.
    """
    counts = rows.groupBy("density").agg(F.count("*").alias("c"))
    parts = counts.withColumn("part", F.floor(F.log2(F.col("density") + 1e-9) * 4).cast("long"))
    totals = parts.groupBy("part").agg(F.sum("c").alias("pc")).withColumn("before", F.coalesce(F.sum("pc").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    overall = rows.agg(F.count("*").alias("n"), F.avg("density").alias("mean"), F.max("density").alias("top"))
    at = F.floor(F.col("n") * share)
    placed = parts.join(totals, "part").join(F.broadcast(overall), F.lit(True)).filter((F.col("before") <= at) & (at < F.col("before") + F.col("pc")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("density"))
    pick = placed.withColumn("upto", upto).filter(F.col("upto") > at).agg(F.min("density").alias("pick"))
    return overall.join(pick, F.lit(True)).select("n", F.round("mean", 6).alias("mean"), F.round("top", 6).alias("top"), F.round(F.coalesce(F.nullif("pick", F.lit(0.0)), F.nullif("top", F.lit(0.0)), F.lit(1.0)), 6).alias("p95"))


def _quotas(rows: DataFrame, classes: list[str], size: int) -> tuple[DataFrame, int]:
    """Rows with the bin they belong to (other classes are the remainder), and the quota of a main class."""
    main = F.when(F.col("majority_class").isin(classes), F.col("majority_class"))
    return rows.withColumn("bin", F.coalesce(main, F.lit(""))), size // max(1, len(classes))


def balanced_subset(rows: DataFrame, classes: list[str], size: int, p95: float, remainder: int = 0) -> DataFrame:
    """(doc_id, majority_class, score, source): size / classes of each main class by score, ``remainder`` of all others, then a back-fill by score.

    score: half purity, half density up to ``p95``, its 95th percentile (see
    density_statistics). Classes that are no main ones, null among them, are the
    remainder bin; with ``remainder`` main classes share what it leaves of
    ``size``. Places in the bins and in the back-fill are exact ranks; no bin is
    sorted in one task.
    """
    score = F.round(0.5 * F.col("purity") / 100 + 0.5 * (F.least(F.lit(1.0), F.col("density") / p95) if p95 > 0 else F.lit(0.0)), 6)
    rows, quota = _quotas(rows.withColumn("score", score), classes, size - remainder)
    order = [F.desc("score"), F.asc("doc_id")]
    most = F.when(F.col("bin") == "", remainder).otherwise(quota)
    binned = kept(ranked(rows, order, ["bin"]).withColumn("own", F.col("rank") < most).drop("rank", "size"))
    source = F.when(F.col("bin") == "", "remainder").otherwise("quota")
    own = binned.filter("own").select("doc_id", "majority_class", "score", source.alias("source"))
    short = max(0, size - own.count())
    if not short:
        return own
    fill = binned.filter("not own").orderBy(*order).limit(short)
    return own.unionByName(fill.select("doc_id", "majority_class", "score", F.lit("fill").alias("source")))


def subsets(rows: DataFrame, classes: list[str], sizes: list[int], p95: float) -> DataFrame:
    """Disjoint subsets in turn, each drawn from what the ones before left."""
    found = None
    for i, size in enumerate(sizes):
        now = balanced_subset(rows, classes, size, p95).withColumn("subset", F.lit(i))
        rows = rows.join(now.select("doc_id"), "doc_id", "left_anti")
        found = now if found is None else found.unionByName(now)
    return found


def balance_report(rows: DataFrame, classes: DataFrame, target: int) -> DataFrame:
    """(label, n, target, verdict) for each class, none left out."""
    counts = rows.groupBy(F.col("majority_class").alias("label")).agg(F.count("*").alias("n"))
    joined = classes.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("label", "n", F.lit(target).alias("target"), F.when(F.col("n") >= target, "PASS").otherwise("FAIL").alias("verdict"))


def split(rows: DataFrame, key: Column, seed: str, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Adds split (train, val, test) by a digest of key and seed: stable, even, and without a sort."""
    at = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long") / float(2**32)
    return rows.withColumn("split", F.when(at < shares[0], "train").when(at < shares[0] + shares[1], "val").otherwise("test"))


def exact_split(rows: DataFrame, key: Column, seed: str, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Adds split (train, val, test) with exact counts: floor(share * n) rows each, the rest test, in order of a digest of key and seed.

    The order is that of ``split``; ties of equal keys go by the row's place in
    the input. Counts are exact for any number of rows.
    """
    digest = F.md5(F.concat(key.cast("string"), F.lit(seed)))
    found = ranked(rows.withColumn("_digest", digest), [F.asc("_digest")]).drop("_digest")
    at = lambda share: F.floor(F.col("size") * F.lit(share))
    name = F.when(F.col("rank") < at(shares[0]), "train").when(F.col("rank") < at(shares[0]) + at(shares[1]), "val").otherwise("test")
    return found.withColumn("split", name).drop("rank", "size")


def first_of(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """One row of each key: the first in order."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    rows = rows.select("*", *named)
    w = Window.partitionBy(*(f"_k{i}" for i in range(len(key)))).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", *(f"_k{i}" for i in range(len(key))))


def first_directory_wins(corpora: list[DataFrame]) -> DataFrame:
    """The union of document tables; of a document in several the first table's."""
    ranked = [c.withColumn("rank", F.lit(i)) for i, c in enumerate(corpora)]
    rows = ranked[0]
    for other in ranked[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return first_of(rows, [F.col("doc_id")], [F.col("rank")]).drop("rank")
