"""Matching predicted against gold spans: joins within a document, and order-dependent one-to-one matching by a sweep.

Frames: gold (doc_id, gold_id, start, end, label, text), predictions the same with pred_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.labels import active, normal_text
from spanloom.functions.metrics import ratio
from spanloom.functions.scores import token_error

from .folds import chunk_counts, matched
from .ranges import overlapping


def _sides(gold: DataFrame, predicted: DataFrame, reach: int = 0) -> DataFrame:
    """Pairs of a prediction and a gold that overlap, or lie within ``reach`` characters."""
    g = gold.select("doc_id", "gold_id", *(F.col(c).alias(f"g_{c}") for c in ("start", "end", "label", "text")))
    p = predicted.select("doc_id", "pred_id", *(F.col(c).alias(f"p_{c}") for c in ("start", "end", "label", "text")))
    return overlapping(p, g, ("p_start", "p_end"), ("g_start", "g_end"), reach)


def overlap() -> Column:
    return F.expr("p_start < g_end and g_start < p_end")


def contains() -> Column:
    p, g = normal_text(F.col("p_text")), normal_text(F.col("g_text"))
    return (p != "") & (g != "") & (p.contains(g) | g.contains(p))


def gold_label(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, pred_id, label): exact offsets, else overlap and equal label, else overlap and containment, else O."""
    tier = F.when(F.expr("p_start = g_start and p_end = g_end"), 1).when(overlap() & F.expr("p_label = g_label"), 2).when(overlap() & contains(), 3)
    best = _sides(gold, predicted).withColumn("tier", tier).filter("tier is not null").groupBy("doc_id", "pred_id").agg(F.min_by("g_label", F.struct("tier", "g_start", "gold_id")).alias("label"))
    return predicted.select("doc_id", "pred_id").join(best, ["doc_id", "pred_id"], "left").withColumn("label", F.coalesce("label", F.lit("O")))


def gold_label_anywhere(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """As gold_label in one pass: offsets or equal text anywhere, or overlap and containment; the first gold counts."""
    near = _sides(gold, predicted).filter(F.expr("p_start = g_start and p_end = g_end") | (overlap() & contains())).select("doc_id", "pred_id", "g_start", "gold_id", "g_label")
    firsts = gold.withColumn("norm", normal_text(F.col("text"))).groupBy("doc_id", "norm").agg(F.min(F.struct(F.col("start").alias("g_start"), "gold_id", F.col("label").alias("g_label"))).alias("x"))
    same = predicted.withColumn("norm", normal_text(F.col("text"))).join(firsts, ["doc_id", "norm"]).select("doc_id", "pred_id", "x.*")
    best = near.unionByName(same).groupBy("doc_id", "pred_id").agg(F.min_by("g_label", F.struct("g_start", "gold_id")).alias("label"))
    return predicted.select("doc_id", "pred_id").join(best, ["doc_id", "pred_id"], "left").withColumn("label", F.coalesce("label", F.lit("O")))


def one_to_one(gold: DataFrame, predicted: DataFrame, mode: str = "strict") -> DataFrame:
    """(doc_id, n_gold, n_pred, tp, fp, fn): predictions in order each take their first free gold of equal label.

    strict: equal offsets, or equal text and start. nested: start may slip by
    one for equal text. partial: overlap, or containment within five characters.
    exact and overlap look at offsets only. One sweep over a document's islands
    of overlapping spans; no pairs are formed.
    """
    rows = matched(gold, predicted, (mode,)).withColumnRenamed(f"tp_{mode}", "tp")
    return rows.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gold") - F.col("tp"))


def mention_coverage(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, n_gold, n_pred, tp, covered): predictions that a gold of their label covers, and golds covered; no lock-out.

    Covered: overlap, or containment within five characters; a prediction's first gold counts.
    """
    return matched(gold, predicted, ("mention",)).withColumnRenamed("tp_mention", "tp")


def coverage_scores(covered: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to counts of mention_coverage; without either side a score is 1, without one side 0."""
    both_empty = lambda other: F.when(F.col(other) == 0, 1.0).otherwise(0.0)
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(both_empty("n_gold"))
    r = F.when(F.col("n_gold") > 0, F.col("covered") / F.col("n_gold")).otherwise(both_empty("n_pred"))
    rows = covered.withColumn("precision", p).withColumn("recall", r)
    return rows.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def formulations(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(formulation, tp, fp, fn, n_pred, n_gold, covered, precision, recall, f1) of a corpus: strict, nested, partial and mention, from one sweep."""
    modes = ("strict", "nested", "partial", "mention")
    sums = matched(gold, predicted, modes).agg(*(F.sum(c).alias(c) for c in ("n_gold", "n_pred", "covered", *(f"tp_{m}" for m in modes))))
    of = lambda m: F.struct(F.lit(m).alias("formulation"), F.col(f"tp_{m}").alias("tp"), F.col("covered" if m == "mention" else f"tp_{m}").alias("covered"))
    rows = sums.select("n_gold", "n_pred", F.explode(F.array(*map(of, modes))).alias("x")).select("n_gold", "n_pred", "x.*")
    rows = rows.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gold") - F.col("covered"))
    rows = rows.withColumn("p", ratio(F.col("tp"), F.col("n_pred"))).withColumn("r", ratio(F.col("covered"), F.col("n_gold")))
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return rows.select("formulation", "tp", "fp", "fn", "n_pred", "n_gold", "covered", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def document_scores(gold: DataFrame, predicted: DataFrame, documents: DataFrame) -> DataFrame:
    """Exact and partial precision, recall and F1 of each of ``documents`` (doc_id), rounded to 4.

    Without golds and predictions all scores are 1; without golds recall is 1
    and without predictions precision, the others 0. Labels that name no entity
    are left out of the counts, but not of that question.
    """
    named = lambda rows: rows.filter(active(F.col("label")))
    found = matched(named(gold), named(predicted), ("exact", "overlap")).withColumnsRenamed({"tp_exact": "exact", "tp_overlap": "overlap"})
    any_of = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    rows = documents.select("doc_id").join(any_of(gold, "golds"), "doc_id", "left").join(any_of(predicted, "preds"), "doc_id", "left").join(found, "doc_id", "left").na.fill(0)
    no_gold, no_pred = F.col("golds") == 0, F.col("preds") == 0

    def scores(tp: str, prefix: str) -> list[Column]:
        p, r = F.col(tp) / F.greatest("n_pred", F.lit(1)), F.col(tp) / F.greatest("n_gold", F.lit(1))
        values = {"precision": F.when(no_pred, 1.0).when(no_gold, 0.0).otherwise(p), "recall": F.when(no_gold, 1.0).when(no_pred, 0.0).otherwise(r), "f1": F.when(no_gold & no_pred, 1.0).when(no_gold | no_pred, 0.0).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-9)))}
        return [F.round(v, 4).alias(f"{prefix}_{k}") for k, v in values.items()]

    return rows.select("doc_id", "n_gold", "n_pred", F.col("exact").alias("tp_exact"), *scores("exact", "exact"), *scores("overlap", "partial"))


def coverage_checks(gold_files: DataFrame, test_files: DataFrame) -> DataFrame:
    """(doc_id, state): documents that only the gold or only the test side has: no_test or extra_test."""
    side = lambda rows, is_gold: rows.select("doc_id", F.lit(is_gold).alias("is_gold"))
    sides = side(gold_files, True).unionByName(side(test_files, False)).groupBy("doc_id").agg(F.max("is_gold").alias("gold"), F.max(~F.col("is_gold")).alias("test"))
    return sides.filter("gold <> test").select("doc_id", F.when(F.col("gold"), "no_test").otherwise("extra_test").alias("state"))


def merged(confident: DataFrame, arbitrated: DataFrame) -> DataFrame:
    """Confident and arbitrated spans in one shape, with ``place``: their order in the document by start, the longest first.

    Absent columns count as null. final_label is the given one, else the
    arbitrated, else the proposed label; scores that are absent are 0.
    """
    rows = confident.withColumn("escalated", F.lit(False)).unionByName(arbitrated.withColumn("escalated", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("final_label", "arbitrated_label", "proposed_label", "answer") if c not in rows.columns} | {c: F.lit(None).cast("double") for c in ("uncertainty", "unreliability", "novelty") if c not in rows.columns})
    proposed = F.coalesce("proposed_label", F.lit("O"))
    final = F.coalesce("final_label", F.when(F.col("escalated"), F.col("arbitrated_label")), proposed)
    answer = F.coalesce("answer", "arbitrated_label", F.when(F.col("escalated"), final).otherwise("O"))
    rows = rows.select("doc_id", "start", "end", "text", proposed.alias("proposed_label"), answer.alias("answer"), final.alias("final_label"), "escalated", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("uncertainty", "unreliability", "novelty")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", F.desc(F.col("end") - F.col("start")), "escalated", "final_label")))


def first_by_offsets(confident: DataFrame, arbitrated: DataFrame) -> DataFrame:
    """The spans of both in one shape, one for each (doc_id, start, end): a confident one before an arbitrated one, then by ``place``."""
    rows = merged(confident, arbitrated)
    first = F.row_number().over(Window.partitionBy("doc_id", "start", "end").orderBy("escalated", "place"))
    return rows.withColumn("first", first).filter("first = 1").drop("first")


def document_ids(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The ids that either side has."""
    return gold.select("doc_id").union(predicted.select("doc_id")).distinct()


def discrepancies(zipped: DataFrame) -> DataFrame:
    """(doc_id, error, n, lines): tokens of zip_tags by their error, with line numbers from 1, in order."""
    line = F.struct((F.col("pos") + 1).alias("line"), "token", "gold_tag", "pred_tag")
    return zipped.withColumn("error", token_error(F.col("gold_tag"), F.col("pred_tag"))).groupBy("doc_id", "error").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("lines"))


def chunk_scores(zipped: DataFrame, mode: str = "exact") -> DataFrame:
    """(label, n_gold, n_pred, tp_gold, tp_pred, precision, recall, f1) of chunks of tags, by class and over all (null).

    exact: equal first and last token and class; an I after O or another class
    opens a chunk. overlap: a shared token and equal class; such an I opens none.
    Tags are shuffled once, by document; chunks of both sides are counted there.
    """
    sums = chunk_counts(zipped, mode).rollup("label").agg(*(F.sum(c).alias(c) for c in ("n_gold", "n_test", "tp_gold", "tp_test")))
    sums = sums.withColumn("p", ratio(F.col("tp_test"), F.col("n_test"))).withColumn("r", ratio(F.col("tp_gold"), F.col("n_gold")))
    return sums.select("label", "n_gold", F.col("n_test").alias("n_pred"), "tp_gold", F.col("tp_test").alias("tp_pred"), F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("f1"))


#: Ends of a span that must be equal for a match.
_EQUAL = {"exact": ["start", "end"], "left": ["start"], "right": ["end"]}


def _met(gold: DataFrame, test: DataFrame, mode: str, keys: list[str], columns: list[str]) -> DataFrame:
    """The spans of both sides (``columns``, is_gold) with ``hit``: whether one of the other side with the same ``keys`` meets it.

    No pairs are formed. Spans with equal ends are one group. A span overlaps
    one of the other side if, of those that start before its end, the greatest
    end lies beyond its start: a running maximum over starts and ends in order.
    """
    needed = list(dict.fromkeys([*keys, "start", "end", *columns]))
    rows = gold.select(*needed, F.lit(True).alias("is_gold")).unionByName(test.select(*needed, F.lit(False).alias("is_gold")))
    whole = lambda names: reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in names))
    if mode in _EQUAL:
        same = [*keys, *_EQUAL[mode]]
        w = Window.partitionBy(*same)
        hit = F.when(F.col("is_gold"), F.max(~F.col("is_gold")).over(w)).otherwise(F.max("is_gold").over(w)) & whole(same)
        return rows.select(*columns, "is_gold", hit.alias("hit"))
    # begins after ends where both are at one place, as touching spans don't overlap
    ends = F.explode(F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("begins")), F.struct(F.col("start").alias("at"), F.lit(1).alias("begins"))))
    rows = rows.withColumn("x", ends).select("*", "x.at", "x.begins").drop("x")
    w = Window.partitionBy(*keys).orderBy("at", "begins").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = lambda side: F.max(F.when(side & (F.col("begins") == 1) & F.col("at").isNotNull(), F.col("end"))).over(w)
    far = F.when(F.col("is_gold"), reach(~F.col("is_gold"))).otherwise(reach(F.col("is_gold")))
    hit = F.coalesce(far > F.col("start"), F.lit(False)) & whole([*keys, "start", "end"])
    return rows.withColumn("hit", hit).filter("begins = 0").select(*columns, "is_gold", "hit")


def _agreed(rows: DataFrame, by: list[str]) -> DataFrame:
    gold = F.col("is_gold")
    counts = rows.groupBy(*by).agg(F.count_if(gold).alias("n_gold"), F.count_if(gold & F.col("hit")).alias("tp_gold"), F.count_if(~gold).alias("n_test"), F.count_if(~gold & F.col("hit")).alias("tp_test"))
    return counts.withColumn("fn", F.col("n_gold") - F.col("tp_gold")).withColumn("fp", F.col("n_test") - F.col("tp_test"))


def agreement(gold: DataFrame, test: DataFrame, mode: str = "exact", ignore_type: bool = False, by: list[str] | None = None) -> DataFrame:
    """True positives of either side, and what is unmatched, by document and further keys.

    mode: exact, overlap, left (equal starts) or right (equal ends).
    """
    by = by or ["doc_id"]
    return _agreed(_met(gold, test, mode, ["doc_id"] if ignore_type else ["doc_id", "label"], by), by)


def memberships(spans: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Adds ``groups``: the totals, the span's type, and each of its flags (doc_id, ent_id, flag)."""
    listed = flags.groupBy("doc_id", F.col("ent_id").alias(key)).agg(F.collect_set("flag").alias("flags"))
    one = lambda level, name: F.struct(F.lit(level).alias("level"), name.cast("string").alias("name"))
    own = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: one("flag", f))
    groups = F.concat(F.array(one("total", F.lit(""))), F.array(one("type", F.coalesce("label", F.lit("")))), own)
    return spans.join(listed, ["doc_id", key], "left").withColumn("groups", groups).drop("flags")


def grouped_agreement(gold: DataFrame, test: DataFrame, gold_flags: DataFrame, test_flags: DataFrame, mode: str = "exact", ignore_type: bool = False) -> DataFrame:
    """(level, name, n_gold, tp_gold, n_test, tp_test, fn, fp, precision, recall, f1): agreement over all, by type and by flag, matched anew in each group.

    A span with several flags takes part in each flag's group, and there only
    spans of the other side with that flag can match it; a span without flags is
    in none. With ``ignore_type`` spans of different types match in the totals
    and flags, but not by type. A span stands once in each of its groups, and all
    groups are one aggregation; no pairs are formed.
    """
    spread = lambda rows: rows.select("doc_id", "start", "end", "label", F.explode("groups").alias("x")).select("*", "x.*").drop("x")
    g, t = spread(memberships(gold, gold_flags, "gold_id")), spread(memberships(test, test_flags, "pred_id"))
    keys = ["doc_id", "level", "name"] if ignore_type else ["doc_id", "level", "name", "label"]
    rows = _agreed(_met(g, t, mode, keys, ["level", "name"]), ["level", "name"])
    rows = rows.withColumn("precision", F.round(ratio(F.col("tp_test"), F.col("n_test")), 6)).withColumn("recall", F.round(ratio(F.col("tp_gold"), F.col("n_gold")), 6))
    p, r = ratio(F.col("tp_test"), F.col("n_test")), ratio(F.col("tp_gold"), F.col("n_gold"))
    return rows.withColumn("f1", F.round(ratio(2 * p * r, p + r), 6))


def missed(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Golds that no prediction of their label covers by start or by text: two anti joins, no OR in a join."""
    by_start = gold.join(predicted.select("doc_id", "label", "start").distinct(), ["doc_id", "label", "start"], "left_anti")
    texts = predicted.select("doc_id", "label", normal_text(F.col("text")).alias("norm")).distinct()
    return by_start.withColumn("norm", normal_text(F.col("text"))).join(texts, ["doc_id", "label", "norm"], "left_anti").drop("norm")


def zip_tags(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tag sequences side by side by position; the shorter is padded with O. Frames: (doc_id, pos, token, tag)."""
    l = left.select("doc_id", "pos", "token", F.col("tag").alias("gold_tag"))  # noqa: E741
    r = right.select("doc_id", "pos", F.col("tag").alias("pred_tag"))
    return l.join(r, ["doc_id", "pos"], "full_outer").select("doc_id", "pos", "token", F.coalesce("gold_tag", F.lit("O")).alias("gold_tag"), F.coalesce("pred_tag", F.lit("O")).alias("pred_tag"))


def alignment(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every gold and prediction by offsets: TP, FP, FN or CLSS_ERR."""
    g = gold.select("doc_id", "start", "end", F.col("label").alias("gold_label"))
    p = predicted.select("doc_id", "start", "end", F.col("label").alias("pred_label"))
    status = F.when(F.col("gold_label").isNull(), "FP").when(F.col("pred_label").isNull(), "FN").when(F.col("gold_label") == F.col("pred_label"), "TP").otherwise("CLSS_ERR")
    return g.join(p, ["doc_id", "start", "end"], "full_outer").withColumn("status", status)


def cached_answers(work: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached answer, misses) of a work list against a table of decisions."""
    return work.join(cache, keys, "inner"), work.join(cache.select(*keys), keys, "left_anti")
