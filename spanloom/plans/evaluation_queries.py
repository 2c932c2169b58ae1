"""Queries over whole evaluations: stages, ceilings, token accuracy, cached answers and call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.metrics import prf
from spanloom.operators import match as M

from .derived import CANDIDATES_SQL, candidates, table
from .score_queries import _GATED, gated
from .text_queries import MENTIONS_SQL, both, mentions, system, token_rows

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {MENTIONS_SQL}, c AS (SELECT count(DISTINCT (g.doc_id, g.gold_id)) AS covered FROM gold g JOIN pred p ON p.doc_id = g.doc_id AND p.pred_id = g.gold_id AND p.label = g.label) SELECT (SELECT count(*) FROM gold) AS total, covered, (SELECT count(*) FROM gold) - covered AS missed FROM c")
def a_proposal_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.mention_coverage(*both(spark, sf_dir))
    return r.agg(F.sum("n_gold").alias("total"), F.sum("covered").alias("covered"), (F.sum("n_gold") - F.sum("covered")).alias("missed"))


@query(f"""WITH {MENTIONS_SQL}, z AS (SELECT tok.doc_id, coalesce('B-' || g.label, 'O') AS a, coalesce('B-' || p.label, 'O') AS b FROM tok LEFT JOIN gold g ON tok.doc_id = g.doc_id AND tok.pos = g.gold_id LEFT JOIN pred p ON tok.doc_id = p.doc_id AND tok.pos = p.pred_id)
SELECT doc_id, count(*) AS n, count(*) FILTER (a = b) AS correct, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS accuracy FROM z GROUP BY GROUPING SETS ((doc_id), ())""")
def a_token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_rows(spark, sf_dir)
    gold = mentions(rows)
    tag = lambda side, key: rows.join(side.select("doc_id", F.col(key).cast("int").alias("pos"), F.concat(F.lit("B-"), "label").alias("tag")), ["doc_id", "pos"], "left").select("doc_id", "pos", "token", F.coalesce("tag", F.lit("O")).alias("tag"))
    zipped = M.zip_tags(tag(gold, "gold_id"), tag(system(gold), "pred_id"))
    same = F.col("gold_tag") == F.col("pred_tag")
    return zipped.rollup("doc_id").agg(F.count("*").alias("n"), F.count_if(same).alias("correct"), F.round(F.avg(same.cast("double")), 6).alias("accuracy"))


_STAGES = """g AS (SELECT cand_id, doc_id, gold, local, answer, CASE WHEN cand_id % 4 = 0 THEN answer ELSE local END AS final FROM cand),
l AS (SELECT 'proposal' AS stage, doc_id, gold, local AS label FROM g UNION ALL SELECT 'single', doc_id, gold, answer FROM g UNION ALL SELECT 'final', doc_id, gold, final FROM g),
k AS (SELECT stage, doc_id, count(*) FILTER (label <> 'O' AND label = gold) AS tp, count(*) FILTER (label <> 'O' AND label <> gold) AS fp, count(*) FILTER (gold <> 'O' AND label <> gold) AS fn FROM l GROUP BY ALL)"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tp, fp and fn of three stages of each document: the proposal, one pass of answers, and the final label."""
    rows = candidates(spark, sf_dir).withColumn("final", F.when(F.col("cand_id") % 4 == 0, F.col("answer")).otherwise(F.col("local")))
    long = rows.select("doc_id", "gold", F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(c).alias("label")) for s, c in (("proposal", "local"), ("single", "answer"), ("final", "final"))))).alias("x")).select("doc_id", "gold", "x.*")
    said, right = F.col("label") != "O", F.col("label") == F.col("gold")
    return long.groupBy("stage", "doc_id").agg(F.count_if(said & right).alias("tp"), F.count_if(said & ~right).alias("fp"), F.count_if((F.col("gold") != "O") & ~right).alias("fn"))


@query(f"""WITH {CANDIDATES_SQL}, {_STAGES}, m AS (SELECT stage, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 6) ELSE 0 END), 6) AS macro_f1 FROM k GROUP BY stage)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m""")
def a_stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages(spark, sf_dir).withColumn("doc_f1", prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"])
    sums = rows.groupBy("stage").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg("doc_f1"), 6).alias("macro_f1"))
    return sums.select("*", *(v.alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))


@query(f"WITH {CANDIDATES_SQL}, {_STAGES} SELECT doc_id, CAST(sum(tp) FILTER (stage = 'proposal') AS BIGINT) AS proposal, CAST(sum(tp) FILTER (stage = 'single') AS BIGINT) AS single, CAST(sum(tp) FILTER (stage = 'final') AS BIGINT) AS final FROM k GROUP BY doc_id")
def a_stage_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages(spark, sf_dir).groupBy("doc_id").pivot("stage", ["proposal", "single", "final"]).agg(F.sum("tp"))


@query(f"""WITH {CANDIDATES_SQL}, w AS (SELECT doc_id, local, second, count(*) AS n FROM cand GROUP BY ALL), c AS (SELECT DISTINCT doc_id, local, second FROM cand WHERE cand_id % 3 = 0)
SELECT CASE WHEN c.doc_id IS NULL THEN 'miss' ELSE 'hit' END AS state, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.local = c.local AND w.second = c.second GROUP BY state""")
def j_cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = candidates(spark, sf_dir), ["doc_id", "local", "second"]
    cache = rows.filter("cand_id % 3 = 0").groupBy(*keys).agg(F.min_by("answer", "cand_id").alias("answer"))
    hits, misses = M.cached_answers(rows.groupBy(*keys).agg(F.count("*").alias("n")), cache, keys)
    both_states = hits.select("n", F.lit("hit").alias("state")).unionByName(misses.select("n", F.lit("miss").alias("state")))
    return both_states.groupBy("state").agg(F.count("*").alias("keys"), F.sum("n").alias("n"))


@query("SELECT conv_id, role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY ROLLUP (conv_id, role)")
def a_call_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").rollup("conv_id", "role").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("n_chars"))


@query(f"{_GATED} SELECT doc_id, array_to_string(list(cand_id ORDER BY round(fused, 9) DESC, cand_id), ',') AS queue FROM gated WHERE escalated GROUP BY doc_id")
def g_escalation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work list of arbitration: escalated candidates of each document in order of their fused score."""
    rows = gated(spark, sf_dir).filter("escalated")
    ordered = F.array_sort(F.collect_list(F.struct((-F.round("fused", 9)).alias("k"), "cand_id")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x.cand_id.cast("string")), ",").alias("queue"))
