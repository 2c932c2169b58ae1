"""Queries over mentions of several lengths that overlap each other: matching, scores of documents and corpora, chunks, anchored text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scores as S
from spanloom.operators import match as M
from spanloom.operators import prompts as P
from spanloom.operators import text as T

from .derived import CANDIDATES_SQL, candidates, table
from .text_queries import MENTION, MENTIONS_SQL, mentions, token_rows

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Golds of which every third reaches over what follows; predictions that miss, shift, stretch, relabel and double them."""
    i = F.col("gold_id")
    gold = mentions(token_rows(spark, sf_dir, MENTION)).withColumn("end", F.col("end") + F.when(i % 3 == 0, 12).otherwise(0))
    label = F.when(i % 5 == 0, F.concat(F.lit("C"), ((F.substring("label", 2, 1).cast("int") + 1) % 9).cast("string"))).otherwise(F.col("label"))
    one = lambda use, key, start, end, of: F.when(use, F.struct(key.alias("pred_id"), start.alias("start"), end.alias("end"), of.alias("label")))
    own = one(i % 7 != 0, i, F.col("start") + F.when(i % 11 == 0, 1).otherwise(0), F.col("end") + F.when(i % 4 == 1, 6).otherwise(0), label)
    again = one(i % 5 == 2, i + 1_000_000, F.col("start") + 1, F.col("end"), F.col("label"))
    return gold, gold.select("doc_id", F.explode(F.array_compact(F.array(own, again))).alias("x"), "text").select("doc_id", "x.*", "text")


OVERLAPS_SQL = f"""{MENTIONS_SQL},
gold2 AS (SELECT doc_id, gold_id, start, "end" + CASE WHEN gold_id % 3 = 0 THEN 12 ELSE 0 END AS "end", label, text FROM gold),
pred2 AS (SELECT doc_id, gold_id AS pred_id, start + CASE WHEN gold_id % 11 = 0 THEN 1 ELSE 0 END AS start, "end" + CASE WHEN gold_id % 4 = 1 THEN 6 ELSE 0 END AS "end",
  CASE WHEN gold_id % 5 = 0 THEN 'C' || ((CAST(substr(label, 2, 1) AS INTEGER) + 1) % 9) ELSE label END AS label, text FROM gold2 WHERE gold_id % 7 <> 0
  UNION ALL SELECT doc_id, gold_id + 1000000, start + 1, "end", label, text FROM gold2 WHERE gold_id % 5 = 2)"""
_OVERLAP = '(p.start < g."end" AND g.start < p."end")'
_EXACT = '(p.start = g.start AND p."end" = g."end")'
_CONTAINS = "(contains(lower(p.text), lower(g.text)) OR contains(lower(g.text), lower(p.text)))"
_RULES = {
    "strict": f"({_EXACT} OR (lower(p.text) = lower(g.text) AND p.start = g.start))",
    "nested": f"({_EXACT} OR (lower(p.text) = lower(g.text) AND abs(p.start - g.start) <= 1))",
    "partial": f"({_OVERLAP} OR ({_CONTAINS} AND abs(p.start - g.start) <= 5))",
    "exact": _EXACT,
    "overlap": _OVERLAP,
}
_SIDES = """sides AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred FROM (SELECT doc_id, count(*) AS n_gold FROM gold2 GROUP BY ALL) a
FULL JOIN (SELECT doc_id, count(*) AS n_pred FROM pred2 GROUP BY ALL) b ON a.doc_id = b.doc_id)"""


def _greedy(mode: str) -> str:
    """CTEs up to <mode> (doc_id, tp): predictions in order take their first free gold, a pair at a time."""
    return f"""{mode}_pairs AS (SELECT p.doc_id, p.label, p.pred_id, g.gold_id, row_number() OVER (PARTITION BY p.doc_id, p.label ORDER BY p.start, p.pred_id, g.start, g.gold_id) AS r
  FROM pred2 p JOIN gold2 g ON p.doc_id = g.doc_id AND p.label = g.label WHERE {_RULES[mode]}),
{mode}_steps AS (SELECT DISTINCT doc_id, label, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS gs FROM {mode}_pairs UNION ALL
  SELECT s.doc_id, s.label, x.r, CASE WHEN list_contains(ps, x.pred_id) OR list_contains(gs, x.gold_id) THEN ps ELSE list_append(ps, x.pred_id) END, CASE WHEN list_contains(ps, x.pred_id) OR list_contains(gs, x.gold_id) THEN gs ELSE list_append(gs, x.gold_id) END
  FROM {mode}_steps s JOIN {mode}_pairs x ON x.doc_id = s.doc_id AND x.label = s.label AND x.r = s.r + 1),
{mode} AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS tp FROM (SELECT doc_id, label, max(len(ps)) AS n FROM {mode}_steps GROUP BY ALL) GROUP BY doc_id)"""


def _one_to_one_sql(mode: str) -> str:
    return f"WITH RECURSIVE {OVERLAPS_SQL}, {_SIDES}, {_greedy(mode)} SELECT doc_id, n_gold, n_pred, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp, n_gold - coalesce(tp, 0) AS fn FROM sides LEFT JOIN {mode} USING (doc_id)"


@query(_one_to_one_sql("strict"))
def j_greedy_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.one_to_one(*both(spark, sf_dir), mode="strict")


@query(_one_to_one_sql("nested"))
def j_greedy_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.one_to_one(*both(spark, sf_dir), mode="nested")


@query(_one_to_one_sql("partial"))
def j_greedy_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.one_to_one(*both(spark, sf_dir), mode="partial")


_MENTION = f"""mention AS (SELECT doc_id, count(*) AS tp, count(DISTINCT gold_id) AS covered FROM (SELECT p.doc_id, p.pred_id, arg_min(g.gold_id, CAST(g.start AS BIGINT) * 10000000 + g.gold_id) AS gold_id FROM pred2 p JOIN gold2 g ON p.doc_id = g.doc_id AND p.label = g.label WHERE {_RULES["partial"]} GROUP BY ALL) GROUP BY doc_id)"""


@query(f"""WITH {OVERLAPS_SQL}, {_SIDES}, {_MENTION}, k AS (SELECT doc_id, n_gold, n_pred, coalesce(tp, 0) AS tp, coalesce(covered, 0) AS covered FROM sides LEFT JOIN mention USING (doc_id)),
s AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred WHEN n_gold = 0 THEN 1.0 ELSE 0 END AS p, CASE WHEN n_gold > 0 THEN covered / n_gold WHEN n_pred = 0 THEN 1.0 ELSE 0 END AS r FROM k)
SELECT doc_id, n_gold, n_pred, tp, covered, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s""")
def j_overlapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.coverage_scores(M.mention_coverage(*both(spark, sf_dir)))
    return rows.select("doc_id", "n_gold", "n_pred", "tp", "covered", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def _corpus(mode: str) -> str:
    return f"SELECT '{mode}' AS formulation, sum(coalesce(tp, 0)) AS tp, sum(n_pred - coalesce(tp, 0)) AS fp, sum(n_gold - coalesce(tp, 0)) AS fn, sum(n_pred) AS n_pred, sum(n_gold) AS n_gold, sum(coalesce(tp, 0)) AS covered FROM sides LEFT JOIN {mode} USING (doc_id)"


@query(f"""WITH RECURSIVE {OVERLAPS_SQL}, {_SIDES}, {_greedy("strict")}, {_greedy("nested")}, {_greedy("partial")}, {_MENTION},
z AS ({_corpus("strict")} UNION ALL {_corpus("nested")} UNION ALL {_corpus("partial")} UNION ALL
  SELECT 'mention', sum(coalesce(tp, 0)), sum(n_pred - coalesce(tp, 0)), sum(n_gold - coalesce(covered, 0)), sum(n_pred), sum(n_gold), sum(coalesce(covered, 0)) FROM sides LEFT JOIN mention USING (doc_id)),
s AS (SELECT formulation, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_gold AS BIGINT) AS n_gold, CAST(covered AS BIGINT) AS covered, tp / n_pred AS p, covered / n_gold AS r FROM z)
SELECT * EXCLUDE (p, r), round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""")
def a_four_formulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.formulations(*both(spark, sf_dir))


@query(f"""WITH RECURSIVE {OVERLAPS_SQL}, {_SIDES}, {_greedy("exact")}, {_greedy("overlap")},
k AS (SELECT d.doc_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(exact.tp, 0) AS te, coalesce(overlap.tp, 0) AS tp FROM documents d LEFT JOIN sides USING (doc_id) LEFT JOIN exact USING (doc_id) LEFT JOIN overlap USING (doc_id)),
v AS (SELECT *, te / greatest(n_pred, 1) AS ep, te / greatest(n_gold, 1) AS er, tp / greatest(n_pred, 1) AS pp, tp / greatest(n_gold, 1) AS pr FROM k)
SELECT doc_id, n_gold, n_pred, te AS tp_exact,
  round(CASE WHEN n_pred = 0 THEN 1.0 WHEN n_gold = 0 THEN 0 ELSE ep END, 4) AS exact_precision, round(CASE WHEN n_gold = 0 THEN 1.0 WHEN n_pred = 0 THEN 0 ELSE er END, 4) AS exact_recall,
  round(CASE WHEN n_gold = 0 AND n_pred = 0 THEN 1.0 WHEN n_gold = 0 OR n_pred = 0 THEN 0 ELSE 2 * ep * er / greatest(ep + er, 1e-9) END, 4) AS exact_f1,
  round(CASE WHEN n_pred = 0 THEN 1.0 WHEN n_gold = 0 THEN 0 ELSE pp END, 4) AS partial_precision, round(CASE WHEN n_gold = 0 THEN 1.0 WHEN n_pred = 0 THEN 0 ELSE pr END, 4) AS partial_recall,
  round(CASE WHEN n_gold = 0 AND n_pred = 0 THEN 1.0 WHEN n_gold = 0 OR n_pred = 0 THEN 0 ELSE 2 * pp * pr / greatest(pp + pr, 1e-9) END, 4) AS partial_f1 FROM v""")
def j_document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.document_scores(*both(spark, sf_dir), table(spark, sf_dir, "documents"))


def _agreement_sql(rule: str, typed: str) -> str:
    return f"""WITH {OVERLAPS_SQL}, {_SIDES}, hits AS (SELECT DISTINCT p.doc_id, p.pred_id, g.gold_id FROM pred2 p JOIN gold2 g ON p.doc_id = g.doc_id {typed} WHERE {rule}),
h AS (SELECT doc_id, count(DISTINCT gold_id) AS tg, count(DISTINCT pred_id) AS tt FROM hits GROUP BY ALL)
SELECT doc_id, n_gold, coalesce(tg, 0) AS tp_gold, n_pred AS n_test, coalesce(tt, 0) AS tp_test, n_gold - coalesce(tg, 0) AS fn, n_pred - coalesce(tt, 0) AS fp FROM sides LEFT JOIN h USING (doc_id)"""


@query(_agreement_sql(_OVERLAP, "AND p.label = g.label"))
def j_agreement_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.agreement(*both(spark, sf_dir), mode="overlap")


@query(_agreement_sql("p.start = g.start", ""))
def j_agreement_left_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.agreement(*both(spark, sf_dir), mode="left", ignore_type=True)


def _flag_sql(rule: str, typed: str) -> str:
    return f"""WITH {OVERLAPS_SQL},
gg AS (SELECT doc_id, gold_id, 'total' AS level, '' AS name FROM gold2 UNION ALL SELECT doc_id, gold_id, 'type', label FROM gold2 UNION ALL SELECT doc_id, gold_id, 'flag', 'Negated' FROM gold2 WHERE gold_id % 2 = 0 UNION ALL SELECT doc_id, gold_id, 'flag', 'Speculated' FROM gold2 WHERE gold_id % 3 = 0),
tg AS (SELECT doc_id, pred_id, 'total' AS level, '' AS name FROM pred2 UNION ALL SELECT doc_id, pred_id, 'type', label FROM pred2 UNION ALL SELECT doc_id, pred_id, 'flag', 'Negated' FROM pred2 WHERE pred_id % 4 = 0 UNION ALL SELECT doc_id, pred_id, 'flag', 'Speculated' FROM pred2 WHERE pred_id % 3 = 0 UNION ALL SELECT doc_id, pred_id, 'flag', 'Reported' FROM pred2 WHERE pred_id % 5 = 0),
hits AS (SELECT p.doc_id, g.gold_id, p.pred_id FROM pred2 p JOIN gold2 g ON p.doc_id = g.doc_id {typed} WHERE {rule}),
hg AS (SELECT h.*, a.level, a.name FROM hits h JOIN gg a USING (doc_id, gold_id) JOIN tg b ON b.doc_id = h.doc_id AND b.pred_id = h.pred_id AND b.level = a.level AND b.name = a.name),
k AS (SELECT level, name, sum(ng) AS n_gold, sum(tgn) AS tp_gold, sum(nt) AS n_test, sum(ttn) AS tp_test FROM (
  SELECT level, name, count(*) AS ng, 0 AS tgn, 0 AS nt, 0 AS ttn FROM gg GROUP BY ALL UNION ALL SELECT level, name, 0, 0, count(*), 0 FROM tg GROUP BY ALL
  UNION ALL SELECT level, name, 0, count(DISTINCT (doc_id, gold_id)), 0, count(DISTINCT (doc_id, pred_id)) FROM hg GROUP BY ALL) GROUP BY ALL),
s AS (SELECT level, name, CAST(n_gold AS BIGINT) AS n_gold, CAST(tp_gold AS BIGINT) AS tp_gold, CAST(n_test AS BIGINT) AS n_test, CAST(tp_test AS BIGINT) AS tp_test, CASE WHEN n_test > 0 THEN tp_test / n_test ELSE 0 END AS p, CASE WHEN n_gold > 0 THEN tp_gold / n_gold ELSE 0 END AS r FROM k)
SELECT level, name, n_gold, tp_gold, n_test, tp_test, n_gold - tp_gold AS fn, n_test - tp_test AS fp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s"""


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    gold, test = both(spark, sf_dir)
    given = lambda rows, key, every: rows.select("doc_id", F.col(key).alias("ent_id"), F.explode(F.array(*(F.when(F.col(key) % n == 0, name) for name, n in every.items()))).alias("flag")).filter("flag is not null")
    return gold, test, given(gold, "gold_id", {"Negated": 2, "Speculated": 3}), given(test, "pred_id", {"Negated": 4, "Speculated": 3, "Reported": 5})


@query(_flag_sql(_EXACT, "AND p.label = g.label"))
def a_agreement_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement over all, by type and by flag, matched anew among the spans of each."""
    return M.grouped_agreement(*_flagged(spark, sf_dir))


@query(_flag_sql(_OVERLAP, ""))
def a_overlap_agreement_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for overlapping spans of any type."""
    return M.grouped_agreement(*_flagged(spark, sf_dir), mode="overlap", ignore_type=True)


@query(f"""WITH {OVERLAPS_SQL}, c AS (SELECT p.doc_id, p.pred_id, g.label, g.start AS gs, g.gold_id, CASE WHEN {_EXACT} THEN 1 WHEN {_OVERLAP} AND p.label = g.label THEN 2 WHEN {_OVERLAP} AND {_CONTAINS} THEN 3 END AS tier FROM pred2 p JOIN gold2 g ON p.doc_id = g.doc_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pred_id ORDER BY tier, gs, gold_id) AS r FROM c WHERE tier IS NOT NULL) WHERE r = 1)
SELECT p.label AS predicted, coalesce(b.label, 'O') AS gold, count(*) AS n FROM pred2 p LEFT JOIN b USING (doc_id, pred_id) GROUP BY ALL""")
def j_overlapping_gold_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, predicted = both(spark, sf_dir)
    found = M.gold_label(gold, predicted).withColumnRenamed("label", "gold")
    return predicted.join(found, ["doc_id", "pred_id"]).groupBy(F.col("label").alias("predicted"), "gold").agg(F.count("*").alias("n"))


@query(f"""WITH {OVERLAPS_SQL}, c AS (SELECT p.doc_id, p.pred_id, g.label, row_number() OVER (PARTITION BY p.doc_id, p.pred_id ORDER BY g.start, g.gold_id) AS r FROM pred2 p JOIN gold2 g ON p.doc_id = g.doc_id WHERE {_EXACT} OR lower(p.text) = lower(g.text) OR ({_OVERLAP} AND {_CONTAINS}))
SELECT p.label AS predicted, coalesce(c.label, 'O') AS gold, count(*) AS n FROM pred2 p LEFT JOIN (SELECT * FROM c WHERE r = 1) c USING (doc_id, pred_id) GROUP BY ALL""")
def j_gold_label_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, predicted = both(spark, sf_dir)
    found = M.gold_label_anywhere(gold, predicted).withColumnRenamed("label", "gold")
    return predicted.join(found, ["doc_id", "pred_id"]).groupBy(F.col("label").alias("predicted"), "gold").agg(F.count("*").alias("n"))


@query(f"""WITH {OVERLAPS_SQL}, a AS (SELECT DISTINCT doc_id FROM gold2), b AS (SELECT DISTINCT doc_id FROM pred2 WHERE doc_id % 4 <> 1 UNION SELECT doc_id + 1000000000 FROM documents WHERE doc_id % 50 = 0)
SELECT doc_id, 'no_test' AS state FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'extra_test' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def j_coverage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, predicted = both(spark, sf_dir)
    others = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"))
    return M.coverage_checks(gold, predicted.filter("doc_id % 4 <> 1").select("doc_id").unionByName(others))


@query(f"WITH {OVERLAPS_SQL} SELECT doc_id FROM gold2 UNION SELECT doc_id FROM pred2")
def e_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.document_ids(*both(spark, sf_dir))


@query(f"""WITH {OVERLAPS_SQL}, u AS (SELECT doc_id, start, "end", text, label AS proposed_label, 'O' AS answer, label AS final_label, false AS escalated, 0.0 AS uncertainty FROM pred2 WHERE pred_id % 2 = 0
UNION ALL SELECT doc_id, start, "end", text, 'O', CASE WHEN pred_id % 3 = 0 THEN 'O' ELSE label END, CASE WHEN pred_id % 3 = 0 THEN 'O' ELSE label END, true, 0.5 FROM pred2 WHERE pred_id % 2 = 1)
SELECT *, 0.0 AS unreliability, 0.0 AS novelty, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" - start DESC, escalated, final_label) AS place FROM u""")
def e_merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure spans with their proposal, and arbitrated ones with an answer and an uncertainty, as rows of one shape."""
    rows = both(spark, sf_dir)[1]
    sure = rows.filter("pred_id % 2 = 0").select("doc_id", "start", "end", "text", F.col("label").alias("proposed_label"))
    told = rows.filter("pred_id % 2 = 1").select("doc_id", "start", "end", "text", F.when(F.col("pred_id") % 3 == 0, "O").otherwise(F.col("label")).alias("arbitrated_label"), F.lit(0.5).alias("uncertainty"))
    return M.merged(sure, told)


@query(f"""WITH {OVERLAPS_SQL}, u AS (SELECT doc_id, start, "end", label, false AS escalated FROM pred2 WHERE pred_id % 2 = 0 UNION ALL SELECT doc_id, start, "end", 'X' || label, true FROM pred2 WHERE pred_id % 3 < 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY escalated, label) AS r FROM u) SELECT doc_id, start, "end", label AS final_label, escalated FROM r WHERE r = 1""")
def w_confident_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span for equal offsets, a confident one before an arbitrated one."""
    rows = both(spark, sf_dir)[1]
    sure = rows.filter("pred_id % 2 = 0").select("doc_id", "start", "end", "text", F.col("label").alias("proposed_label"))
    told = rows.filter("pred_id % 3 < 2").select("doc_id", "start", "end", "text", F.concat(F.lit("X"), "label").alias("arbitrated_label"))
    return M.first_by_offsets(sure, told).select("doc_id", "start", "end", "final_label", "escalated")


#: Tags by the position of a token: runs of B and I, orphans and changes of class.
_TAG = "CASE (pos * {a} + doc_id) % 7 WHEN 0 THEN 'B-C1' WHEN 1 THEN 'I-C1' WHEN 2 THEN 'I-C1' WHEN 3 THEN 'I-C2' WHEN 4 THEN 'O' WHEN 5 THEN 'I-C2' ELSE 'B-C2' END"
_ZIPPED = f"""z AS (SELECT doc_id, pos, token, {_TAG.format(a=3)} AS gold_tag, CASE WHEN pos % 4 = 0 THEN {_TAG.format(a=5)} ELSE {_TAG.format(a=3)} END AS pred_tag FROM tok)"""


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.expr(_TAG.format(a=3))
    return token_rows(spark, sf_dir).select("doc_id", "pos", "token", gold.alias("gold_tag"), F.when(F.col("pos") % 4 == 0, F.expr(_TAG.format(a=5))).otherwise(gold).alias("pred_tag"))


def _exact_chunks(side: str) -> str:
    return f"""{side}0 AS (SELECT doc_id, pos, {side}_tag AS tag, regexp_extract({side}_tag, '^[BI]-(.*)$', 1) AS kind FROM z),
{side}1 AS (SELECT *, kind <> '' AND (tag LIKE 'B-%' OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos), '') <> kind) AS starts FROM {side}0),
{side}2 AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM {side}1),
{side}c AS (SELECT doc_id, min(pos) AS f, max(pos) AS l, any_value(kind) AS label FROM {side}2 WHERE kind <> '' GROUP BY doc_id, c)"""


def _open_chunks(side: str) -> str:
    return f"""{side}0 AS (SELECT doc_id, pos, {side}_tag AS tag, regexp_extract({side}_tag, '^[BI]-(.*)$', 1) AS kind FROM z),
{side}1 AS (SELECT *, max(CASE WHEN tag LIKE 'B-%' OR kind = '' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM {side}0),
{side}c AS (SELECT a.doc_id, min(a.pos) AS f, max(a.pos) AS l, any_value(a.kind) AS label FROM {side}1 a JOIN {side}0 o ON o.doc_id = a.doc_id AND o.pos = a.c AND o.tag LIKE 'B-%' AND o.kind = a.kind GROUP BY a.doc_id, a.c)"""


def _chunk_sql(made, rule: str) -> str:
    return f"""WITH {MENTIONS_SQL}, {_ZIPPED}, {made("gold")}, {made("pred")},
g AS (SELECT label, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM predc p WHERE p.doc_id = goldc.doc_id AND p.label = goldc.label AND {rule.format(g="goldc")})) AS hit FROM goldc GROUP BY label),
q AS (SELECT label, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM goldc g WHERE g.doc_id = p.doc_id AND g.label = p.label AND {rule.format(g="g")})) AS hit FROM predc p GROUP BY label),
k AS (SELECT label, coalesce(g.n, 0) AS n_gold, coalesce(q.n, 0) AS n_pred, coalesce(g.hit, 0) AS tp_gold, coalesce(q.hit, 0) AS tp_pred FROM g FULL JOIN q USING (label)),
s AS (SELECT label, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(tp_gold) AS BIGINT) AS tp_gold, CAST(sum(tp_pred) AS BIGINT) AS tp_pred FROM k GROUP BY ROLLUP (label))
SELECT *, round(tp_pred / n_pred, 6) AS precision, round(tp_gold / n_gold, 6) AS recall, round(2 * (tp_pred / n_pred) * (tp_gold / n_gold) / (tp_pred / n_pred + tp_gold / n_gold), 6) AS f1 FROM s"""


@query(_chunk_sql(_exact_chunks, "p.f = {g}.f AND p.l = {g}.l"))
def a_chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chunk_scores(zipped(spark, sf_dir), "exact")


@query(_chunk_sql(_open_chunks, "p.f <= {g}.l AND {g}.f <= p.l"))
def a_chunk_overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chunk_scores(zipped(spark, sf_dir), "overlap")


@query(f"""WITH {MENTIONS_SQL}, {_ZIPPED}, e AS (SELECT *, CASE WHEN gold_tag = 'O' AND pred_tag = 'O' THEN 'TN' WHEN gold_tag = 'O' THEN 'FP' WHEN pred_tag = 'O' THEN 'FN' WHEN gold_tag = pred_tag THEN 'TP' WHEN left(gold_tag, 1) = left(pred_tag, 1) THEN 'CLSS_ERR' ELSE 'BIO_ERR' END AS error FROM z)
SELECT doc_id, error, count(*) AS n, md5(string_agg((pos + 1) || ' ' || token || ' ' || gold_tag || ' ' || pred_tag, chr(10) ORDER BY pos)) AS digest FROM e GROUP BY doc_id, error""")
def t_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.discrepancies(zipped(spark, sf_dir))
    told = F.transform("lines", lambda x: F.concat_ws(" ", x.line.cast("string"), x.token, x.gold_tag, x.pred_tag))
    return found.select("doc_id", "error", "n", F.md5(F.array_join(told, "\n")).alias("digest"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
y AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM x)
SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(length(line)) AS BIGINT) AS chars FROM y WHERE trim(line) <> '' GROUP BY doc_id""")
def t_line_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.line_sentences(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query(f"""WITH {MENTIONS_SQL}, t AS (SELECT g.doc_id, g.gold_id AS span_id, g.label, min(tok.pos) AS first, max(tok.pos) AS last FROM (SELECT doc_id, gold_id, label, start + 1 AS start, "end" + CASE WHEN gold_id % 3 = 0 THEN 12 ELSE 0 END AS "end" FROM gold) g
JOIN tok ON tok.doc_id = g.doc_id AND tok.start < g."end" AND g.start < tok."end" GROUP BY ALL) SELECT doc_id, span_id, label, first, last FROM t""")
def t_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that start inside a token and end in another, or beyond the text, as tokens."""
    rows = token_rows(spark, sf_dir)
    i = F.col("gold_id")
    spans = mentions(rows).select("doc_id", i.alias("span_id"), (F.col("start") + 1).alias("start"), (F.col("end") + F.when(i % 3 == 0, 12).otherwise(0)).alias("end"), "label")
    return T.align_to_tokens(spans, rows).select("doc_id", "span_id", "label", "first", "last")


@query(f"""WITH {MENTIONS_SQL}, c AS (SELECT doc_id, start, "end" FROM tok WHERE length(token) >= 5 UNION ALL SELECT a.doc_id, a.start, b."end" FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE length(a.token) >= 5)
SELECT c.doc_id, CAST(coalesce(substr(label, 2), '-1') AS INTEGER) + 1 AS class_id, count(*) AS n FROM c LEFT JOIN gold g ON g.doc_id = c.doc_id AND g.start = c.start AND g."end" = c."end" GROUP BY ALL""")
def t_labelled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one and two tokens with the class of the gold they equal, else 0."""
    rows = token_rows(spark, sf_dir)
    first = rows.filter(F.length("token") >= 5)
    following = rows.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("end").alias("next"))
    spans = first.select("doc_id", "start", "end").unionByName(first.join(following, ["doc_id", "pos"]).select("doc_id", "start", F.col("next").alias("end")))
    gold = mentions(rows).withColumn("class_id", F.substring("label", 2, 1).cast("int") + 1)
    return T.labelled_spans(spans, gold).groupBy("doc_id", "class_id").agg(F.count("*").alias("n"))


#: Targets are golds of even number, anchors the others; single tokens don't overlap.
_SENTENCES = r"""cut AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])([ \t\n\x0b\f\r]+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2)) AS parts FROM documents),
p0 AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
p1 AS (SELECT doc_id, i, split_part(part, chr(1), 1) AS sentence, coalesce(sum(length(replace(part, chr(1), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p0),
sen AS (SELECT doc_id, i, sentence, s, s + length(sentence) AS e FROM p1)"""


def _anchored_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = mentions(token_rows(spark, sf_dir, MENTION))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, rows.filter("gold_id % 2 = 0").withColumnRenamed("gold_id", "span_id"), rows.filter("gold_id % 2 = 1")


@query(f"""WITH {MENTIONS_SQL}, {_SENTENCES}, m AS (SELECT doc_id, gold_id, start, "end", CASE WHEN gold_id % 2 = 0 THEN '[TARGET: ' || text || ']' ELSE '[ANCHOR: ' || text || ' (' || label || ')]' END AS mark, text FROM gold),
pieces AS (SELECT m.*, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM m),
built AS (SELECT doc_id, string_agg(substr(d.text, before + 1, start - before) || mark, '' ORDER BY start) AS body, max("end") AS last FROM pieces JOIN documents d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, md5(CASE WHEN body IS NULL THEN d.text ELSE body || substr(d.text, last + 1) END) AS digest FROM documents d LEFT JOIN built USING (doc_id)""")
def t_anchored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.anchored_documents(*_anchored_inputs(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))


@query(rf"""WITH {MENTIONS_SQL}, {_SENTENCES}, t AS (SELECT g.doc_id, g.gold_id AS span_id, g.start AS ts, g."end" AS te, g.text, sen.i, sen.s, sen.e, sen.sentence FROM gold g JOIN sen ON sen.doc_id = g.doc_id AND sen.s <= g.start AND g."end" <= sen.e WHERE g.gold_id % 2 = 0),
m AS (SELECT t.doc_id, span_id, s, sentence, ts AS a, te AS b, '[TARGET: ' || text || ']' AS mark FROM t UNION ALL
  SELECT t.doc_id, span_id, s, sentence, g.start, g."end", '[ANCHOR: ' || g.text || ' (' || g.label || ')]' FROM t JOIN gold g ON g.doc_id = t.doc_id AND g.gold_id % 2 = 1 AND g.start >= t.s AND g."end" <= t.e),
n AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id, span_id ORDER BY a), s) AS before FROM m),
o AS (SELECT doc_id, span_id, string_agg(substr(sentence, CAST(before - s + 1 AS BIGINT), CAST(a - before AS BIGINT)) || mark, '' ORDER BY a) AS body, max(b) AS last, any_value(s) AS s, any_value(sentence) AS sentence FROM n GROUP BY doc_id, span_id)
SELECT doc_id, span_id, md5(regexp_replace(body || substr(sentence, CAST(last - s + 1 AS BIGINT)), '^ +| +$', '', 'g')) AS digest FROM o""")
def t_anchored_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.anchored_sentences(*_anchored_inputs(spark, sf_dir)).select("doc_id", "span_id", F.md5("sentence").alias("digest"))


@query(f"""WITH {CANDIDATES_SQL}, x AS (SELECT cand_id, ['Nutrition', 'Sleep', 'Physical_activities', 'Personal_care_products_and_cosmetic_procedures', 'Other'][cand_id % 5 + 1] AS label, 1 - p1 AS u, i1 FROM cand)
SELECT cand_id, label, [0.25, 0.35, 0.25, 0.40, 0.5][cand_id % 5 + 1] AS threshold, u >= [0.25, 0.35, 0.25, 0.40, 0.5][cand_id % 5 + 1] AS escalated, i1 <> 0 OR u >= 0.8 AS kept FROM x""")
def g_category_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalation by the threshold of the proposed class, with a default for others; and what is a candidate at all."""
    from spanloom.functions.labels import kept

    names = F.array(*(F.lit(x) for x in ("Nutrition", "Sleep", "Physical_activities", "Personal_care_products_and_cosmetic_procedures", "Other")))
    rows = candidates(spark, sf_dir).withColumn("label", F.get(names, (F.col("cand_id") % 5).cast("int"))).withColumn("u", S.least_confidence(F.col("p")))
    threshold = S.category_threshold(F.col("label"), 0.5)
    return rows.select("cand_id", "label", threshold.alias("threshold"), (F.col("u") >= threshold).alias("escalated"), kept(S.top1_class(F.col("p")), F.col("u"), 0.8).alias("kept"))
