"""Queries over candidates and vectors: uncertainty, novelty, gating, audit and sweeps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scores as S
from spanloom.functions.metrics import by_system, deltas, prf, system_scores
from spanloom.operators import sweep as X
from spanloom.operators import vectors as V
from spanloom.operators.neighbours import PivotIndex

from .derived import CANDIDATES_SQL, REFERENCES_SQL, candidates, class_name, references, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(x) -> F.Column:
    return F.round(x, 6)


_ENTROPY = "(-list_sum(list_transform({p}, lambda x: x * ln(x + 1e-9))) / ln(len({p})))"
_MEAN_P = """
m0 AS (SELECT *, [[exp(x - list_max(z)) FOR x IN z] FOR z IN passes] AS es FROM cand),
m1 AS (SELECT *, [[x / list_sum(e) FOR x IN e] FOR e IN es] AS qs FROM m0)"""
_MCD = "list_avg([(-list_sum([x * ln(x + 1e-9) FOR x IN q]) / ln(len(q))) FOR q IN qs])"


@query(f"WITH {CANDIDATES_SQL} SELECT cand_id, local, second, round(p1, 6) AS p1, round(p2, 6) AS p2, round(margin, 6) AS margin, round(p_o, 6) AS p_o FROM cand")
def u_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("cand_id", "local", "second", *(r6(F.col(c)).alias(c) for c in ("p1", "p2", "margin", "p_o")))


@query(f"""WITH {CANDIDATES_SQL},
t0 AS (SELECT *, list_transform(logits, lambda x: exp((x - list_max(logits)) / 1.8)) AS te, list_transform(logits, lambda x: ln(1 + exp(x)) + 1) AS alpha FROM cand),
t AS (SELECT *, list_transform(te, lambda x: x / list_sum(te)) AS tp FROM t0)
SELECT cand_id, round(1 - p1, 6) AS u_lc, round({_ENTROPY.format(p="p")}, 6) AS u_pe,
       round(1 - (list_max(tp) - list_sort(tp, 'DESC')[2]), 6) AS u_margin,
       round(10 / list_sum(alpha), 6) AS u_evidential, round(alpha[1] / list_sum(alpha), 6) AS expected_o FROM t""")
def u_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    u, expected = S.evidential(F.col("logits"))
    return rows.select("cand_id", r6(S.least_confidence(F.col("p"))).alias("u_lc"), r6(S.entropy(F.col("p"))).alias("u_pe"), r6(S.margin_uncertainty(S.softmax(F.col("logits"), 1.8))).alias("u_margin"), r6(u).alias("u_evidential"), r6(expected[0]).alias("expected_o"))


def _passes(rows: DataFrame) -> DataFrame:
    return rows.select("cand_id", F.posexplode("passes").alias("pass", "z")).withColumn("q", S.softmax(F.col("z")))


def mean_entropy(rows: DataFrame) -> DataFrame:
    """(cand_id, u_mcd): mean entropy over stochastic passes."""
    return _passes(rows).groupBy("cand_id").agg(F.avg(S.entropy(F.col("q"))).alias("u_mcd"))


def mean_passes(rows: DataFrame) -> DataFrame:
    """(cand_id, u_mcd, mean_p): mean entropy over stochastic passes, and their mean distribution."""
    mean = _passes(rows).select("cand_id", F.posexplode("q").alias("i", "x")).groupBy("cand_id", "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("cand_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("mean_p"))
    return mean_entropy(rows).join(mean, "cand_id")


@query(f"""WITH {CANDIDATES_SQL}, {_MEAN_P},
m AS (SELECT *, [list_avg([q[i] FOR q IN qs]) FOR i IN range(1, 11)] AS mp FROM m1)
SELECT cand_id, round({_MCD}, 6) AS u_mcd,
       round(list_max(mp), 6) AS p1, round(1 - (list_max(mp) - list_sort(mp, 'DESC')[2]), 6) AS u_margin FROM m""")
def u_stochastic_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mean_passes(candidates(spark, sf_dir))
    return rows.select("cand_id", r6("u_mcd").alias("u_mcd"), r6(S.top1(F.col("mean_p"))).alias("p1"), r6(S.margin_uncertainty(F.col("mean_p"))).alias("u_margin"))


@query(f"""WITH {CANDIDATES_SQL} SELECT cand_id, round(sqrt(list_sum(list_transform(logits, lambda x: x * x))), 6) AS norm,
round(logits[1] / sqrt(list_sum(list_transform(logits, lambda x: x * x))), 6) AS first FROM cand""")
def v_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("logits")
    norm = F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x))
    return candidates(spark, sf_dir).select("cand_id", r6(norm).alias("norm"), r6(S.unit(z)[0]).alias("first"))


_KNN = f"""WITH {REFERENCES_SQL},
d AS (SELECT a.id AS id, b.id AS ref_id, b.label AS ref_label, greatest(0, least(2, 1 - list_cosine_similarity(a.v, b.v))) AS distance FROM r a JOIN r b ON a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, ref_id) AS rank FROM d)"""


@query(f"{_KNN} SELECT id, round(avg(distance), 6) AS knn FROM n WHERE rank <= 10 GROUP BY id")
def v_knn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references(spark, sf_dir)
    return V.knn_distance(rows, rows, k=10, exclude_self=True).select("id", r6("knn").alias("knn"))


_LOF = """
kd AS (SELECT id AS ref_id, max(distance) AS kd FROM n WHERE rank <= 10 GROUP BY id),
rl AS (SELECT n.id AS ref_id, 1 / (avg(greatest(distance, kd)) + 1e-10) AS lrd FROM n JOIN kd USING (ref_id) WHERE rank <= 10 GROUP BY n.id),
ql AS (SELECT n.id, any_value(own.lrd) AS lrd, avg(rl.lrd) AS m FROM n JOIN rl USING (ref_id) JOIN rl own ON own.ref_id = n.id WHERE rank <= 10 GROUP BY n.id)"""


@query(f"{_KNN}, {_LOF} SELECT id, round(m / lrd, 6) AS lof FROM ql")
def v_local_outlier_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references(spark, sf_dir)
    return V.local_outlier_factor(rows, rows, k=10, exclude_self=True).select("id", r6("lof").alias("lof"))


@query(f"""{_KNN}, {_LOF},
self AS (SELECT id, ref_id, distance FROM d UNION ALL SELECT id, id, greatest(0, least(2, 1 - list_cosine_similarity(v, v))) FROM r),
sn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, ref_id) AS rank FROM self),
sk AS (SELECT id, avg(distance) AS knn FROM sn WHERE rank <= 10 GROUP BY id),
sl AS (SELECT sn.id, avg(rl.lrd) / (1 / (avg(greatest(distance, kd)) + 1e-10)) AS lof FROM sn JOIN kd USING (ref_id) JOIN rl USING (ref_id) WHERE rank <= 10 GROUP BY sn.id),
cal AS (SELECT avg(0.5 * knn + 0.5 * lof) AS mean, stddev_pop(0.5 * knn + 0.5 * lof) AS dev FROM sk JOIN sl USING (id)),
qk AS (SELECT id, avg(distance) AS knn FROM n WHERE rank <= 10 GROUP BY id),
f AS (SELECT id, knn, m / lrd AS lof, 0.5 * knn + 0.5 * m / lrd AS raw FROM qk JOIN ql USING (id))
SELECT id, round(knn, 4) AS knn, round(lof, 4) AS lof, round(raw, 4) AS raw,
       round(1 / (1 + exp(-greatest(least((raw - mean) / CASE WHEN dev < 1e-6 THEN 1 ELSE dev END, 30), -30))), 4) AS novelty FROM f, cal""")
def v_calibrated_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references(spark, sf_dir)
    return V.novelty(rows, rows, exclude_self=True).select("id", *(F.round(c, 4).alias(c) for c in ("knn", "lof", "raw", "novelty")))


_CENTROID = """
e AS (SELECT vec_id // 20 AS doc_id, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT doc_id, id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
mu AS (SELECT i, avg(x) AS m FROM u GROUP BY ALL),
cd AS (SELECT u.doc_id, u.id, sqrt(sum((x - m) * (x - m))) AS d FROM u JOIN mu USING (i) GROUP BY ALL),
cp AS (SELECT doc_id, quantile_cont(d, 0.95) AS p95 FROM cd GROUP BY doc_id),
cent AS (SELECT doc_id, id, least(1, d / (p95 + 1e-9)) AS c FROM cd JOIN cp USING (doc_id))"""


@query(f"WITH {_CENTROID} SELECT doc_id, id, round(c, 6) AS centroid_distance FROM cent")
def v_centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.centroid_distance(rows, rows).select("doc_id", "id", r6("centroid_distance").alias("centroid_distance"))


@query(f"{_KNN} SELECT id, ref_id, rank, round(1 - distance, 6) AS similarity FROM n WHERE rank <= 3")
def v_nearest_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references(spark, sf_dir)
    found = V.nearest(rows, rows, k=3, exclude_self=True)
    return found.select(F.col("query_id").alias("id"), "ref_id", "rank", r6(1 - F.col("distance")).alias("similarity"))


@query(f"{_KNN} SELECT id, ref_id, rank, round(distance, 6) AS distance FROM n WHERE rank <= 5")
def v_pivot_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the pivot index at any size of the table, with small shards."""
    rows = references(spark, sf_dir)
    found = PivotIndex(rows, 5, rows=64).search(rows, exclude_self=True)
    return found.select(F.col("query_id").alias("id"), "ref_id", "rank", r6("distance").alias("distance"))


@query(f"""{_KNN}, t AS (SELECT *, 1 - distance AS s FROM n WHERE rank <= 3)
SELECT id, ref_id, rank, round(s, 6) AS similarity, max(s) OVER (PARTITION BY id) >= 0.45 AS duplicate FROM t""")
def j_similar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references(spark, sf_dir)
    found = V.similar(rows, rows, n=3, threshold=0.45, exclude_self=True)
    return found.select(F.col("query_id").alias("id"), "ref_id", "rank", r6("similarity").alias("similarity"), "duplicate")


@query(f"""WITH {REFERENCES_SQL},
w AS (SELECT id, v, unnest([label, CAST((CAST(label AS INTEGER) + 1) % 10 AS VARCHAR)]) AS wanted FROM r),
d AS (SELECT w.id, wanted, r.id AS ref_id, greatest(0, least(2, 1 - list_cosine_similarity(w.v, r.v))) AS distance FROM w JOIN r ON r.label = w.wanted AND r.id <> w.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id, wanted ORDER BY distance, ref_id) AS rank FROM d)
SELECT id, wanted AS label, ref_id, rank, round(distance, 6) AS distance FROM n WHERE rank <= 2""")
def j_contrastive_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    asked = refs.withColumn("wanted", F.array("label", ((F.col("label").cast("int") + 1) % 10).cast("string")))
    return V.exemplars(asked, refs, k=2, exclude_self=True).select(F.col("query_id").alias("id"), F.col("ref_label").alias("label"), "ref_id", "rank", r6("distance").alias("distance"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table that sweeps read: every score of every candidate."""
    refs = references(spark, sf_dir)
    rows = candidates(spark, sf_dir)
    p = F.col("p")
    rows = rows.withColumns({"u_pe": S.entropy(p), "u_lc": S.least_confidence(p), "u_margin": S.margin_uncertainty(S.softmax(F.col("logits"), 1.8))})
    vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    novel = V.knn_and_outlier_factor(refs, exclude_self=True).select(F.col("id").alias("cand_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "knn")).alias("nov_knn"), (F.col("lof") / (1 + F.col("lof"))).alias("nov_lof"))
    center = V.centroid_distance(vectors, refs).select(F.col("id").alias("cand_id"), F.col("centroid_distance").alias("nov_centroid"))
    return rows.join(mean_entropy(rows), "cand_id").join(novel, "cand_id").join(center, "cand_id")


_FEATURES = f"""{_KNN}, {_LOF}, {_CENTROID}, {CANDIDATES_SQL}, {_MEAN_P},
f0 AS (SELECT *, list_transform(logits, lambda x: exp((x - list_max(logits)) / 1.8)) AS te FROM m1),
f1 AS (SELECT *, list_transform(te, lambda x: x / list_sum(te)) AS tp FROM f0),
qk AS (SELECT id, avg(distance) AS knn FROM n WHERE rank <= 10 GROUP BY id),
feat AS (
  SELECT f1.cand_id, f1.doc_id, gold, answer, local, second, p1, p2, margin, p_o, {_ENTROPY.format(p="f1.p")} AS u_pe, 1 - p1 AS u_lc,
         1 - (list_max(tp) - list_sort(tp, 'DESC')[2]) AS u_margin,
         {_MCD} AS u_mcd, answers,
         greatest(0, least(1, knn)) AS nov_knn, (ql.m / ql.lrd) / (1 + ql.m / ql.lrd) AS nov_lof, c AS nov_centroid
  FROM f1 JOIN qk ON qk.id = f1.cand_id JOIN ql ON ql.id = f1.cand_id JOIN cent ON cent.id = f1.cand_id)"""
_COLUMNS = ("u_mcd", "u_pe", "u_margin", "u_lc", "nov_knn", "nov_lof", "nov_centroid")


@query(f"{_FEATURES} SELECT cand_id, {', '.join(f'round({c}, 6) AS {c}' for c in _COLUMNS)} FROM feat")
def x_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("cand_id", *(r6(c).alias(c) for c in _COLUMNS))


def _configs_sql(configs: list[dict]) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)"
    return f"configs({', '.join(X.FIELDS)}) AS (VALUES {', '.join('(' + ', '.join(lit(c[k]) for k in X.FIELDS) + ')' for c in configs)})"


#: From candidates and configurations to the metrics of each run.
_RUNS = """s0 AS (SELECT *, CASE method WHEN 'mcd' THEN u_mcd WHEN 'pe' THEN u_pe WHEN 'margin' THEN u_margin ELSE u_lc END AS u, CASE metric WHEN 'knn' THEN nov_knn WHEN 'lof' THEN nov_lof ELSE nov_centroid END AS nv FROM feat CROSS JOIN configs),
s1 AS (SELECT *, CASE mode WHEN 'weighted' THEN w_n * nv + w_u * u WHEN 'or' THEN greatest(u, nv) WHEN 'and' THEN least(u, nv) WHEN 'prob_or' THEN 1 - (1 - nv) * (1 - u)
  WHEN 'copula' THEN greatest(0, least(1, u + nv - 1.5 * u * nv)) ELSE 2 * nv * u / (nv + u + 1e-6) END AS fused FROM s0),
s2 AS (SELECT *, CASE mode WHEN 'or' THEN u >= tau OR nv >= tau_novelty WHEN 'and' THEN u >= tau AND nv >= tau_novelty ELSE fused >= tau END AS escalated FROM s1),
s2a AS (SELECT *, answers[CAST(exemplars AS INTEGER) * 2 + CAST(anchoring AS INTEGER) + 1] AS said FROM s2),
s2b AS (SELECT *, CASE WHEN top2 AND p1 + p2 >= 0.70 AND margin < 0.18 AND said NOT IN ('O', local, second) THEN local ELSE said END AS told FROM s2a),
s3 AS (SELECT *, CASE WHEN escalated AND arbitrate THEN CASE WHEN veto AND told = 'O' AND local <> 'O' AND margin >= margin_min AND p_o < 0.2 THEN local ELSE told END ELSE local END AS final FROM s2b),
s4 AS (SELECT sweep, run_id, gold, final, unnest(list_distinct([gold, final])) AS label FROM s3),
s5 AS (SELECT sweep, run_id, label, count(*) FILTER (gold = label AND final = label) AS tp, count(*) FILTER (gold <> label AND final = label) AS fp, count(*) FILTER (gold = label AND final <> label) AS fn FROM s4 WHERE label <> 'O' GROUP BY ALL),
s6 AS (SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM s5),
s7 AS (SELECT sweep, run_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(f1), 6) AS macro_f1 FROM s6 GROUP BY ALL),
s8 AS (SELECT run_id, count(*) AS n, count(*) FILTER (escalated) AS escalated FROM s3 GROUP BY run_id),
metrics AS (SELECT sweep, run_id, n, escalated, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, macro_f1, round(1 - escalated / n, 6) AS saved FROM s7 JOIN s8 USING (run_id))"""


def _sweep_sql(configs: list[dict], tail: str) -> str:
    return f"{_FEATURES}, {_configs_sql(configs)},\n{_RUNS}\n{tail}"


def _chain_sql() -> str:
    """Each sweep with the settings that won before it: its configurations are literals for what it varies and the winner's for the rest."""
    made = [X.weight_sweep(), X.operator_sweep(), X.uncertainty_sweep(), X.novelty_sweep(), X.threshold_sweep(), X.ablations()]
    parts, fields = [], [k for k in X.FIELDS if k not in ("run_id", "sweep")]
    for k, configs in enumerate(made):
        suffix = lambda text, k=k: re.sub(r"\b(s\d[ab]?|metrics|configs)\b", rf"\1_{k}", text)
        varied = [f for f in fields if len({c[f] for c in configs}) > 1]
        parts.append(suffix(_configs_sql(configs)).replace(f"configs_{k}(", f"given_{k}(", 1))
        names = ", ".join(f"{'g' if f in varied or not k else 'w'}.{f}" for f in fields)
        parts.append(f"configs_{k} AS (SELECT g.run_id, g.sweep, {names} FROM given_{k} g" + (f", won_{k - 1} w)" if k else ")"))
        parts.append(suffix(_RUNS))
        parts.append(f"won_{k} AS (SELECT c.*, m.macro_f1 FROM configs_{k} c JOIN metrics_{k} m ON m.run_id = c.run_id ORDER BY m.macro_f1 DESC, c.run_id LIMIT 1)")
    union = " UNION ALL ".join(f"SELECT {k} AS step, sweep, run_id, macro_f1 FROM won_{k}" for k in range(len(made)))
    return f"{_FEATURES}, " + ",\n".join(parts) + f"\n{union}"


_ALL = [*X.weight_sweep(), *X.operator_sweep(), *X.uncertainty_sweep(), *X.novelty_sweep()]


@query(_sweep_sql(_ALL, "SELECT * FROM metrics"))
def x_setting_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sweep(features(spark, sf_dir), _ALL)


@query(_sweep_sql(X.threshold_sweep(), "SELECT sweep, run_id, escalated, f1, coalesce(f1 > max(f1) OVER (PARTITION BY sweep ORDER BY escalated, f1 DESC, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS non_dominated FROM metrics"))
def x_threshold_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.non_dominated(X.sweep(features(spark, sf_dir), X.threshold_sweep())).select("sweep", "run_id", "escalated", "f1", "non_dominated")


@query(_sweep_sql(X.ablations(), "SELECT * FROM metrics"))
def x_component_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sweep(features(spark, sf_dir), X.ablations())


@query(_sweep_sql(_ALL, "SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY macro_f1 DESC, run_id) AS rank FROM metrics) WHERE rank = 1"))
def x_best_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.best(X.sweep(features(spark, sf_dir), _ALL))


@query(_sweep_sql(X.optimum(), "SELECT * FROM metrics"))
def x_named_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sweep(features(spark, sf_dir), X.optimum())


@query(_chain_sql())
def x_chained_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).persist()
    log = X.chained(rows)
    rows.unpersist()
    return spark.createDataFrame([(i, x["sweep"], x["run_id"], x["macro_f1"]) for i, x in enumerate(log)], "step int, sweep string, run_id string, macro_f1 double")


_GATED = f"""WITH {CANDIDATES_SQL},
g0 AS (SELECT *, 1 - p1 AS u, CAST(cand_id % 7 AS DOUBLE) / 7 AS nv FROM cand),
g1 AS (SELECT *, 1 - (1 - nv) * (1 - u) AS fused FROM g0),
g2 AS (SELECT *, fused >= 0.9 AND NOT (margin >= 0.5 AND p_o < 0.2) AS escalated FROM g1),
gated AS (SELECT *, CASE WHEN p1 + p2 >= 0.70 AND margin < 0.18 THEN 'TOP2_COMPETITION' WHEN p_o >= 0.25 THEN 'BACKGROUND_BORDERLINE' WHEN nv >= 0.6 AND u < 0.35 THEN 'NOVEL_UNSEEN_TERM' WHEN nv >= 0.5 THEN 'BOUNDARY_AMBIGUITY' ELSE 'CATEGORY_AMBIGUITY' END AS challenge,
  CASE WHEN escalated THEN CASE WHEN answer = 'O' AND local <> 'O' AND margin >= 0.05 AND p_o < 0.2 THEN local ELSE answer END ELSE local END AS final FROM g2)"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with fused score, escalation (blocked by a safe margin), challenge and final label."""
    rows = candidates(spark, sf_dir).withColumn("u", 1 - F.col("p1")).withColumn("nv", (F.col("cand_id") % 7).cast("double") / 7)
    c = F.col
    rows = rows.withColumn("fused", S.unreliability(F.lit("prob_or"), c("u"), c("nv"), F.lit(0.3), F.lit(0.7)))
    tau = F.lit(0.9)
    sure = S.safe(c("margin"), c("p_o"))
    rows = rows.withColumn("escalated", S.escalates(F.lit("prob_or"), c("u"), c("nv"), c("fused"), tau, tau, tau) & ~sure)
    rows = rows.withColumn("challenge", S.challenge(c("p1"), c("p2"), c("margin"), c("p_o"), c("nv"), c("u")))
    return rows.withColumn("final", F.when(c("escalated"), S.vetoed(c("answer"), c("local"), c("margin"), c("p_o"), F.lit(0.05))).otherwise(c("local")))


@query(f"{_GATED} SELECT local, count(*) AS n, count(*) FILTER (escalated) AS escalated, round(avg(CASE WHEN escalated THEN 1.0 ELSE 0 END), 6) AS rate, round(avg(fused), 6) AS mean_fused FROM gated GROUP BY local")
def flagship_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).groupBy("local").agg(F.count("*").alias("n"), F.count_if("escalated").alias("escalated"), r6(F.avg(F.col("escalated").cast("double"))).alias("rate"), r6(F.avg("fused")).alias("mean_fused"))


@query(f"""WITH {CANDIDATES_SQL}, g AS (SELECT cand_id, 1 - p1 AS u, CAST(cand_id % 7 AS DOUBLE) / 7 AS nv FROM cand)
SELECT cand_id, round(0.3 * nv + 0.7 * u, 6) AS weighted, round(greatest(u, nv), 6) AS or_score, round(least(u, nv), 6) AS and_score, round(1 - (1 - nv) * (1 - u), 6) AS prob_or,
round(greatest(0, least(1, u + nv - 1.5 * u * nv)), 6) AS copula, round(2 * nv * u / (nv + u + 1e-6), 6) AS harmonic FROM g""")
def g_unreliability_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gated(spark, sf_dir)
    modes = {"weighted": "weighted", "or": "or_score", "and": "and_score", "prob_or": "prob_or", "copula": "copula", "harmonic": "harmonic"}
    return rows.select("cand_id", *(r6(S.unreliability(F.lit(m), F.col("u"), F.col("nv"), F.lit(0.3), F.lit(0.7))).alias(name) for m, name in modes.items()))


@query(f"{_GATED} SELECT cand_id, challenge, CASE WHEN challenge = 'TOP2_COMPETITION' THEN local || ',' || second ELSE 'ALL' END AS allowed, escalated, final, CASE WHEN NOT escalated THEN 'local' WHEN final = answer THEN 'answer' ELSE 'veto' END AS source FROM gated")
def g_challenges_and_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = S.allowed_labels(F.col("challenge"), F.col("local"), F.col("second"))
    allowed = F.when(F.size(allowed) > 0, F.array_join(allowed, ",")).otherwise("ALL")
    source = S.decision_source(F.col("escalated"), F.col("answer"), F.col("final"))
    return gated(spark, sf_dir).select("cand_id", "challenge", allowed.alias("allowed"), "escalated", "final", source.alias("source"))


_OUTCOME = """CASE WHEN NOT escalated AND local <> 'O' AND local = gold THEN 'UNESCALATED_CORRECT' WHEN NOT escalated AND local = 'O' AND gold = 'O' THEN 'UNESCALATED_TN' WHEN NOT escalated THEN 'UNESCALATED_WRONG'
WHEN gold <> 'O' AND local <> gold AND final = gold THEN 'FIXED_ENTITY' WHEN gold <> 'O' AND local = gold AND final = gold THEN 'PRESERVED_CORRECT' WHEN gold <> 'O' AND local = gold THEN 'RUINED' WHEN gold <> 'O' AND final <> 'O' THEN 'CONFUSED_CATEGORY' WHEN gold <> 'O' THEN 'DROPPED_ENTITY'
WHEN local <> 'O' AND final = 'O' THEN 'FILTERED_FP' WHEN local <> 'O' AND final <> 'O' THEN 'RETAINED_FP' ELSE 'CONFIRMED_NEGATIVE' END"""
_CATEGORY = """CASE WHEN final = gold THEN CASE WHEN local = gold THEN CASE WHEN answer <> gold THEN 'ARBITRATION_SHIELD' ELSE 'CONFIRMED_ENTITY' END WHEN gold = 'O' THEN 'FALSE_POSITIVE_FILTER' WHEN local = 'O' THEN 'FALSE_NEGATIVE_RECOVERY' ELSE 'CATEGORY_CORRECTION' END
ELSE CASE WHEN local = gold AND gold <> 'O' THEN CASE WHEN final = 'O' THEN 'DROPPED_ENTITY' ELSE 'CLASS_OVERRIDE_ERROR' END WHEN gold <> 'O' AND final = 'O' THEN 'DROPPED_ENTITY' ELSE 'CONFUSED_CATEGORY' END END"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = gated(spark, sf_dir).withColumn("outcome", S.outcome(c("gold"), c("local"), c("final"), c("escalated")))
    return rows.withColumn("category", S.audit_category(c("local"), c("answer"), c("final"), c("gold"))).withColumn("grp", S.audit_group(c("category")))


_TOLD = "CASE category " + " ".join(f"WHEN '{name}' THEN '{told}'" for name, _, told in S.AUDIT) + " END"


@query(f"{_GATED}, a AS (SELECT cand_id, local, answer, final, gold, {_CATEGORY} AS category FROM gated) SELECT cand_id, category, 'proposed ' || local || ', answered ' || answer || ', kept ' || final || ', gold ' || gold || ': ' || {_TOLD} AS explanation FROM a")
def o_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return audited(spark, sf_dir).select("cand_id", "category", S.explanation(c("local"), c("answer"), c("final"), c("gold"), c("category")).alias("explanation"))


@query(f"{_GATED} SELECT cand_id, {_OUTCOME} AS outcome, {_CATEGORY} AS category FROM gated")
def o_candidate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).select("cand_id", "outcome", "category")


@query(f"""{_GATED}, a AS (SELECT {_CATEGORY} AS category FROM gated WHERE escalated), t AS (SELECT count(*) AS n FROM a)
SELECT k.category, k.grp, count(a.category) AS n, round(100.0 * count(a.category) / greatest(1, any_value(t.n)), 6) AS percent
FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b, _ in S.AUDIT)}) AS k(category, grp) LEFT JOIN a USING (category) CROSS JOIN t GROUP BY ALL""")
def a_audit_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(a, b) for a, b, _ in S.AUDIT], "category string, grp string")
    found = audited(spark, sf_dir).filter("escalated").groupBy("category").agg(F.count("*").alias("n"))
    joined = names.join(found, "category", "left").select("category", "grp", F.coalesce("n", F.lit(0)).alias("n"))
    total = joined.groupBy().agg(F.greatest(F.lit(1), F.sum("n")).alias("total"))
    return joined.join(F.broadcast(total), F.lit(True)).select("category", "grp", "n", r6(100.0 * F.col("n") / F.col("total")).alias("percent"))


@query(f"{_GATED}, a AS (SELECT *, {_OUTCOME} AS outcome FROM gated) SELECT outcome, escalated, count(*) AS n FROM a GROUP BY ALL")
def a_outcome_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).groupBy("outcome", "escalated").agg(F.count("*").alias("n"))


@query(f"""{_GATED}, l AS (SELECT 'local' AS system, gold, local AS label FROM gated UNION ALL SELECT 'final', gold, final FROM gated),
x AS (SELECT system, gold, label, unnest(list_distinct([gold, label])) AS class FROM l),
m AS (SELECT system, class, count(*) FILTER (gold = class AND label = class) AS tp, count(*) FILTER (gold <> class AND label = class) AS fp, count(*) FILTER (gold = class AND label <> class) AS fn FROM x WHERE class <> 'O' GROUP BY ALL)
SELECT system, class, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM m""")
def a_two_systems_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gated(spark, sf_dir)
    counts = by_system(rows, ["local", "final"])
    return counts.select("*", *(v.alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()))


_BY_SYSTEM = f"""{_GATED}, l AS (SELECT 'local' AS system, gold, local AS label FROM gated UNION ALL SELECT 'answer', gold, answer FROM gated UNION ALL SELECT 'final', gold, final FROM gated),
x AS (SELECT system, gold, label, unnest(list_distinct([gold, label])) AS class FROM l),
m AS (SELECT system, class, count(*) FILTER (gold = class AND label = class) AS tp, count(*) FILTER (gold <> class AND label = class) AS fp, count(*) FILTER (gold = class AND label <> class) AS fn FROM x WHERE class <> 'O' GROUP BY ALL),
s AS (SELECT system, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)), 6) AS macro_f1 FROM m GROUP BY system),
sc AS (SELECT system, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, macro_f1 FROM s)"""


@query(f"{_BY_SYSTEM} SELECT * FROM sc")
def a_system_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return system_scores(by_system(gated(spark, sf_dir), ["local", "answer", "final"]))


@query(f"{_BY_SYSTEM} SELECT round(b.precision - a.precision, 6) AS precision, round(b.recall - a.recall, 6) AS recall, round(b.f1 - a.f1, 6) AS f1, round(b.macro_f1 - a.macro_f1, 6) AS macro_f1 FROM sc a, sc b WHERE a.system = 'local' AND b.system = 'final'")
def a_system_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(system_scores(by_system(gated(spark, sf_dir), ["local", "final"])), "local", "final")


@query(f"""{_GATED}, a AS (SELECT {_CATEGORY} AS category FROM gated WHERE escalated) SELECT count(*) AS total, count(*) FILTER (category IN ('CATEGORY_CORRECTION', 'FALSE_NEGATIVE_RECOVERY', 'FALSE_POSITIVE_FILTER')) AS fixed, count(*) FILTER (category IN ('CLASS_OVERRIDE_ERROR', 'DROPPED_ENTITY')) AS ruined,
count(*) FILTER (category IN ('CATEGORY_CORRECTION', 'FALSE_NEGATIVE_RECOVERY', 'FALSE_POSITIVE_FILTER')) - count(*) FILTER (category IN ('CLASS_OVERRIDE_ERROR', 'DROPPED_ENTITY')) AS net, count(*) FILTER (category = 'ARBITRATION_SHIELD') AS shielded, count(*) FILTER (category IN ('ARBITRATION_SHIELD', 'CONFIRMED_ENTITY')) AS confirmed, count(*) FILTER (category = 'CONFUSED_CATEGORY') AS confused FROM a""")
def a_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.audit_summary(audited(spark, sf_dir).filter("escalated"))


@query(f"{_GATED} SELECT doc_id, count(*) AS n, count(*) FILTER (escalated) AS escalated, round(100.0 * count(*) FILTER (NOT escalated) / count(*), 6) AS saved_percent, count(*) FILTER (final = gold) AS right_final, count(*) FILTER (local = gold) AS right_local FROM gated GROUP BY doc_id")
def a_document_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("escalated").alias("escalated"), r6(100.0 * F.count_if(~F.col("escalated")) / F.count("*")).alias("saved_percent"), F.count_if(F.expr("final = gold")).alias("right_final"), F.count_if(F.expr("local = gold")).alias("right_local"))


_PAIRS = f"""WITH {CANDIDATES_SQL}, v AS (SELECT cand_id, local = gold AND gold <> 'O' AS s_right, answer = gold AND gold <> 'O' AS v1_right, second = gold AND gold <> 'O' AS v2_right, answer = second AS agree FROM cand),
w AS (SELECT *, CASE WHEN s_right AND v1_right THEN 'both_correct' WHEN s_right THEN 'degradation' WHEN v1_right THEN 'rescue' ELSE 'both_wrong' END AS v1_outcome,
CASE WHEN s_right AND v2_right THEN 'both_correct' WHEN s_right THEN 'degradation' WHEN v2_right THEN 'rescue' ELSE 'both_wrong' END AS v2_outcome FROM v)"""


def gating_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers of each candidate against proposal and gold; only a gold entity can be answered right."""
    c = F.col
    right = lambda x: S.right(c(x), c("gold"))
    rows = candidates(spark, sf_dir).select("cand_id", right("local").alias("s_right"), right("answer").alias("v1_right"), right("second").alias("v2_right"), (c("answer") == c("second")).alias("agree"))
    return rows.withColumn("v1_outcome", S.pair_outcome(c("s_right"), c("v1_right"))).withColumn("v2_outcome", S.pair_outcome(c("s_right"), c("v2_right")))


@query(f"{_PAIRS} SELECT cand_id, v1_outcome, v2_outcome, CAST(v1_right AS INTEGER) - CAST(s_right AS INTEGER) AS v1_benefit, s_right OR v1_right OR v2_right AS oracle FROM w")
def o_pair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating_dataset(spark, sf_dir).select("cand_id", "v1_outcome", "v2_outcome", S.benefit(F.col("s_right"), F.col("v1_right")).alias("v1_benefit"), (F.col("s_right") | F.col("v1_right") | F.col("v2_right")).alias("oracle"))


@query(f"""{_PAIRS} SELECT count(*) AS n, count(*) FILTER (s_right) AS local_right, count(*) FILTER (v1_right) AS v1_right, count(*) FILTER (v2_right) AS v2_right, count(*) FILTER (v1_outcome = 'rescue') AS rescues, count(*) FILTER (v1_outcome = 'degradation') AS degradations,
count(*) FILTER (v1_outcome = 'rescue') - count(*) FILTER (v1_outcome = 'degradation') AS net, round(avg(CASE WHEN agree THEN 1.0 ELSE 0 END), 6) AS agreement, round(avg(CASE WHEN s_right OR v1_right OR v2_right THEN 1.0 ELSE 0 END), 6) AS oracle FROM w""")
def a_two_prompt_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda cond: F.count_if(F.expr(cond))
    return gating_dataset(spark, sf_dir).agg(F.count("*").alias("n"), n("s_right").alias("local_right"), n("v1_right").alias("v1_right"), n("v2_right").alias("v2_right"), n("v1_outcome = 'rescue'").alias("rescues"), n("v1_outcome = 'degradation'").alias("degradations"), (n("v1_outcome = 'rescue'") - n("v1_outcome = 'degradation'")).alias("net"), r6(F.avg(F.expr("cast(agree as double)"))).alias("agreement"), r6(F.avg(F.expr("cast(s_right or v1_right or v2_right as double)"))).alias("oracle"))


@query(f"WITH {CANDIDATES_SQL} SELECT DISTINCT label FROM (SELECT gold AS label FROM cand UNION ALL SELECT local FROM cand UNION ALL SELECT answer FROM cand)")
def e_class_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    return rows.select(F.explode(F.array_distinct(F.array("gold", "local", "answer"))).alias("label")).distinct()
