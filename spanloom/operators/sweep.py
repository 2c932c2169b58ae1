"""Grids of gating settings, evaluated in one job: every candidate is scored under every configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import scores as S
from spanloom.functions.metrics import prf

FIELDS = ["run_id", "sweep", "mode", "w_n", "w_u", "method", "metric", "tau", "tau_novelty", "margin_min", "arbitrate", "exemplars", "anchoring", "top2", "veto"]
#: The settings from which the sweeps start.
BASE = {"mode": "weighted", "w_n": 0.5, "w_u": 0.5, "method": "mcd", "metric": "knn", "tau": 0.38, "tau_novelty": 0.55, "margin_min": 0.5, "arbitrate": True, "exemplars": True, "anchoring": True, "top2": True, "veto": True}
#: The recommended settings.
OPTIMUM = {"mode": "prob_or", "w_n": 0.3, "w_u": 0.7, "method": "margin", "metric": "lof", "tau": 0.35, "margin_min": 0.5, "veto": True}
#: Components of arbitration, and the combinations of them that an ablation switches on, after a run without any escalation.
COMPONENTS = ("exemplars", "anchoring", "top2", "veto")
COMBINATIONS = ["", "anchoring", "exemplars", "top2", "veto", "anchoring top2", "anchoring veto", "top2 veto", "exemplars anchoring", "anchoring top2 veto", "exemplars top2 veto", "exemplars anchoring veto", "exemplars anchoring top2", "exemplars anchoring top2 veto"]


def _runs(name: str, settings: list[dict]) -> list[dict]:
    return [{"run_id": f"{name}-{i:02d}", "sweep": name} | BASE | s for i, s in enumerate(settings)]


#: Fixed values of the sweeps: steps of the weights, modes, methods, metrics and thresholds.
def weight_sweep() -> list[dict]:
    return _runs("weights", [{"w_n": round(i / 10, 1), "w_u": round(1 - i / 10, 1)} for i in range(11)])


def operator_sweep() -> list[dict]:
    return _runs("operators", [{"mode": m} for m in ("weighted", "or", "and", "prob_or", "copula")])


def uncertainty_sweep() -> list[dict]:
    return _runs("uncertainty", [{"method": m} for m in ("mcd", "pe", "margin", "lc")])


def novelty_sweep() -> list[dict]:
    return _runs("novelty", [{"metric": m} for m in ("knn", "lof", "centroid")])


def threshold_sweep() -> list[dict]:
    return _runs("thresholds", [{"tau": round(0.20 + 0.05 * i, 2)} for i in range(9)])


def ablations(settings: dict | None = None) -> list[dict]:
    """Fifteen runs: proposals alone (no candidate reaches the threshold), then each of COMBINATIONS."""
    runs = [{"tau": 1.0}] + [{c: c in names.split() for c in COMPONENTS} for names in COMBINATIONS]
    return _runs("ablation", [(settings or {}) | x for x in runs])


def optimum() -> list[dict]:
    return _runs("optimum", [OPTIMUM])


def with_configs(candidates: DataFrame, configs: list[dict]) -> DataFrame:
    """Each candidate with each configuration: the settings are a literal array, so nothing is joined or shuffled."""
    rows = F.array(*(F.struct(*(F.lit(c[k]).alias(k) for k in FIELDS)) for c in configs))
    return candidates.withColumn("config", F.explode(rows)).select("*", "config.*").drop("config")


def _chosen(key: str, prefix: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(F.col(key) == n, F.col(f"{prefix}_{n}")) for n in names))


def decided(rows: DataFrame) -> DataFrame:
    """Adds the chosen scores, escalated and final to candidates with configurations.

    Candidates need u_mcd, u_pe, u_margin, u_lc, nov_knn, nov_lof, nov_centroid,
    gold, local, second, margin, p_o, and the answer of each form of the prompt:
    a map ``answers`` from two digits (exemplars, anchoring), or one ``answer`` for
    all. With ``top2`` a challenge between the two best classes may be answered by
    them or O only; another answer leaves the proposal.
    """
    form = F.concat(F.col("exemplars").cast("int").cast("string"), F.col("anchoring").cast("int").cast("string"))
    told = F.coalesce(F.col("answers")[form], F.col("answer")) if "answers" in rows.columns else F.col("answer")
    competing = (F.col("p1") + F.col("p2") >= 0.70) & (F.col("margin") < 0.18)
    barred = F.col("top2") & competing & (told != "O") & (told != F.col("local")) & (told != F.col("second"))
    rows = rows.withColumn("told", F.when(barred, F.col("local")).otherwise(told))
    u = _chosen("method", "u", ("mcd", "pe", "margin", "lc"))
    n = _chosen("metric", "nov", ("knn", "lof", "centroid"))
    rows = rows.withColumn("u", u).withColumn("n", n)
    rows = rows.withColumn("fused", S.unreliability(F.col("mode"), F.col("u"), F.col("n"), F.col("w_n"), F.col("w_u")))
    escalated = S.escalates(F.col("mode"), F.col("u"), F.col("n"), F.col("fused"), F.col("tau"), F.col("tau"), F.col("tau_novelty"))
    rows = rows.withColumn("escalated", escalated)
    kept = F.when(F.col("veto"), S.vetoed(F.col("told"), F.col("local"), F.col("margin"), F.col("p_o"), F.col("margin_min"))).otherwise(F.col("told"))
    return rows.withColumn("final", F.when(F.col("escalated") & F.col("arbitrate"), kept).otherwise(F.col("local")))


def run_metrics(rows: DataFrame) -> DataFrame:
    """Micro and macro scores and cost of each run, from one aggregation by run and class; a null class holds the cost, so that candidates are read once."""
    classes = F.filter(F.array_distinct(F.array("gold", "final")), lambda x: x.isNotNull() & (x != "O"))
    rows = rows.select("sweep", "run_id", "gold", "final", "escalated", F.explode(F.concat(classes, F.array(F.lit(None).cast("string")))).alias("label"))
    by_class = rows.groupBy("sweep", "run_id", "label").agg(
        F.count_if((F.col("gold") == F.col("label")) & (F.col("final") == F.col("label"))).alias("tp"),
        F.count_if((F.col("gold") != F.col("label")) & (F.col("final") == F.col("label"))).alias("fp"),
        F.count_if((F.col("gold") == F.col("label")) & (F.col("final") != F.col("label"))).alias("fn"),
        F.count("*").alias("n"),
        F.count_if("escalated").alias("escalated"),
    )
    f1 = F.when(F.col("label").isNotNull(), prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"])
    cost = lambda name: F.max(F.when(F.col("label").isNull(), F.col(name))).alias(name)
    runs = by_class.groupBy("sweep", "run_id").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")), F.round(F.avg(f1), 6).alias("macro_f1"), cost("n"), cost("escalated"), F.count("label").alias("classes"))
    scores = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return runs.filter("classes > 0").select("sweep", "run_id", "n", "escalated", "tp", "fp", "fn", *(v.alias(k) for k, v in scores.items()), "macro_f1", F.round(1 - F.col("escalated") / F.col("n"), 6).alias("saved"))


def sweep(candidates: DataFrame, configs: list[dict]) -> DataFrame:
    return run_metrics(decided(with_configs(candidates, configs)))


def best(metrics: DataFrame, by: str = "macro_f1") -> DataFrame:
    """The best run of each sweep, the first on ties."""
    w = Window.partitionBy("sweep").orderBy(F.desc(by), "run_id")
    return metrics.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def non_dominated(metrics: DataFrame) -> DataFrame:
    """Marks runs that no other run of the sweep beats in cost and F1: a running maximum over runs by cost."""
    w = Window.partitionBy("sweep").orderBy("escalated", F.desc("f1"), "run_id")
    before = F.max("f1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return metrics.withColumn("non_dominated", before.isNull() | (F.col("f1") > before))


def chained(candidates: DataFrame, by: str = "macro_f1") -> list[dict]:
    """Sweeps in turn, each starting from the best settings so far; one small job for each."""
    settings, log = {}, []
    for make in (weight_sweep, operator_sweep, uncertainty_sweep, novelty_sweep, threshold_sweep, ablations):
        varied = [c for c in make()]
        keys = [k for k in BASE if len({c[k] for c in varied}) > 1]
        configs = [c | {k: v for k, v in settings.items() if k not in keys} for c in varied]
        won = best(sweep(candidates, configs), by).first()
        config = next(c for c in configs if c["run_id"] == won["run_id"])
        settings |= {k: config[k] for k in keys}
        log.append({"sweep": won["sweep"], "run_id": won["run_id"], by: won[by], **settings})
    return log
