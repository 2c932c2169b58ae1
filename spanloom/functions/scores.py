"""Column expressions over class distributions: uncertainty, gating, arbitration and audit outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.labels import canonical, to_old

#: Labels that name no entity.
NEGATIVE = ["o", "non_lsf", "lsf_out_of_context"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, not once for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp((x - top) / temperature)))
    return let(powers, lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def top1(p: Column) -> Column:
    return F.array_max(p)


def top2(p: Column) -> Column:
    return F.element_at(F.sort_array(p, asc=False), 2)


def top1_class(p: Column) -> Column:
    """Index of the largest value, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top2_class(p: Column) -> Column:
    """Index of the second largest value; the first other index on ties."""
    rest = F.transform(p, lambda x, i: F.when(i == top1_class(p), F.lit(-1.0)).otherwise(x))
    return (F.array_position(rest, F.array_max(rest)) - 1).cast("int")


def least_confidence(p: Column) -> Column:
    return 1 - F.array_max(p)


def entropy(p: Column) -> Column:
    """Normalised to [0, 1] by the number of classes."""
    return -_sum(F.transform(p, lambda x: x * F.log(x + 1e-9))) / F.log(F.size(p).cast("double"))


def margin_uncertainty(p: Column) -> Column:
    return 1 - (top1(p) - top2(p))


def evidential(logits: Column) -> tuple[Column, Column]:
    """(uncertainty, expected probabilities) of a Dirichlet with softplus evidence."""
    alpha = F.transform(logits, lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))) + 1)
    return F.size(logits) / _sum(alpha), let(alpha, lambda e: let(_sum(e), lambda total: F.transform(e, lambda a: a / total)))


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector is divided by 1e-10."""
    norm = F.sqrt(_sum(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))
    return let(F.when(norm == 0, F.lit(1e-10)).otherwise(norm), lambda n: F.transform(vector, lambda x: x.cast("double") / n))


def logistic(score: Column, mean: Column, deviation: Column) -> Column:
    """Calibrated novelty: logistic of the z-score, which is clipped at 30; tiny deviations count as 1."""
    z = (score - mean) / F.when(deviation < 1e-6, F.lit(1.0)).otherwise(deviation)
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def unreliability(mode: Column, u: Column, n: Column, w_n: Column, w_u: Column, beta: float = 0.5) -> Column:
    """Fuses uncertainty and novelty: weighted, or, and, prob_or, copula, harmonic."""
    copula = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u + n - (1 + beta) * u * n))
    return (
        F.when(mode == "weighted", w_n * n + w_u * u)
        .when(mode == "or", F.greatest(u, n))
        .when(mode == "and", F.least(u, n))
        .when(mode == "prob_or", 1 - (1 - n) * (1 - u))
        .when(mode == "copula", copula)
        .when(mode == "harmonic", 2 * n * u / (n + u + 1e-6))
    )


def escalates(mode: Column, u: Column, n: Column, fused: Column, tau: Column, tau_category: Column, tau_novelty: Column) -> Column:
    """Whether a candidate goes to arbitration; without a novelty value uncertainty alone decides."""
    return F.when(n.isNull(), u >= tau_category).when(mode == "or", (u >= tau_category) | (n >= tau_novelty)).when(mode == "and", (u >= tau_category) & (n >= tau_novelty)).otherwise(fused >= tau)


def challenge(p1: Column, p2: Column, margin: Column, p_o: Column, n: Column, u: Column) -> Column:
    """Challenge type; the first rule that fits."""
    return (
        F.when((p1 + p2 >= 0.70) & (margin < 0.18), "TOP2_COMPETITION")
        .when(p_o >= 0.25, "BACKGROUND_BORDERLINE")
        .when((n >= 0.60) & (u < 0.35), "NOVEL_UNSEEN_TERM")
        .when(n >= 0.50, "BOUNDARY_AMBIGUITY")
        .otherwise("CATEGORY_AMBIGUITY")
    )


def vetoed(answer: Column, local: Column, margin: Column, p_o: Column, margin_min: Column, p_o_max: float | None = 0.20) -> Column:
    """The answer, unless it deletes a local label of high margin; ``p_o_max`` None drops the background bound."""
    veto = (F.upper(answer) == "O") & (F.upper(local) != "O") & (margin >= margin_min)
    return F.when(veto & (p_o < p_o_max) if p_o_max is not None else veto, local).otherwise(answer)


#: Uncertainty from which a proposal of a class is escalated.
CATEGORY_THRESHOLDS = [
    ("Nutrition", 0.25),
    ("Physical_activity", 0.25),
    ("Physical_activities", 0.25),
    ("Sleep", 0.35),
    ("Socioeconomic_factors", 0.35),
    ("Environmental_exposures", 0.35),
    ("Drugs", 0.25),
    ("Substance_use", 0.25),
    ("Non_physical_leisure_time_activities", 0.35),
    ("Mental_health_practices", 0.40),
    ("Beauty_and_Cleaning", 0.40),
    ("Personal_care_products_and_cosmetic_procedures", 0.40),
]


def category_threshold(label: Column, default: Column | float, thresholds: list[tuple[str, float]] = CATEGORY_THRESHOLDS) -> Column:
    """The threshold of a label, else of its legacy name, else the default; a threshold of 0 counts as none."""
    table = F.create_map(*(F.lit(x) for name, value in thresholds if value for x in (name, value)))
    return F.coalesce(table[label], table[to_old(label)], default if isinstance(default, Column) else F.lit(default))


def safe(margin: Column, p_o: Column, least: float = 0.5, p_o_max: float | None = 0.20) -> Column:
    """Whether a proposal's margin is so decisive that it isn't escalated; ``p_o_max`` None drops the background bound."""
    return (margin >= least) & (p_o < p_o_max) if p_o_max is not None else margin >= least


def allowed_labels(challenge_type: Column, local: Column, second: Column, entities_only: bool = False) -> Column:
    """The classes that an answer may choose from: the two best ones where they compete, else none named (any).

    ``entities_only`` leaves out O and a double as second.
    """
    pair = F.array(local, second)
    pair = F.when((F.upper(second) == "O") | (second == local), F.array(local)).otherwise(pair) if entities_only else pair
    return F.when(challenge_type == "TOP2_COMPETITION", pair).otherwise(F.array().cast("array<string>"))


def decision_source(escalated: Column, answer: Column, final: Column) -> Column:
    """Who decided: local, answer, or veto where the answer didn't stand."""
    return F.when(~escalated, "local").when(final == answer, "answer").otherwise("veto")


def right(label: Column, gold: Column) -> Column:
    """Whether a label is right; only a gold entity can be answered right."""
    return (label == gold) & (F.upper(gold) != "O")


def benefit(before: Column, after: Column) -> Column:
    """1, 0 or -1: what an answer's being right adds to the proposal's."""
    return after.cast("int") - before.cast("int")


def positive(label: Column) -> Column:
    return ~F.lower(label).isin(NEGATIVE)


def outcome(gold: Column, local: Column, final: Column, escalated: Column) -> Column:
    """One of eleven outcomes of a candidate, over canonical labels."""
    gold, local, final = canonical(gold), canonical(local), canonical(final)
    s, g, f = positive(local), positive(gold), positive(final)
    return (
        F.when(~escalated & s & (local == gold), "UNESCALATED_CORRECT")
        .when(~escalated & ~s & ~g, "UNESCALATED_TN")
        .when(~escalated, "UNESCALATED_WRONG")
        .when(g & (local != gold) & (final == gold), "FIXED_ENTITY")
        .when(g & (local == gold) & (final == gold), "PRESERVED_CORRECT")
        .when(g & (local == gold), "RUINED")
        .when(g & f, "CONFUSED_CATEGORY")
        .when(g, "DROPPED_ENTITY")
        .when(s & ~f, "FILTERED_FP")
        .when(s & f, "RETAINED_FP")
        .otherwise("CONFIRMED_NEGATIVE")
    )


def audit_category(local: Column, answer: Column, final: Column, gold: Column) -> Column:
    """One of eight audit categories, over lower-case labels."""
    s, a, f, g = (F.lower(x) for x in (local, answer, final, gold))
    right = F.when(s == g, F.when(a != g, "ARBITRATION_SHIELD").otherwise("CONFIRMED_ENTITY")).when(g == "o", "FALSE_POSITIVE_FILTER").when(s == "o", "FALSE_NEGATIVE_RECOVERY").otherwise("CATEGORY_CORRECTION")
    wrong = F.when((s == g) & (g != "o"), F.when(f == "o", "DROPPED_ENTITY").otherwise("CLASS_OVERRIDE_ERROR")).when((g != "o") & (f == "o"), "DROPPED_ENTITY").otherwise("CONFUSED_CATEGORY")
    return F.when(f == g, right).otherwise(wrong)


#: Audit category, its group, and what it says.
AUDIT = [
    ("ARBITRATION_SHIELD", "CONFIRMED_CORRECT", "a wrong answer was held off"),
    ("CONFIRMED_ENTITY", "CONFIRMED_CORRECT", "a right label was confirmed"),
    ("FALSE_POSITIVE_FILTER", "FIXED", "a false entity was removed"),
    ("FALSE_NEGATIVE_RECOVERY", "FIXED", "a missed entity was found"),
    ("CATEGORY_CORRECTION", "FIXED", "a wrong class was corrected"),
    ("DROPPED_ENTITY", "RUINED", "an entity was lost"),
    ("CLASS_OVERRIDE_ERROR", "RUINED", "a right class was overridden"),
    ("CONFUSED_CATEGORY", "NOT_FIXED", "a wrong label stayed wrong"),
]


def audit_group(category: Column) -> Column:
    table = F.create_map(*(F.lit(x) for name, group, _ in AUDIT for x in (name, group)))
    return F.coalesce(table[category], F.lit("NOT_FIXED"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row: total, fixed, ruined, net, shielded, confirmed, confused of rows with an audit ``category``."""
    n = lambda *names: F.count_if(F.col("category").isin(*names))
    of = lambda group: n(*(name for name, g, _ in AUDIT if g == group))
    return audited.agg(F.count("*").alias("total"), of("FIXED").alias("fixed"), of("RUINED").alias("ruined"), (of("FIXED") - of("RUINED")).alias("net"), n("ARBITRATION_SHIELD").alias("shielded"), of("CONFIRMED_CORRECT").alias("confirmed"), of("NOT_FIXED").alias("confused"))


def explanation(local: Column, answer: Column, final: Column, gold: Column, category: Column) -> Column:
    told = F.create_map(*(F.lit(x) for name, _, text in AUDIT for x in (name, text)))
    return F.format_string("proposed %s, answered %s, kept %s, gold %s: %s", local, answer, final, gold, told[category])


def pair_outcome(first_right: Column, second_right: Column) -> Column:
    """Of a proposal and an answer: both_correct, degradation, rescue, both_wrong."""
    return F.when(first_right & second_right, "both_correct").when(first_right, "degradation").when(second_right, "rescue").otherwise("both_wrong")


def token_error(gold: Column, predicted: Column) -> Column:
    """TN, FP, FN, TP, CLSS_ERR (another class) or BIO_ERR (another prefix) of two tags."""
    return (
        F.when((gold == "O") & (predicted == "O"), "TN")
        .when(gold == "O", "FP")
        .when(predicted == "O", "FN")
        .when(gold == predicted, "TP")
        .when(F.left(gold, F.lit(1)) == F.left(predicted, F.lit(1)), "CLSS_ERR")
        .otherwise("BIO_ERR")
    )
