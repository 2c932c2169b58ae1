"""Hand-computed cases of matching, tags, suppression and gating."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.functions import scores as S
from spanloom.operators import curate as C
from spanloom.operators import match as M
from spanloom.operators import prompts as P
from spanloom.operators import rules as R
from spanloom.operators import text as T
from spanloom.sources import annotations as A


def gold(spark, *spans):
    return spark.createDataFrame([(1, i, s, e, lab, t) for i, (s, e, lab, t) in enumerate(spans)], "doc_id long, gold_id long, start int, end int, label string, text string")


def pred(spark, *spans):
    return gold(spark, *spans).withColumnRenamed("gold_id", "pred_id")


def counts(rows):
    r = rows.first()
    return r["tp"], r["fp"], r["fn"]


def test_strict_duplicates(spark):
    rows = M.one_to_one(gold(spark, (0, 5, "A", "x")), pred(spark, (0, 5, "A", "x"), (0, 5, "A", "x")))
    assert counts(rows) == (1, 1, 0)


def test_partial_is_one_to_one_and_mention_is_not(spark):
    g, p = gold(spark, (0, 10, "A", "abcdefghij")), pred(spark, (0, 4, "A", "abcd"), (6, 10, "A", "ghij"))
    assert counts(M.one_to_one(g, p, "partial")) == (1, 1, 0)
    r = M.mention_coverage(g, p).first()
    assert (r["tp"], r["covered"], r["n_gold"]) == (2, 1, 1)


def test_nested_start_slip(spark):
    g, p = gold(spark, (10, 15, "A", "sleep")), pred(spark, (11, 16, "A", "sleep"))
    assert counts(M.one_to_one(g, p, "nested")) == (1, 0, 0)
    assert counts(M.one_to_one(g, p, "strict")) == (0, 1, 1)


def test_long_spans_cross_buckets(spark):
    g, p = gold(spark, (0, 500, "A", "x")), pred(spark, (450, 900, "A", "y"))
    assert counts(M.one_to_one(g, p, "partial")) == (1, 0, 0)


def test_overlap_elimination(spark):
    make = lambda *s: spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(s)], "doc_id long, span_id long, start int, end int")
    left = lambda *s: [(r["start"], r["end"]) for r in T.eliminate_overlaps(make(*s)).collect()]
    assert left((0, 4), (2, 6)) == []
    assert left((0, 6), (2, 4)) == [(0, 6)]


@pytest.mark.parametrize(("order", "kept"), [("length", [(3, 12), (12, 14)]), ("probability", [(0, 5), (12, 14)])])
def test_suppression(spark, order, kept):
    rows = spark.createDataFrame([(1, 0, 0, 5, 0.9), (1, 1, 3, 12, 0.8), (1, 2, 12, 14, 0.5)], "doc_id long, span_id long, start long, end long, p double")
    assert sorted((r["start"], r["end"]) for r in T.suppress(rows, order).collect()) == kept


def tagged(spark, *tags):
    return spark.createDataFrame([(1, i, 0, 4 * i, 4 * i + 3, t) for i, t in enumerate(tags)], "doc_id long, pos int, sent_id int, start int, end int, tag string")


def test_tags_to_spans(spark):
    runs = lambda *t, **k: [(r["start"], r["end"]) for r in T.tags_to_spans(tagged(spark, *t), **k).orderBy("start").collect()]
    assert runs("O", "I-A", "I-A") == [(4, 11)]
    assert runs("I-A", "O") == [(0, 3)]
    assert runs("B-A", "I-A") == [(0, 7)]
    assert runs("B-A", "I-A", max_gap=0) == [(0, 3), (4, 7)]
    assert runs("B-A", "I-B") == [(0, 3), (4, 7)]


def test_tokens_slice_to_their_text(spark):
    text = "Sleep well! é2 go.\nNext\t(line)"
    rows = T.tokens(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert all(text[r["start"] : r["end"]] == r["token"] for r in rows)
    assert [r["token"] for r in sorted(rows, key=lambda r: r["pos"])] == ["Sleep", "well", "!", "é", "2", "go", ".", "Next", "(", "line", ")"]
    assert max(r["sent_id"] for r in rows) == 3


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(("mode", "value"), [("copula", 0.625), ("prob_or", 0.75), ("or", 0.5), ("and", 0.5), ("weighted", 0.5)])
def test_unreliability(spark, mode, value):
    half = F.lit(0.5)
    assert one(spark, S.unreliability(F.lit(mode), half, half, half, half)) == pytest.approx(value)


def test_challenge_order_and_veto(spark):
    lit = F.lit
    assert one(spark, S.challenge(lit(0.45), lit(0.40), lit(0.05), lit(0.30), lit(0.9), lit(0.1))) == "TOP2_COMPETITION"
    assert one(spark, S.vetoed(lit("O"), lit("A"), lit(0.5), lit(0.19), lit(0.5))) == "A"
    assert one(spark, S.vetoed(lit("O"), lit("A"), lit(0.5), lit(0.20), lit(0.5))) == "O"


def test_labels(spark):
    assert one(spark, L.to_new(F.lit("B-Drugs"))) == "B-Substance_use"
    assert one(spark, L.to_old(F.lit("Substance_use"))) == "Drugs"
    assert one(spark, L.to_new(F.lit(""))) == "O"
    assert one(spark, L.canonical(F.lit("SLEEP"))) == "Sleep"
    assert one(spark, L.tolerant_double(F.lit("x"), 2.0)) == 2.0


def test_standoff_policies(spark):
    lines = spark.createDataFrame([("d", "T6\tSleep 741 752;767 776\torthodontic dentistry"), ("d", "T7\tSleep x\ty"), ("d", "# note"), ("d", "A1\tNegated T6")], "doc_id string, line string")
    entities = A.standoff(lines)
    at = lambda policy: [(r["start"], r["end"]) for r in A.spans(entities, policy).collect()]
    assert at("hull") == [(741, 776)]
    assert at("fragments") == [(741, 752), (767, 776)]
    assert at("last") == [(767, 776)]
    assert entities.filter("bad").count() == 1
    assert A.flags(lines).first()["flag"] == "Negated"


def test_density_pick(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 11)], "density double")
    assert C.density_statistics(rows).first()["p95"] == 10.0


def test_prune_and_next_ids(spark):
    rules = spark.createDataFrame([("NUT-0007", "Nutrition", 1, 6), ("NUT-0003", "Nutrition", 1, 5)], "bullet_id string, section string, helpful long, harmful long")
    kept, removed = R.pruned(rules)
    assert [r["bullet_id"] for r in kept.collect()] == ["NUT-0003"] and removed.count() == 1
    added = spark.createDataFrame([("NUT", 1), ("NUT", 2), ("SLE", 1)], "abbr string, seq long")
    assert sorted(r["bullet_id"] for r in R.next_ids(rules, added).collect()) == ["NUT-0008", "NUT-0009", "SLE-0001"]


def test_answers_are_salvaged(spark):
    raw = [(1, '```json\n{"labeled_entities": [{"entity": "nap", "final_label": "Sleep"}], "new_discovered_entities": [{"entity": "work", "final_label": "O"}]}\n```'), (2, '[{"entity": "a", "final_label": "B"}]'), (3, 'broken {"entity": "c", "final_label": "D"'), (4, None)]
    rows = P.parsed(spark.createDataFrame(raw, "doc_id long, raw string")).orderBy("doc_id", "kind").collect()
    assert [(r["doc_id"], r["kind"], r["entity"], r["final_label"]) for r in rows] == [(1, "labelled", "nap", "Sleep"), (1, "new", "work", "O"), (2, "labelled", "a", "B"), (3, "labelled", "c", "D")]


def test_error_table_and_numbered_lines(spark):
    raw = spark.createDataFrame([(1, "| Token | Type |\n|---|---|\n| nap | FN |\n3a. Sleep\n4) nothing")], "doc_id long, raw string")
    assert [(r["token"], r["error_type"]) for r in P.error_table(raw).collect()] == [("nap", "FN")]
    assert [(r["number"], r["part"], r["label"]) for r in P.numbered_lines(raw, ["Sleep"]).orderBy("number").collect()] == [(3, "a", "Sleep"), (4, "", "O")]


def test_location_skips_taken_spans(spark):
    docs = spark.createDataFrame([(1, "Nap then nap")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "nap"), (1, "zzz")], "doc_id long, entity string")
    taken = spark.createDataFrame([(1, 0, 3)], "doc_id long, start int, end int")
    assert [(r["start"], r["end"]) for r in P.located(new, docs, taken).collect()] == [(9, 12)]
