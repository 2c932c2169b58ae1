"""Hand-computed cases of labels, chunks, marked text, answers, file formats and vectors, with nulls and empty input."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.functions import scores as S
from spanloom.operators import match as M
from spanloom.operators import prompts as P
from spanloom.operators import rules as R
from spanloom.operators import sweep as X
from spanloom.operators import text as T
from spanloom.operators import vectors as V
from spanloom.sources import annotations as A
from spanloom.sources import sinks as K


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("label", "new", "old"), [("Physical_activity", "Physical_activities", "Physical_activity"), ("B-Drugs", "B-Substance_use", "B-Drugs"), (" I-Physical_activities ", "I-Physical_activities", "I-Physical_activity"), ("Lifestyle_factor", "Lifestyle_factor", "Lifestyle_factor"), ("", "O", "O"), (None, "O", "O"), ("else", "else", "else")])
def test_label_maps(spark, label, new, old):
    assert one(spark, F.struct(L.to_new(F.col("a")), L.to_old(F.col("a"))), a=label) == (new, old)


@pytest.mark.parametrize(("answer", "label"), [("'sleep'", "Sleep"), ("Non_LSF", "O"), ("None of the above", "O"), (None, "O"), ("it is about drugs", "Substance_use"), ("unknown thing", "unknown thing"), ("`Physical_activity`", "Physical_activities")])
def test_answered_labels(spark, answer, label):
    assert one(spark, L.answered_label(F.col("a")), a=answer) == label


def test_codecs():
    assert [len(L.codec(n)) for n in (10, 11, 21)] == [10, 11, 21] and L.codec(21)[1:3] == ["B-Personal_care_products_and_cosmetic_procedures", "I-Personal_care_products_and_cosmetic_procedures"]
    with pytest.raises(ValueError):
        L.codec(12)
    assert L.column_list("6,8-11") == [6, 8, 9, 10] and L.column_list("") == []


def test_categories(spark):
    assert one(spark, L.category_key(F.col("a")), a=" Beauty-and Cleaning") == "personal_care"
    assert one(spark, L.category_key(F.col("a")), a=None) == ""


def test_large_logits_stay_finite(spark):
    u, _ = S.evidential(F.col("a"))
    assert one(spark, u, a=[1000.0, -1000.0]) == pytest.approx(2 / 1002)
    assert one(spark, S.softmax(F.col("a")), a=[1.0, 1.0 + math.log(3)]) == pytest.approx([0.25, 0.75])
    assert one(spark, S.unit(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]


def test_category_thresholds(spark):
    pick = lambda label: one(spark, S.category_threshold(F.col("a"), 0.5), a=label)
    assert (pick("Sleep"), pick("Physical_activities"), pick("other"), pick(None)) == (0.35, 0.25, 0.5, 0.5)


@pytest.mark.parametrize(("gold", "said", "error"), [("B-A", "I-A", "BIO_ERR"), ("B-A", "B-C", "CLSS_ERR"), ("B-A", "I-C", "BIO_ERR"), ("O", "B-A", "FP"), ("B-A", "O", "FN"), ("O", "O", "TN"), ("I-A", "I-A", "TP")])
def test_token_errors(spark, gold, said, error):
    assert one(spark, S.token_error(F.col("a"), F.col("b")), a=gold, b=said) == error


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "Ab c!? d\né\U0001f600."), (2, None), (3, " \t")], "doc_id long, text string")
    got = [tuple(r) for r in T.tokens(docs).orderBy("pos").collect()]
    assert got == [(1, 0, 0, 2, "Ab", 0), (1, 1, 3, 4, "c", 0), (1, 2, 4, 5, "!", 0), (1, 3, 5, 6, "?", 0), (1, 4, 7, 8, "d", 1), (1, 5, 9, 10, "é", 2), (1, 6, 10, 11, "\U0001f600", 2), (1, 7, 11, 12, ".", 2)]


def test_chunks_with_and_without_orphans(spark):
    tags = "I-A I-A B-A I-B I-A O I-A B-B I-B".split()
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "doc_id long, pos int, tag string")
    got = lambda **k: sorted((r["first"], r["last"], r["label"]) for r in T.chunks(rows, **k).collect())
    assert got() == [(0, 1, "A"), (2, 2, "A"), (3, 3, "B"), (4, 4, "A"), (6, 6, "A"), (7, 8, "B")]
    assert got(orphans=False) == [(2, 4, "A"), (7, 8, "B")]


def test_anchored_text(spark):
    docs = spark.createDataFrame([(1, "First one. Then tea and walk! End"), (2, "none")], "doc_id long, text string")
    targets = spark.createDataFrame([(1, 9, 16, 19, "tea")], "doc_id long, span_id long, start int, end int, text string")
    anchors = spark.createDataFrame([(1, 24, 28, "walk", "Activity"), (1, 0, 5, "First", "X")], "doc_id long, start int, end int, text string, label string")
    found = {r["doc_id"]: r["text"] for r in P.anchored_documents(docs, targets, anchors).collect()}
    assert found == {1: "[ANCHOR: First (X)] one. Then [TARGET: tea] and [ANCHOR: walk (Activity)]! End", 2: "none"}
    assert P.anchored_sentences(docs, targets, anchors).first()["sentence"] == "Then [TARGET: tea] and [ANCHOR: walk (Activity)]!"


def test_located_entities_are_literal(spark):
    docs = spark.createDataFrame([(1, "A.b a.B axb"), (2, r"x \E y\E")], "doc_id long, text string")
    taken = spark.createDataFrame([(1, 0, 3)], "doc_id long, start int, end int")
    new = spark.createDataFrame([(1, "a.b"), (2, r"\e"), (1, ""), (1, "zzz")], "doc_id long, entity string")
    assert sorted(map(tuple, P.located(new, docs, taken).collect())) == [(1, "a.b", 4, 7), (2, r"\e", 2, 4)]


def test_hints_and_bad_answers(spark):
    raws = [(1, '{"hints": [{"target_entity": "a", "resolution_hint": "h"}]}'), (2, "no json"), (3, None), (4, "[]")]
    rows = P.parsed_hints(spark.createDataFrame(raws, "doc_id long, raw string"))
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "a", "h", [])]
    assert P.hint_block(rows).first()["block"] == "- Hint 1 for 'a': h"


def test_document_scores_without_a_side(spark):
    schema = "doc_id long, {} long, start int, end int, label string, text string"
    gold = spark.createDataFrame([(1, 0, 0, 4, "A", "abcd"), (2, 0, 0, 4, "A", "x")], schema.format("gold_id"))
    predicted = spark.createDataFrame([(1, 0, 2, 6, "A", "cdef"), (3, 0, 0, 4, "A", "y")], schema.format("pred_id"))
    docs = spark.createDataFrame([(i,) for i in range(1, 5)], "doc_id long")
    got = {r["doc_id"]: (r["exact_precision"], r["exact_recall"], r["exact_f1"], r["partial_f1"]) for r in M.document_scores(gold, predicted, docs).collect()}
    assert got == {1: (0.0, 0.0, 0.0, 1.0), 2: (1.0, 0.0, 0.0, 0.0), 3: (0.0, 1.0, 0.0, 0.0), 4: (1.0, 1.0, 1.0, 1.0)}


def test_merged_spans(spark):
    sure = spark.createDataFrame([(1, 5, 9, "x", "A")], "doc_id long, start int, end int, text string, proposed_label string")
    told = spark.createDataFrame([(1, 5, 12, "y", "B", 0.7)], "doc_id long, start int, end int, text string, arbitrated_label string, uncertainty double")
    got = {r["place"]: (r["final_label"], r["answer"], r["escalated"], r["uncertainty"]) for r in M.merged(sure, told).collect()}
    assert got == {1: ("B", "B", True, 0.7), 2: ("A", "O", False, 0.0)}


def test_rule_ids_follow_on(spark):
    rules = spark.createDataFrame([("NUT-0007",)], "bullet_id string")
    added = spark.createDataFrame([("NUT", 5), ("NUT", 25_000), ("NUT", 9), ("SLE", 1)], "abbr string, seq long")
    got = {(r["abbr"], r["seq"]): r["bullet_id"] for r in R.next_ids(rules, added).collect()}
    assert got == {("NUT", 5): "NUT-0008", ("NUT", 9): "NUT-0009", ("NUT", 25_000): "NUT-0010", ("SLE", 1): "SLE-0001"}
    assert R.due(49, 1) and not R.due(50, 49) and R.due(50, 50)


def test_ablations():
    runs = X.ablations()
    assert len(runs) == 15 and runs[0]["tau"] == 1.0 and sum(not r["veto"] and not r["top2"] and not r["exemplars"] and not r["anchoring"] for r in runs) == 1
    assert all(runs[-1][c] for c in X.COMPONENTS)


def test_nearest_with_ties_and_classes(spark):
    refs = spark.createDataFrame([(i, "ab"[i % 2], [1.0, float(i // 4)]) for i in range(8)], "id long, label string, v array<double>")
    got = sorted((r["query_id"], r["rank"], r["ref_id"]) for r in V.nearest(refs.filter("id = 0"), refs, 3, exclude_self=True).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    asked = refs.filter("id = 0").withColumn("wanted", F.array(F.lit("b"), F.lit("none")))
    assert [(r["ref_id"], r["ref_label"]) for r in V.exemplars(asked, refs, 1, exclude_self=True).collect()] == [(1, "b")]
    rng = np.random.default_rng(1)
    many = spark.createDataFrame([(i, "x", rng.standard_normal(4).tolist()) for i in range(60)], "id long, label string, v array<double>")
    lof = {r["id"]: r["lof"] for r in V.local_outlier_factor(many, many, 5, exclude_self=True).collect()}
    assert len(lof) == 60 and all(0.2 < x < 10 for x in lof.values())


def test_centroid_is_that_of_the_references(spark):
    vectors = spark.createDataFrame([(1, 1, [3.0, 4.0]), (1, 2, [0.0, 0.0])], "doc_id long, id long, v array<double>")
    refs = spark.createDataFrame([(9, [1.0, 1.0]), (8, [-1.0, -1.0])], "id long, v array<double>")
    got = {r["id"]: r["centroid_distance"] for r in V.centroid_distance(vectors, refs).collect()}
    assert got[1] == 1.0 and got[2] == 0.0


def test_sampled_keys(spark):
    key = one(spark, V.sampled_key(F.col("a"), 16), a=[float(i) / 3 for i in range(16)])
    assert key.split("|")[:3] == ["0.0000", "0.6667", "1.3333"] and len(key.split("|")) == 8


def test_files_by_name(spark, tmp_path):
    (tmp_path / "d1.txt").write_text("tea and walk")
    (tmp_path / "d1.ann").write_text("T1\tSleep 0 3\ttea\nT2\tNutrition 4 7;8 12\tand walk\nA1\tNegated T1\nT9\tbroken\n")
    (tmp_path / "d2.txt").write_text("x")
    rows = {r["doc_id"]: r for r in A.read_corpus(spark, "mine", {"mine": str(tmp_path)}, labels=["Nutrition"]).collect()}
    assert [tuple(e)[:3] for e in rows["d1"]["entities"]] == [(4, 12, "Nutrition")] and rows["d2"]["missing"] == "annotations"
    lines = A.read_lines(spark, f"{tmp_path}/*.ann")
    assert [tuple(r) for r in A.flags(lines).collect()] == [("d1", "T1", "Negated")]
    assert A.standoff(lines).filter("bad").count() == 1
    assert sorted((r["start"], r["end"]) for r in A.spans(A.standoff(lines), "last").collect()) == [(0, 3), (8, 12)]
    assert A.ontology_of("/data/new/x", A.standoff(lines), []) == "new" and A.ontology_of("/x", A.standoff(lines), ["Sleep"]) == "new" and A.ontology_of("/x", A.standoff(lines), ["Z"]) == "legacy"


def test_column_files_side_by_side(spark, tmp_path):
    for side, text in (("gold", "a B-X\nb O\n\nc I-X\n"), ("pred", "a O\n")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "d.bio").write_text(text)
    both = A.paired(A.numbered(spark, str(tmp_path / "gold")), A.numbered(spark, str(tmp_path / "pred")))
    lines = sorted((r["n"], r["line"]) for r in K.pair_lines(both).collect())
    assert lines == [(0, "a\tB-X\tO"), (1, "b\tO\tO"), (2, "c\tI-X\tO")]


def test_vector_stores(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"7": {"ground_truth": [{"text": "t", "label": "L", "embedding": [1, 2]}, {"text": "t", "label": "L", "embedding": [1, 2]}], "predicted": []}, "8": {"predicted": [{"text": "u", "label": "M", "embedding": [3, 4]}]}}))
    allowed = spark.createDataFrame([("7",)], "abstract_id string")
    rows = A.vector_records(spark, str(tmp_path / "a.json"), allowed, size=2)
    assert [(r["abstract_id"], r["source"], r["text"], list(r["embedding"])) for r in rows.collect()] == [("7", "ground_truth", "t", [1.0, 2.0])]
    (tmp_path / "b.json").write_text("[[1, 2], [3, 4]]")
    assert A.vector_records(spark, str(tmp_path / "b.json")).count() == 2
