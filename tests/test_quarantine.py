"""Bad records set apart, and label columns attached with a check."""

import pytest
from pyspark.sql import functions as F

from spanloom.sources import quarantine as Q


def lines(spark, *rows):
    return spark.createDataFrame([("d", i + 1, x) for i, x in enumerate(rows)], "doc_id string, line_no int, line string")


def test_standoff_reasons(spark):
    told = ["T1\tSleep 0 3\tnap", "", "#1\tNote", "A1\tNeg T1", "A2\tNeg", "T2\tSleep 0 3", "T3\tSleep 0\tnap", "T4\tSleep 3 3\tx", "T5\tOdd 0 3\tnap", "T1\tSleep 4 5\tn", "X", "T6\tSleep 0 3;7 5\tnap", "T7\tSleep 0 3;5 7\tnap", "T8", "T9\tSleep 99999999999 3\tnap"]
    got = {r["line_no"]: r["reason"] for r in Q.standoff_records(lines(spark, *told), ["Sleep"]).collect()}
    bad = {5: "an attribute needs a target", 6: "an entity needs three cells", 7: "unreadable offsets", 8: "an empty span", 9: "unknown type Odd", 10: "second entity T1", 11: "unknown kind of line", 12: "an empty span", 14: "an entity needs three cells", 15: "an empty span"}
    assert got == {i + 1: bad.get(i + 1) for i, x in enumerate(told) if x}


def test_records_are_written_apart_and_counted(spark, tmp_path):
    good, bad, counts = Q.set_apart(Q.column_records(lines(spark, "a B-x", "", "b", "c I-x", "d O z"), width=2), f"{tmp_path}/a")
    assert [r["line"] for r in good.orderBy("line_no").collect()] == ["a B-x", "c I-x"]
    assert [(r["line_no"], r["reason"]) for r in bad.orderBy("line_no").collect()] == [(3, "1 cells, not 2"), (5, "3 cells, not 2")]
    assert counts == {"rows": 4, "good": 2, "bad": 2}
    good, bad, counts = Q.set_apart(Q.column_records(lines(spark)), f"{tmp_path}/b")
    assert good.count() == bad.count() == counts["rows"] == 0


def test_json_and_answers(spark):
    rows = Q.json_records(lines(spark, '{"id": "a", "n": 1}', '{"id": "b"', '{"n": 2}', "", "[1]"), "id string, n long", ["id"])
    got = {r["line_no"]: (r["reason"], r["record"] and r["record"]["n"]) for r in rows.collect()}
    assert got[1] == (None, 1) and got[2][0] == "unreadable" and got[3] == ("no id", 2) and got[5][0] in ("unreadable", "no id") and 4 not in got
    answers = spark.createDataFrame([(1, '{"labeled_entities": [{"entity": "nap", "final_label": "Sleep"}]}'), (2, 'cut "entity": "nap", "final_label": "Sl'), (3, '.. "entity": "nap", "final_label": "Sleep"'), (4, " "), (5, None)], "doc_id long, raw string")
    assert {r["doc_id"]: r["reason"] for r in Q.answer_records(answers).collect() if r["doc_id"] not in (2,)} == {1: None, 3: None, 4: "no answer", 5: "no answer"}


def test_labels_are_attached_to_documents_that_fit(spark):
    whole = spark.createDataFrame([("d", 1, "B-x\tnap\t0"), ("d", 2, ""), ("d", 3, "O\tat"), ("e", 1, "O\tx"), ("e", 2, ""), ("f", 1, "O\ty")], "doc_id string, line_no int, line string")
    labels, bare = Q.stripped(whole)
    assert [r["label"] for r in labels.orderBy("doc_id", "line_no").collect()] == ["B-x", None, "O", "O", None, "O"]
    again, bad = Q.attached(labels, bare)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect())) and bad.count() == 0
    short = labels.filter("doc_id <> 'e' or line_no <> 1").withColumn("label", F.when(F.expr("doc_id = 'f'"), F.lit(None)).otherwise(F.col("label")))
    again, bad = Q.attached(short, bare, strict=False)
    assert {r["doc_id"] for r in again.collect()} == {"d"}
    assert sorted(map(tuple, bad.collect())) == [("e", 1, 2, 1), ("f", 1, 1, 1)]
    with pytest.raises(Exception, match="document [ef]"):
        Q.attached(short, bare)[0].collect()
