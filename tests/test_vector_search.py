"""Searches visit a bounded number of shards, also where small ones are asked for; one search serves both novelty scores."""

import random

from spanloom.operators import sweep as X
from spanloom.operators import vectors as V
from spanloom.operators.neighbours import SHARDS, PivotIndex, meet


def _frame(spark, n=600, width=6):
    random.seed(7)
    return spark.createDataFrame([(i, str(i % 3), [random.gauss(0, 1) for _ in range(width)]) for i in range(n)], "id long, label string, v array<double>")


def test_shards_grow_with_the_references(spark):
    rows = _frame(spark)
    index = PivotIndex(rows, 3, rows=4)
    assert len(index.shards.cell) <= 2 * SHARDS
    got = sorted(tuple(r)[:3] for r in index.search(rows, True).select("query_id", "rank", "ref_id").collect())
    assert got == sorted(tuple(r) for r in V.nearest(rows, rows, 3, True).select("query_id", "rank", "ref_id").collect())


def test_one_search_for_both_scores(spark):
    rows = _frame(spark, 60)
    both = {r["id"]: (round(r["knn"], 9), round(r["lof"], 9)) for r in V.knn_and_outlier_factor(rows, 5, True).collect()}
    knn = {r["id"]: round(r["knn"], 9) for r in V.knn_distance(rows, rows, 5, True).collect()}
    lof = {r["id"]: round(r["lof"], 9) for r in V.local_outlier_factor(rows, rows, 5, True).collect()}
    assert both == {i: (knn[i], lof[i]) for i in knn}


def test_queries_are_sent_to_groups_of_shards(spark):
    """Without structure every query visits every shard, but it is sent to a group of them at most once a round."""
    rows = _frame(spark, 800, 40)
    index = PivotIndex(rows, 3, rows=20)
    assert index.search(rows, True).count() == 3 * 800
    assert len(index.shards.cell) > 30 and index.met > 25 * 800
    assert getattr(index, "sent", index.met) <= 9 * 800  # before, each visit was a row


def test_metrics_read_the_candidates_once(spark):
    """Runs in which all is O have no row; the cost of a run counts every candidate once."""
    rows = [("s", "a", "O", "C1", True), ("s", "a", "C1", "C1", False), ("s", "a", "O", "O", True), ("s", "b", "O", "O", True), ("s", "a", None, "C2", False)]
    runs = X.run_metrics(spark.createDataFrame(rows, "sweep string, run_id string, gold string, final string, escalated boolean"))
    found = {r["run_id"]: r.asDict() for r in runs.collect()}
    assert set(found) == {"a"}
    assert [found["a"][x] for x in ("n", "escalated", "tp", "fp", "fn", "saved")] == [4, 2, 1, 1, 0, 0.5]
    assert abs(found["a"]["macro_f1"] - 1 / 3) < 2e-6
    assert runs._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_ties_zeros_and_missing_numbers(spark):
    """Equal vectors of two labels tie and go by id; a vector with NaN is near to none; zero vectors are at distance 1."""
    rows = _frame(spark, 300).collect()
    same = [(1000 + i, str(i % 2), list(rows[0]["v"])) for i in range(6)]
    table = spark.createDataFrame([tuple(x) for x in rows] + same + [(2000, "n", [float("nan")] * 6), (2001, "n", [0.0] * 6)], "id long, label string, v array<double>")
    got = {}
    for r in PivotIndex(table, 5, rows=8).search(table, True).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["ref_id"], round(r["distance"], 9)))
    assert got[1003] == [(i, 0.0) for i in (0, 1000, 1001, 1002, 1004)]
    assert 2000 not in got and all(2000 != i for x in got.values() for i, _ in x)
    assert [d for _, d in got[2001]] == [1.0] * 5


def test_what_is_shuffled_does_not_grow_with_groups(spark):
    """References and queries are packed once; a block meets a pack where both lie, so no group is sent to each block of queries."""
    rows = _frame(spark, 1200, 40)
    index = PivotIndex(rows, 3, rows=20)
    found = index.search(rows, True)
    assert len(set(index.group.tolist())) > 4 and found.count() == 3 * 1200
    assert index.sent <= 2 * 1200  # before, a query was sent to each group that it visits
    met = index._visit(rows.selectExpr("id", "v", "cast(null as array<string>) wanted", "2.0D kth"), 1200, False, lambda visits: meet(3, True, visits))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Broadcast" not in plan


def test_a_query_has_k_rows_whatever_it_visits(spark):
    """A block goes through all packs in one task and keeps the k best; before, each group gave up to k rows for each query."""
    rows = _frame(spark, 800, 40)
    index = PivotIndex(rows, 3, rows=20)
    asked = rows.selectExpr("id", "v", "cast(null as array<string>) wanted", "2.0D kth")
    found = index._visit(asked, 800, False, lambda visits: meet(3, True, visits), 3)
    assert found.count() == 3 * 800
    by_class = rows.selectExpr("id", "v", "array('0', '1') wanted", "2.0D kth")
    assert index._visit(by_class, 800, False, lambda visits: meet(3, True, visits), 3, True).count() == 6 * 800
