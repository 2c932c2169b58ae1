"""The run store, token placing and near duplicates inside a batch, by hand and against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from spanloom.operators import rules as R
from spanloom.operators import text as T
from spanloom.operators.neighbours import first_independent
from spanloom.plans import file_queries as FQ
from spanloom.sources import annotations as A
from spanloom.sources import sinks as K
from spanloom.sources.runs import RunStore


def test_runs_stay_and_repeats_change_nothing(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "run_id int, f1 double")
    for _ in range(2):
        K.write_runs(rows((1, 0.5)), f"{tmp_path}/runs")
        K.write_runs(rows((2, 0.7)), f"{tmp_path}/runs")
        K.audit_rows(rows((1, 0.5)), f"{tmp_path}/audit")
        K.audit_rows(rows((2, 0.7)), f"{tmp_path}/audit")
        K.snapshot(rows((1, 0.5)), f"{tmp_path}/snap", "a")
    assert spark.read.json(f"{tmp_path}/runs").count() == 2
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 2
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 1


def test_store_shows_whole_versions_only(spark, tmp_path):
    store = RunStore(spark, f"{tmp_path}/store")
    rows = lambda *x: spark.createDataFrame(x, "run_id string, n int")
    now = lambda: sorted(tuple(r) for r in store.read().select("run_id", "n").collect())
    assert store.read().count() == 0 and store.version() == ""
    store.write(rows(("a", 1), ("b", 2)))
    store.write(rows(("b", 3), ("b", 4)))
    assert now() == [("a", 1), ("b", 3), ("b", 4)]
    rows(("a", 9)).write.partitionBy("run_id").parquet(f"{tmp_path}/store/batches/left-by-a-failed-job")
    assert now() == [("a", 1), ("b", 3), ("b", 4)]
    before = {r["run_id"]: (r["n"], r["seq"]) for r in store.manifest().collect()}
    assert before == {"a": (1, 1), "b": (2, 2)}
    store.compact()
    assert store.clean() >= 3 and now() == [("a", 1), ("b", 3), ("b", 4)]
    stale = RunStore(spark, f"{tmp_path}/store")
    stale.version = lambda: next(seen)
    seen = iter(["old", "", "new"])
    with pytest.raises(RuntimeError):
        stale._point("x", "old-one")


def plain_placed(text, tokens):
    seen = [(c, i) for i, c in enumerate(text) if c not in " \t\n\x0b\f\r"]
    out, at, good = [], 0, True
    for token in tokens:
        core = [c for c in token if c not in " \t\n\x0b\f\r"]
        part = seen[at : at + len(core)]
        good = good and [c for c, _ in part] == core
        out.append((part[0][1], part[-1][1] + 1) if good and core else None)
        at += len(core)
    return out


def test_any_tokenisation_is_placed(spark):
    rng = random.Random(2)
    texts, tagged, want = [], [], {}
    for d in range(40):
        text = "".join(rng.choices("abé日😀 \n\t", k=rng.randrange(60)))
        visible = "".join(text.split())
        tokens = []
        while visible:
            k = rng.randrange(1, 6)
            tokens.append((" " if rng.random() < 0.2 else "") + " ".join(visible[:k]) if rng.random() < 0.3 else visible[:k])
            visible = visible[k:]
        if d % 5 == 0 and len(tokens) > 2:
            tokens[len(tokens) // 2] = "?" + tokens[len(tokens) // 2][1:]
        if d % 7 == 0:
            tokens += [" ", "more"]
        texts.append((d, text))
        tagged += [(d, i, t, "O") for i, t in enumerate(tokens)]
        for i, span in enumerate(plain_placed(text, tokens)):
            want[d, i] = span
    docs = spark.createDataFrame([*texts, (99, None)], "doc_id long, text string")
    places = T.placed(spark.createDataFrame([*tagged, (99, 0, "x", "O"), (98, 0, "x", "O")], "doc_id long, pos int, token string, tag string"), docs).cache()
    got = {(r["doc_id"], r["pos"]): (r["start"], r["end"]) if r["aligned"] and r["start"] is not None else None for r in places.collect()}
    assert got == want | {(99, 0): None, (98, 0): None}
    first = {r["doc_id"]: r["pos"] for r in T.mismatches(places).collect()}
    visible = {(d, i): bool(t.split()) for d, i, t, _ in tagged}
    expect = {}
    for (d, i), span in sorted(want.items()):
        if span is None and visible[d, i]:
            expect.setdefault(d, i)
    assert {d: first[d] for d in expect} == expect


def greedy(rows, distance):
    kept, twin = [], {}
    for i, label, v in sorted(rows):
        near = [j for j, other, w in kept if other == label and np.clip(1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 0, 2) <= distance]
        twin[i] = min(near) if near else None
        if not near:
            kept.append((i, label, v))
    return twin


@pytest.mark.parametrize("at_once", [10_000, 25])
def test_first_independent_set(spark, at_once):
    rng = np.random.default_rng(3)
    angles = np.concatenate([np.arange(12) * 0.11, rng.uniform(0, 6.28, 40), [0.5] * 10])
    rows = [(int(i), "ab"[i % 2], [float(np.cos(t)), float(np.sin(t)), 0.3]) for i, t in enumerate(rng.permutation(angles))]
    got = {r["id"]: r["twin"] for r in first_independent(spark.createDataFrame(rows, "id long, label string, v array<double>"), 0.004, at_once).collect()}
    assert got == greedy(rows, 0.004)


def test_siblings_of_a_batch(spark):
    schema = "seq long, section string, v array<double>, diagnostic_context string"
    added = spark.createDataFrame([(1, "Sleep", [1.0, 0.0], "c1"), (2, "Sleep", [0.99, 0.14], "c2"), (3, "Nutrition", [1.0, 0.0], "c3"), (4, "Sleep", None, "c4"), (5, "Sleep", [0.0, 1.0], "c5")], schema)
    rules = spark.createDataFrame([(7, "Sleep", [0.0, 1.0])], "rule_no long, section string, v array<double>")
    accepted, rejected = R.near_duplicates(added, rules)
    assert sorted((r["seq"], r["diagnostic_context"]) for r in accepted.collect()) == [(1, "c1"), (3, "c3"), (4, "c4")]
    assert sorted((r["seq"], r["rule_no"], r["twin"], r["diagnostic_context"]) for r in rejected.collect()) == [(2, None, 1, "c2"), (5, 7, None, "c5")]


def test_vectors_share_stores(spark, tmp_path, monkeypatch):
    rows = [("d", str(i % 400), '{"ground_truth": [{"text": "x", "label": "1", "embedding": [%d.0]}]}' % i) for i in range(500)]
    rows += [("l", None, '{"text": "y", "label": "2", "embedding": [%d.0]}' % i) for i in range(300)] + [("a", None, f"[{i}.0]") for i in range(200)] + [("a", None, None)]
    stores = K.json_stores(spark.createDataFrame(rows, "layout string, key string, item string").coalesce(1))
    FQ._one_a_file(stores, str(tmp_path / "stores"))
    assert len(list((tmp_path / "stores").glob("part-*"))) == 4  # keys 0 to 99 come twice
    found = A.vector_records(spark, str(tmp_path / "stores")).collect()
    assert sorted((r["source"], r["abstract_id"], r["embedding"][0]) for r in found if r["abstract_id"]) == sorted(("ground_truth", str(i % 400), float(i)) for i in range(500))
    assert sorted((r["source"], r["embedding"][0]) for r in found if not r["abstract_id"]) == sorted([*(("list", float(i)) for i in range(300)), *(("array", float(i)) for i in range(200))])
    files, read = [], A.vector_records
    monkeypatch.setattr(A, "vector_records", lambda s, path, *more: files.append(len(list(Path(path.removeprefix("file://")).glob("part-*")))) or read(s, path, *more))
    assert FQ.s_vector_stores(spark, "/root/testdata/sf0.001").count() == 4
    assert files[0] <= 3  # a file for each of 500 vectors before
