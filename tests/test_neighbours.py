"""The pivot index against brute force: clusters, zero and equal vectors, classes, ties."""

import numpy as np
import pytest

from spanloom.operators import vectors as V
from spanloom.operators.neighbours import PivotIndex, Shards, _distances


def clustered(seed, n, clusters=12, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    rows = centres[rng.integers(0, clusters, n)] + 0.05 * rng.normal(size=(n, width))
    return [(i, str(i % 3), [float(x) for x in row]) for i, row in enumerate(rows.astype(np.float32))]


def brute(queries, refs, k, exclude_self, wanted=None):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1e-10)
    out = {}
    for q, _, v in queries:
        for label in wanted(q) if wanted else [None]:
            found = sorted((round(float(np.clip(1 - unit(v) @ unit(w), 0, 2)), 9), r) for r, own, w in refs if (label is None or own == label) and not (exclude_self and r == q))
            out[q, label] = found[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label string, v array<float>")


@pytest.mark.parametrize("exclude_self", [False, True])
def test_index_against_brute_force(spark, exclude_self):
    rows = clustered(1, 600)
    rows += [(700 + i, "z", [0.0] * 8) for i in range(5)] + [(800 + i, "e", rows[0][2]) for i in range(90)] + [(900, "f", [-x for x in rows[0][2]])]
    asked = rows[::7] + [(701, "z", [0.0] * 8)]
    index = PivotIndex(frame(spark, rows), 4, rows=40)
    got = {}
    for r in index.search(frame(spark, list({x[0]: x for x in asked}.values())), exclude_self).collect():
        got.setdefault((r["query_id"], None), []).append((round(r["distance"], 9), r["ref_id"]))
    want = brute(asked, rows, 4, exclude_self)
    assert {q: [d for d, _ in sorted(x)] for q, x in got.items()} == {q: pytest.approx([d for d, _ in x], abs=1e-7) for q, x in want.items()}
    assert all({i for _, i in got[700 + k, None]} == {i for _, i in want[700 + k, None]} for k in range(5) if (700 + k, None) in want)


def test_index_by_class(spark):
    rows = clustered(2, 400)
    wanted = lambda q: [str(q % 3), str((q + 1) % 3)]
    asked = spark.createDataFrame([(i, v, wanted(i)) for i, _, v in rows[::9]], "id long, v array<float>, wanted array<string>")
    got = {}
    for r in PivotIndex(frame(spark, rows), 3, rows=30).search(asked, True, by_class=True).collect():
        got.setdefault((r["query_id"], r["ref_label"]), []).append(r["ref_id"])
    want = brute(rows[::9], rows, 3, True, wanted)
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(i for _, i in x) for q, x in want.items()}


def test_most_shards_are_skipped_on_clusters(spark):
    rows = clustered(3, 3000, clusters=30, width=16)
    index = PivotIndex(frame(spark, rows), 5, rows=50)
    assert index.search(frame(spark, rows[::10]), True).count() == 300 * 5
    assert index.met < 0.15 * 300 * len(index.shards.cell)


def test_index_of_nothing_and_of_zeros(spark):
    rows = clustered(4, 20)
    assert PivotIndex(frame(spark, []), 3).search(frame(spark, rows)).count() == 0
    assert PivotIndex(frame(spark, rows), 3, rows=5).search(frame(spark, [])).count() == 0
    zeros = [(i, "z", [0.0, 0.0]) for i in range(9)]
    got = PivotIndex(frame(spark, zeros), 2, rows=3).search(frame(spark, zeros), True).collect()
    assert sorted((r["query_id"], r["ref_id"]) for r in got) == sorted((i, j) for i in range(9) for j in ([0, 1, 2][: 2 + (i < 2)]) if i != j)


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    refs, asked, pivots = (unit(rng.normal(size=(n, 6))) for n in (500, 50, 7))
    d = _distances(refs, pivots)
    cell, ring = d.argmin(axis=1), (d.min(axis=1) * 10).astype(int)
    keys = sorted(set(zip(cell.tolist(), ring.tolist())))
    members = [np.flatnonzero((cell == c) & (ring == r)) for c, r in keys]
    shards = Shards(np.array([c for c, _ in keys]), np.array([d[m].min(axis=1).min() for m in members]), np.array([d[m].min(axis=1).max() for m in members]))
    bounds, near = shards.bounds(asked, pivots), _distances(asked, refs)
    for j, m in enumerate(members):
        assert (bounds[:, j] <= near[:, m].min(axis=1) + 1e-9).all()


def test_novelty_from_one_search(spark):
    rows = frame(spark, clustered(6, 80)).cache()
    one = {r["id"]: r for r in V.novelty(rows, rows, k=4, exclude_self=True).collect()}
    knn = {r["id"]: r["knn"] for r in V.knn_distance(rows, rows, 4, True).collect()}
    lof = {r["id"]: r["lof"] for r in V.local_outlier_factor(rows, rows, 4, True).collect()}
    for i in knn:
        assert one[i]["knn"] == pytest.approx(knn[i]) and one[i]["lof"] == pytest.approx(lof[i])
