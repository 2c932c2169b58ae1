"""The sketch of op7's passages from count matrices, against whole matrices."""

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import decontamination as D


def test_sketch_in_parts_is_that_of_all_passages(monkeypatch):
    monkeypatch.setattr(D, "SKETCH_PASSAGES", 3)
    rng = np.random.default_rng(2)
    docs = [rng.integers(-3, 40, n).astype(np.int16) for n in (0, 5, 700, 64, 1)] + [np.full(90, -1, np.int16)]
    weights, omega = rng.uniform(0.1, 2, 40), rng.standard_normal((40, 6))
    passages = [t[i : i + 32] for t in docs for i in range(0, len(t), 32)]
    a = np.array([np.bincount(p[p >= 0], minlength=40) * weights for p in passages if (p >= 0).any()])
    a /= np.linalg.norm(np.array([np.bincount(p[p >= 0], minlength=40) for p in passages if (p >= 0).any()]) ** 0.5 * weights, axis=1)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in docs], pa.binary())], names=["terms"])
    parts = list(D._sketch([batch], weights, omega, 2))
    got = np.concatenate([np.frombuffer(x, np.float64).reshape(-1, 6) for part in parts for x in part["part"].to_pylist()])
    assert got == pytest.approx(a.T @ (a @ omega), rel=1e-4, abs=1e-4)
