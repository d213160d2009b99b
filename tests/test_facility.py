"""Facility location over pools whose bounds are loose: the single-precision screen, near copies, exact copies."""

import numpy as np
import pytest

from quotaforge.operators import cluster


def _unit(n, d, seed):
    u = np.random.default_rng(seed).normal(size=(n, d))
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def test_single_precision_stays_within_its_bound():
    points, units, chosen = _unit(1500, 64, 1), _unit(700, 64, 2), _unit(5, 64, 3)
    points[:40] = chosen[4]
    weights = np.random.default_rng(4).integers(1, 50, 1500).astype(float)
    asofs = np.random.default_rng(5).integers(0, 6, 700).astype(np.int32)
    near = points @ np.vstack([chosen, units]).T
    cover = np.maximum.accumulate(near[:, :5], axis=1)
    gain = lambda k: weights @ np.maximum(0, near[:, 5:] - cover[:, k - 1 : k])
    want = np.array([gain(5)[i] - (gain(a)[i] if a else 0) for i, a in enumerate(asofs)])
    exact, _ = cluster._gain_parts(units, asofs, points, weights, chosen, False)
    rough, off = cluster._gain_parts(units, asofs, points, weights, chosen, True)
    assert exact == pytest.approx(want, abs=1e-8)
    assert (np.abs(rough - want) <= off).all() and off.max() < 1e-4 * weights.sum() and np.abs(rough - want).max() > 1e-8


@pytest.mark.parametrize("more", [2048, 0])
def test_near_copies_and_copies_are_chosen_as_by_brute_force(spark, monkeypatch, more):
    monkeypatch.setattr(cluster, "MORE", more)
    monkeypatch.setattr(cluster, "BLOCK", (64, 6))
    monkeypatch.setattr(cluster, "SAMPLE", 100)
    u = _unit(520, 24, 6)
    # the first choices leave near copies with great bounds behind; the last rows are one vector
    u[:120] = u[0] + 0.02 * _unit(120, 24, 7)
    u[480:] = u[480]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"{k:03d}", v.tolist(), float(k == 300)) for k, v in enumerate(u)], "id string, v array<double>, p double").repartition(3)
    steps = cluster.facility_location(rows, rows, "v", "id", "p", 6, 16, 90).orderBy("step").collect()
    near, chosen = u @ u.T, [300]
    want = [near[:, 300].sum()]
    while len(chosen) < 6:
        gain = np.maximum(0, near - near[:, chosen].max(1, keepdims=True)).sum(0)
        gain[chosen] = -1
        chosen.append(int(np.flatnonzero(gain >= gain.max() * (1 - 1e-9))[0]))
        want.append(gain.max())
    assert [int(s["id"]) for s in steps] == chosen and [s["gain"] for s in steps] == pytest.approx(want)
    assert 480 in chosen and min(chosen) < 120
