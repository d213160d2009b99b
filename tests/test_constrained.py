"""Scaled features, and the constrained methods against all subsets of a small pool."""

import itertools
import math

import numpy as np
import pytest

from quotaforge.operators import influence, selectors, soft


@pytest.mark.parametrize("centre", [True, False])
def test_feature_scale_matches_numpy(spark, centre):
    x = np.random.default_rng(1).normal(5, [1, 20, 0.0, 1e-3, 3], size=(200, 5))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(200, None)], "id int, v array<double>").repartition(4)
    mean, scale = influence.feature_scale(rows, "v", centre)
    off = x - x.mean(0) if centre else x
    rms = np.sqrt((off**2).mean(0))
    want = np.maximum(rms, max(1e-6, np.median(rms[rms > 1e-8]) * 0.1))
    assert scale == pytest.approx(want) and mean == pytest.approx(x.mean(0) if centre else np.zeros(5))
    got = {r["id"]: r["v"] for r in influence.scaled(rows, "v", mean, scale).collect()}
    assert got[200] is None and np.allclose([got[k] for k in range(200)], off / want)


def test_feature_scale_without_spread_or_rows(spark):
    rows = spark.createDataFrame([(1, [2.0, 3.0])], "id int, v array<double>")
    mean, scale = influence.feature_scale(rows, "v")
    assert mean.tolist() == [2.0, 3.0] and scale.tolist() == [1.0, 1.0]
    assert influence.feature_scale(rows.limit(0), "v")[0].size == 0


def small(spark, embedded):
    r = np.random.default_rng(4)
    p = r.dirichlet([1, 1, 1], 14)
    rows = [(f"i{k:02d}", (3 * q).tolist(), r.normal(size=3).tolist()) for k, q in enumerate(p)]
    pool = spark.createDataFrame(rows, "id string, p array<double>, embedding array<double>").coalesce(2)
    return p, pool if embedded else pool.drop("embedding")


def best(utility, member, want, budget, slacks, loss):
    """The best subset of the least slack that keeps enough, by trying all."""
    order = sorted(range(len(utility)), key=lambda k: (utility[k], k))
    rank = {k: n / (len(utility) - 1) for n, k in enumerate(order)}
    top = sum(sorted(rank.values())[-budget:])
    for slack in slacks:
        fits = [c for c in itertools.combinations(range(len(utility)), budget) if np.abs(member[list(c)].mean(0) - want).max() <= slack + 1e-9]
        if fits:
            total = max(sum(rank[k] for k in c) for c in fits)
            if total >= (1 - loss) * top:
                return total, slack, [set(c) for c in fits if abs(sum(rank[k] for k in c) - total) < 1e-9]
    return None


@pytest.mark.parametrize("targets", ["pool", "uniform", {"class=0": 0.5, "class=1": 0.3, "class=2": 0.2}])
def test_constrained_against_all_subsets(spark, targets):
    p, pool = small(spark, False)
    want = p.mean(0) if targets == "pool" else np.full(3, 1 / 3) if targets == "uniform" else np.array(list(targets.values()))
    for base, utility in (("entropy", -(p * np.log(p)).sum(1)), ("margin", 1 - (np.sort(p)[:, -1] - np.sort(p)[:, -2]))):
        total, slack, fits = best(utility, p, want, 5, selectors.SLACKS, 0.1)
        got, took = selectors.constrained(pool, base, 5, targets=targets, loss=0.1)
        assert took == slack and got.utility == pytest.approx(total) and {int(r["id"][1:]) for r in got.ids.collect()} in fits


def test_constrained_with_clusters_and_gradients(spark):
    p, pool = small(spark, True)
    chosen = selectors.select(pool, "Badge constrained", 4)
    assert chosen.columns == pool.columns and chosen.count() == 4
    got, slack = selectors.constrained(pool, "entropy_gradient", 4, candidates=2, slacks=(0.5, 1.0), loss=0.4)
    e = {r["id"]: np.linalg.norm(r["embedding"]) for r in pool.collect()}
    value = {f"i{k:02d}": -(q * np.log(q)).sum() * math.sqrt(1 - (q * q).sum()) * e[f"i{k:02d}"] for k, q in enumerate(p)}
    assert {r["id"] for r in got.ids.collect()} <= set(sorted(value, key=value.get)[-8:]) and slack in (0.5, 1.0)


def test_constrained_refusals(spark):
    _, pool = small(spark, False)
    for bad, match in ((dict(base="random"), "no utility"), (dict(budget=99), "cannot give"), (dict(targets="other"), "no targets"), (dict(targets={"class=0": 1.0}), "every class"), (dict(slacks=()), "slacks")):
        with pytest.raises(ValueError, match=match):
            selectors.constrained(pool, **({"base": "entropy", "budget": 3} | bad))
    with pytest.raises(soft.Infeasible, match="no slack"):
        selectors.constrained(pool, "entropy", 3, targets={"class=0": 1.0, "class=1": 0.0, "class=2": 0.0}, slacks=(0.0,))
    part = pool.selectExpr("id", "p", "case when id < 'i05' then p end posterior")
    with pytest.raises(ValueError, match="for every row"):
        selectors.constrained(part, "entropy", 3)
