"""Constrained selections with overlapping and soft groups, against enumeration and duality."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotaforge.operators import soft


def _pool(spark, n, seed):
    g = np.random.default_rng(seed)
    u = g.random(n)
    m = g.dirichlet([0.4, 0.4, 0.4], n)
    m[:, 0] = np.clip(m[:, 0] + 0.3 * u, 0, 1)  # the useful rows lean to one group
    rows = [(f"r{k:04d}", float(u[k]), {"x": float(m[k, 0]), "y": float(m[k, 1]), "z": float(m[k, 2])}) for k in range(n)]
    frame = spark.createDataFrame(rows, "id string, u double, m map<string,double>")
    wide = frame.withColumn("low", F.transform_values("m", lambda _, v: F.greatest(v - 0.1, F.lit(0.0)))).withColumn("high", F.transform_values("m", lambda _, v: F.least(v + 0.1, F.lit(1.0))))
    return wide, u, m


def _breach(ids, low, high, want, tolerance):
    at = [int(i[1:]) for i in ids]
    return max((high[at].mean(0) - want).max(), (want - low[at].mean(0)).max()) - tolerance


@pytest.mark.parametrize("robust", [False, True])
def test_small_pools_are_solved_exactly(spark, robust):
    rows, u, m = _pool(spark, 11, 5)
    low, high = (np.clip(m - 0.1, 0, 1), np.clip(m + 0.1, 0, 1)) if robust else (m, m)
    want = m.mean(0)
    got = soft.select(rows, "u", "id", "low" if robust else "m", "high" if robust else "m", dict(zip("xyz", want.tolist(), strict=True)), 4, 0.15)
    every = [s for s in itertools.combinations(range(11), 4) if _breach([f"r{k:04d}" for k in s], low, high, want, 0.15) <= 1e-9]
    best = max(every, key=lambda s: u[list(s)].sum())
    assert sorted(r["id"] for r in got.ids.collect()) == [f"r{k:04d}" for k in best]


@pytest.mark.parametrize("robust", [False, True])
def test_large_pools_come_near_the_dual_bound(spark, robust):
    rows, u, m = _pool(spark, 600, 6)
    low, high = (np.clip(m - 0.1, 0, 1), np.clip(m + 0.1, 0, 1)) if robust else (m, m)
    want, tolerance = m.mean(0), 0.13 if robust else 0.02
    got = soft.select(rows, "u", "id", "low" if robust else "m", "high" if robust else "m", dict(zip("xyz", want.tolist(), strict=True)), 60, tolerance)
    ids = [r["id"] for r in got.ids.collect()]
    assert len(set(ids)) == len(ids) == 60
    assert got.breach == 0 and _breach(ids, low, high, want, tolerance) <= 1e-8
    assert got.utility == pytest.approx(u[[int(i[1:]) for i in ids]].sum())
    assert got.bound * 0.97 <= got.utility <= got.bound + 1e-6
    assert got.utility <= np.sort(u)[-60:].sum()


def test_impossible_bounds_and_bad_input_are_refused(spark):
    rows, _, m = _pool(spark, 60, 7)
    for bad in ({"x": 0.0, "y": 0.0}, {}):
        with pytest.raises(ValueError):
            soft.select(rows, "u", "id", "m", "m", bad, 10, 0.001)
    with pytest.raises(ValueError):
        soft.select(rows.limit(6), "u", "id", "m", "m", {"x": 5.0}, 3, 0.1)
    with pytest.raises(ValueError):
        soft.select(rows.limit(0), "u", "id", "m", "m", {"x": 0.5}, 3, 0.1)
    odd = spark.createDataFrame([(1, {"a": 0.5}), (2, {"a": 1.5}), (3, {"a": float("nan")}), (4, None), (5, {})], "id int, m map<string,double>")
    assert {r["id"] for r in soft.invalid_memberships(odd, "m").collect()} == {2, 3}
    assert soft.target_moments(odd.filter("id in (1, 5)"), "m").first()["target"] == 0.25


def test_robust_bounds_known_case(spark):
    rows = spark.createDataFrame([("a", 1.0, {"A": 0.0}, {"A": 1.0}), ("b", 0.5, {"A": 0.0}, {"A": 1.0})], "id string, u double, l map<string,double>, h map<string,double>")
    assert [r["id"] for r in soft.select(rows, "u", "id", "l", "h", {"A": 0.5}, 1, 0.5).ids.collect()] == ["a"]
    with pytest.raises(ValueError):
        soft.select(rows.withColumn("l", F.create_map(F.lit("A"), F.lit(0.4))), "u", "id", "l", "h", {"A": 0.5}, 1, 0.0)


def test_frontier_and_error_audit(spark):
    rows, u, m = _pool(spark, 40, 8)
    targets = dict(zip("xyz", m.mean(0).tolist(), strict=True))
    trace = soft.frontier(rows, "u", "id", "m", "m", targets, 10, [0.3, 1e-5, 1.0], 0.05).orderBy("slack").collect()
    assert trace[-1]["retained"] == pytest.approx(1.0) and [r["status"] for r in trace].count("chosen") == 1
    audit = soft.error_audit(rows.withColumn("seen", F.col("m")), "u", "id", "m", "low", "high", "seen", targets, 10, 0.15).collect()
    assert len(audit) == 6 and {r["selection"] for r in audit} == {"nominal", "robust"}
    assert all(r["violation"] <= 0.15 + 1e-6 for r in audit)


def test_matched_random_on_a_larger_pool(spark):
    rows, _, m = _pool(spark, 60, 9)
    ids = [r["id"] for r in soft.matched_random(rows, "id", "m", dict(zip("xyz", m.mean(0).tolist(), strict=True)), 12, 0.05, 3).collect()]
    assert len(set(ids)) == 12 and _breach(ids, m, m, m.mean(0), 0.05) <= 1e-8


def test_soft_pool_is_written_once(spark):
    """Selections scan the pool many times; what they scan must be the written pool, not its making."""
    from quotaforge.plans import registry

    d = "/root/testdata/sf0.001"
    pool = registry.soft_pool(spark, d)
    assert pool.inputFiles() == [] and pool.count() == spark.read.parquet(f"{d}/embeddings.parquet").count()
