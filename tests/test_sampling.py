"""Laws of the random selections: uniform within bounds, and systematic draws."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from quotaforge.operators import sampling, soft
from quotaforge.operators.choose import Infeasible


def chi(found, law, draws):
    """Chi-square of counts against a law, and a bound of about 1e-5."""
    value = sum((found.get(k, 0) - draws * p) ** 2 / (draws * p) for k, p in law.items())
    free = len(law) - 1
    return value, free + 4.3 * math.sqrt(2 * free) + 13


@pytest.mark.parametrize("bounds", [([0, 0, 0], [9, 9, 9]), ([1, 2, 0], [3, 3, 2]), ([2, 0, 1], [2, 4, 3])])
def test_counts_follow_the_enumerated_law(bounds):
    sizes, budget, (low, high) = [5, 4, 3], 6, bounds
    ways = {k: math.prod(map(math.comb, sizes, k)) for k in itertools.product(*[range(a, min(b, n) + 1) for a, b, n in zip(low, high, sizes)]) if sum(k) == budget}
    law = {k: w / sum(ways.values()) for k, w in ways.items()}
    found = Counter(tuple(sampling.draw_counts(sizes, low, high, budget, s)) for s in range(4000))
    assert set(found) <= set(law)
    value, bound = chi(found, law, 4000)
    assert value < bound


def test_counts_of_large_groups():
    sizes = [10**9, 3 * 10**8, 5000, 7]
    drawn = np.array([sampling.draw_counts(sizes, [0] * 4, sizes, 100_000, s) for s in range(60)])
    assert (drawn.sum(1) == 100_000).all()
    share = np.array(sizes) / sum(sizes)
    assert abs(drawn.mean(0) - 100_000 * share).max() < 6 * math.sqrt(100_000 * 0.25 / 60)
    held = sampling.draw_counts(sizes, [0, 60_000, 0, 7], [10**9, 10**9, 10, 7], 100_000, 1)
    assert held[1] >= 60_000 and held[2] <= 10 and held[3] == 7 and sum(held) == 100_000
    many = sampling.draw_counts([50] * 3000, [1] * 3000, [5] * 3000, 9000, 4)
    assert sum(many) == 9000 and min(many) >= 1 and max(many) <= 5


def test_counts_at_their_bounds_and_infeasible_ones():
    assert sampling.draw_counts([5, 5], [2, 3], [5, 5], 5, 1) == [2, 3]
    assert sampling.draw_counts([5, 5], [0, 0], [2, 3], 5, 1) == [2, 3]
    for low, high, budget in (([4, 4], [5, 5], 5), ([0, 0], [2, 2], 5), ([6, 0], [9, 9], 8)):
        with pytest.raises(Infeasible):
            sampling.draw_counts([5, 5], low, high, budget, 1)


def test_the_walk_is_near_uniform_over_overlapping_groups():
    member = np.array([[1, 0], [0, 1], [1, 1], [0, 0]], float)
    sizes, budget = np.array([4, 3, 2, 3]), 5
    low, high = np.array([2.0, 1.0]), np.array([3.0, 3.0])
    ways = {}
    for k in itertools.product(*[range(n + 1) for n in sizes]):
        s = np.array(k) @ member
        if sum(k) == budget and (s >= low).all() and (s <= high).all():
            ways[k] = math.prod(math.comb(int(n), x) for n, x in zip(sizes, k))
    law = {k: w / sum(ways.values()) for k, w in ways.items()}
    start = np.array(min(ways))
    found = Counter(tuple(map(int, sampling.walk_counts(sizes, member, low, high, start, s, 120))) for s in range(3000))
    assert set(found) <= set(law)
    value, bound = chi(found, law, 3000)
    assert value < bound


def test_matched_random_is_uniform_over_subsets_of_12_rows(spark):
    """The path of large pools: three disjoint groups, one row in none; each fitting subset is equally likely."""
    group = ["a"] * 5 + ["b"] * 4 + ["c"] * 2 + [None]
    rows = spark.createDataFrame([(k, {g: 1.0} if g else {}) for k, g in enumerate(group)], "id long, m map<string,double>").coalesce(1)
    targets = {"a": 0.4, "b": 0.4, "c": 0.2}
    for seed in range(3):
        ids = [int(r["id"]) for r in soft.matched_random(rows, "id", "m", targets, 5, 0.2, seed).collect()]
        assert len(ids) == len(set(ids)) == 5
        had = Counter(group[i] for i in ids)
        assert 1 <= had["a"] <= 3 and 1 <= had["b"] <= 3 and had["c"] <= 2
    sizes = [5, 4, 2, 1]
    ok = lambda k: 1 <= k[0] <= 3 and 1 <= k[1] <= 3 and k[2] <= 2 and sum(k) == 5
    ways = {k: math.prod(map(math.comb, sizes, k)) for k in itertools.product(*[range(n + 1) for n in sizes]) if ok(k)}
    law = {k: w / sum(ways.values()) for k, w in ways.items()}
    own = [sampling.limits(t, 0.2, 5) for t in (0.4, 0.4, 0.2)] + [(0, 5)]
    found = Counter(tuple(sampling.draw_counts(sizes, [a for a, _ in own], [b for _, b in own], 5, s)) for s in range(4000))
    value, bound = chi(found, law, 4000)
    assert set(found) <= set(law) and value < bound


def test_matched_random_of_many_groups_and_of_overlapping_ones(spark):
    rows = spark.range(3000).selectExpr("id", "map(concat('g', id % 200), 1D) m")
    want = {f"g{k}": 1 / 200 for k in range(200)}
    ids = [int(r["id"]) for r in soft.matched_random(rows, "id", "m", want, 400, 0.0, 3).collect()]
    assert Counter(i % 200 for i in ids) == {k: 2 for k in range(200)}
    with pytest.raises(Infeasible):
        soft.matched_random(rows, "id", "m", {"g0": 1.0}, 400, 0.0, 3)
    both = spark.range(600).selectExpr("id", "map_filter(map('x', double(id % 2), 'y', double(id % 3 = 0)), (k, v) -> v > 0) m")
    one, two = ({int(r["id"]) for r in soft.matched_random(both, "id", "m", {"x": 0.5, "y": 0.5}, 60, 0.05, s).collect()} for s in (1, 2))
    for ids in (one, two):
        assert len(ids) == 60 and abs(sum(i % 2 for i in ids) - 30) <= 3 and abs(sum(i % 3 == 0 for i in ids) - 30) <= 3
    assert one != two


def test_systematic_inclusions_follow_the_probabilities(spark):
    weights = [9.0, 5.0, 0.5, 1.0, 1.0, 0.25, 0.75, 1.5, None, 0.0, float("nan"), -1.0]
    rows = spark.createDataFrame(list(enumerate(weights)), "id long, w double").repartition(3).cache()
    found, draws = Counter(), 12
    for seed in range(draws):
        got = [r["id"] for r in sampling.systematic(rows, "w", "id", 4, seed).collect()]
        assert len(got) == len(set(got)) == 4 and {0, 1} <= set(got)
        found.update(got)
    assert not {8, 9, 10, 11} & set(found)
    for k in range(2, 8):
        p = 2 * weights[k] / 5.0
        assert abs(found[k] / draws - p) < 4.5 * math.sqrt(p * (1 - p) / draws)


def test_systematic_matches_a_loop_and_keeps_columns(spark):
    n, budget = 1000, 130
    w = {f"{k:04d}": 1 + k * 7919 % 97 for k in range(n)}
    rows = spark.createDataFrame([(k, float(v), "x") for k, v in w.items()], "id string, w double, _p string").repartition(7)
    total, at, marks, want = sum(w.values()), 0, 0.5, set()
    for k in sorted(w):
        at += w[k]
        while marks < at * budget / total:
            want.add(k)
            marks += 1
    got = sampling.systematic(rows, "w", "id", budget)
    assert got.columns == rows.columns and {r["id"] for r in got.collect()} == want and len(want) == budget
    assert sampling.systematic(rows, "w", "id", n).count() == n
    with pytest.raises(ValueError, match="cannot give"):
        sampling.systematic(rows, "w", "id", n + 1)
