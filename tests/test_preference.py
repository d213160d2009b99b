"""Preference pairs, matched utilities and posteriors against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotaforge.operators import influence, preference


def test_pairs_take_the_last_attributes(spark):
    lines = spark.createDataFrame([(1, "p", "a", 1.0), (2, "p", "a", 3.0), (3, "p", "b b", 2.0)], "line int, prompt string, response string, help double")
    index = preference.attribute_index(lines, ["prompt", "response"], "line", ["help"])
    raw = spark.createDataFrame([("x", "p", "a", "b b", 2), ("y", "p", "b b", "a", -1), ("z", "q", "", None, 0), ("n", None, "a", "a", None)], "id string, prompt string, response_1 string, response_2 string, preference_strength int")
    got = {r["id"]: r for r in preference.normalised_pairs(raw, index, ["help"]).collect()}
    assert [got[k]["preferred_response"] for k in "xyzn"] == [2, 1, 0, None]
    assert (got["x"]["help_1"], got["x"]["help_2"], got["z"]["help_1"], got["n"]["help_2"]) == (3.0, 2.0, None, None)
    assert got["x"]["length_gap"] == pytest.approx(-1 / 3) and got["z"]["length_gap"] == 0.0 and got["z"]["characters_2"] == 0
    assert {r["id"] for r in preference.short_pairs(raw, 1).collect()} == {"z", "n"}


def _gaps(spark):
    rows = spark.createDataFrame([("a", -1.0, -2.0, -1.0, -1.0, 10, [0.5, 0.5], None), ("b", -2.0, -2.0, -2.0, -2.0, 0, None, 0.9)], "id string, p1 double, p2 double, r1 double, r2 double, t int, c array<double>, p double")
    return preference.log_gaps(rows, ("p1", "p2"), ("r1", "r2"))


def test_log_gaps_and_scores(spark):
    audit = {r["gap"]: r for r in preference.log_gap_audit(_gaps(spark)).collect()}
    assert (audit["policy_gap"]["mean"], audit["policy_gap"]["variance"], audit["policy_gap"]["positive"], audit["policy_gap"]["zero"]) == (0.5, 0.25, 1, 1)
    got = {r["id"]: r for r in preference.pair_scores(_gaps(spark), F.col("t"), "c", "p", 0.5, 2.0, True).collect()}
    p = 1 / (1 + math.exp(-1.0))
    assert got["a"]["reward_margin"] == pytest.approx(1 - abs(2 * p - 1)) and got["b"]["reward_margin"] == 1.0  # the gap, here 0, comes before a given probability
    assert got["a"]["margin_entropy"] == pytest.approx(1 - abs(2 * p - 1) + 0.5 * math.log(2))
    assert got["a"]["update_size"] == pytest.approx(0.1 + 2 * math.log(2)) and got["b"]["update_size"] == 0.0
    assert got["a"]["cheap_gradient"] == pytest.approx((1 - abs(2 * p - 1)) / 2)
    with pytest.raises(Exception, match="not finite"):
        preference.log_gaps(spark.createDataFrame([(1.0, float("nan"), 0.0, 0.0)], "p1 double, p2 double, r1 double, r2 double"), ("p1", "p2"), ("r1", "r2")).collect()


def test_candidates_cover_first(spark):
    rows = spark.createDataFrame([("a", 5.0, "x"), ("b", 4.0, "x"), ("c", 3.0, "x"), ("d", 1.0, "y"), ("e", 0.5, None)], "id string, s double, g string")
    assert {r["id"] for r in preference.covering_candidates(rows, "s", "id", 1, 3, ["g"]).collect()} == {"a", "d", "b"}
    assert {r["id"] for r in preference.covering_candidates(rows, "s", "id", 1, 1, ["g"]).collect()} == {"a"}
    made = rows.withColumn("cheap_gradient", F.col("s")).withColumn("n", F.lit(4))
    norms = spark.createDataFrame([(k, 2.0) for k in "abcde"], "id string, gradient_norm double")
    assert {r["id"]: r["utility"] for r in preference.gradient_scores(made, norms, "id", "n").collect()}["a"] == 5.0


def test_profiles_split_like_rounded_bounds(spark):
    values = [float(v) for v in (9, 1, 7, 3, 5, 2, 8, 4, 6, 0)]
    rows = spark.createDataFrame([(v,) for v in values], "u double")
    got = {r["bin"]: r["mean"] for r in preference.utility_profile(rows, "u", 4).collect()}
    ordered = sorted(values)
    cuts = [round(k * 10 / 4) for k in range(5)]
    assert got == {k: pytest.approx(np.mean(ordered[cuts[k] : cuts[k + 1]])) for k in range(4)}
    row = preference.matched_utility(rows, rows.withColumn("u", F.col("u") + 0.01), "u").first()
    assert row["matched"] and row["mean_delta"] == pytest.approx(0.01)
    with pytest.raises(ValueError):
        preference.utility_profile(rows.limit(0), "u", 1)
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "group string, value double")
    b = spark.createDataFrame([("x", 1.0), ("z", 0.25)], "group string, value double")
    assert preference.coverage_deviation(a, b).first()["deviation"] == pytest.approx(0.625)


def test_posteriors_have_bounds_and_pairs_combine(spark):
    g = np.random.default_rng(9)
    x = g.normal(size=(160, 3))
    y = (x[:, 0] + 0.7 * g.normal(size=160) > 0).astype(int)
    rows = spark.createDataFrame([(k, x[k].tolist(), int(y[k])) for k in range(160)], "id int, f array<double>, y int")
    fit, side, rest = rows.filter("id < 80"), rows.filter("id between 80 and 119"), rows.filter("id >= 120")
    head, l2 = influence.choose_l2(fit, side, "f", "y", [0.01, 100.0])
    assert l2 == 0.01 and influence.mean_loss(head, side, "f", "y") < math.log(2)
    assert influence.choose_l2(fit, side.limit(0), "f", "y", [0.01, 2.0])[1] == 2.0
    heads = influence.bootstrap_heads(fit, side, "id", "f", "y", l2, 4, 1)
    got = influence.posterior(head, heads, rest, "id", "f").collect()
    assert len(got) == 40 and all(lo <= hi and 0 <= lo and hi <= 1 for r in got for lo, hi in zip(r["lower"], r["upper"], strict=True))
    assert np.mean([lo <= p <= hi for r in got for lo, p, hi in zip(r["lower"], r["p"], r["upper"], strict=True)]) > 0.5
    schema = "id string, p array<double>, lower array<double>, upper array<double>"
    d = spark.createDataFrame([("q", [0.25, 0.75], [0.2, 0.7], [0.3, 0.8])], schema)
    t = spark.createDataFrame([("q", [0.2, 0.8], [0.1, 0.7], [0.3, 0.9])], schema)
    r = influence.pair_posterior(d, t).first()
    assert r["p"] == pytest.approx([0.2, 0.2, 0.6]) and r["lower"] == pytest.approx([0.1, 0.14, 0.49]) and r["upper"] == pytest.approx([0.3, 0.27, 0.72])
    assert influence.pair_influence(spark.createDataFrame([("q", 2.0)], "id string, utility double"), t).first()["utility"] == pytest.approx(1.6)
    a, b = influence.pair_features(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(1.0)), F.lit(-0.5))
    assert spark.range(1).select(a.alias("d"), b.alias("t")).first() == ([-2.0, 1.0, -0.5], [2.0, 1.0, 0.5])
