"""Repeated random selections and the effects of random selections on pair domains."""

import math
from collections import Counter

import numpy as np
import pytest

from quotaforge.operators import baselines, preference


@pytest.fixture(scope="module")
def pairs(spark):
    r = np.random.default_rng(5)
    rows = [
        (f"i{k:03d}", int(r.integers(1, 90)), None if k % 17 == 0 else float(r.normal()), [None, 1, 2][int(r.integers(0, 3))], " ".join(r.choice(list("abcdefgh"), int(r.integers(0, 6)))))
        for k in range(300)
    ]
    return spark.createDataFrame(rows, "id string, words int, score double, preferred_response int, prompt string").repartition(4).cache()


def test_selections_are_exact_nested_and_fair(spark, pairs):
    few, many = ({(r["repetition"], r["id"]) for r in baselines.repeated_selections(pairs, "id", b, 80, 7).collect()} for b in (20, 150))
    assert few < many and len(few) == 80 * 20 and len(many) == 80 * 150
    assert set(Counter(r for r, _ in few).values()) == {20}
    found = Counter(i for _, i in many)
    assert abs(sum((found[f"i{k:03d}"] - 40) ** 2 / 20 for k in range(300)) / 300 - 1) < 0.4
    assert baselines.repeated_selections(pairs.coalesce(1), "id", 300, 2, 7).count() == 600


def test_a_narrow_band_is_widened(spark, pairs, monkeypatch):
    want = baselines.thresholds(pairs, "id", 40, 30, 2)
    monkeypatch.setattr(baselines, "REACH", 0.01)
    assert baselines.thresholds(pairs, "id", 40, 30, 2) == want
    for budget, repetitions in ((0, 1), (301, 1), (5, 0)):
        with pytest.raises(ValueError, match="cannot give"):
            baselines.thresholds(pairs, "id", budget, repetitions, 2)


def test_effects_are_those_of_the_report(spark, pairs):
    numbers = {"words": "length", "score": "attributes"}
    effects = baselines.random_effects(pairs, "id", numbers, "prompt", 60, 12, 3).cache()
    got = {(r["repetition"], r["domain"]): r["effect"] for r in effects.collect()}
    assert len(got) == 48
    drawn = baselines.repeated_selections(pairs.select("id"), "id", 60, 12, 3)
    for k in (0, 11):
        ids = [r["id"] for r in drawn.filter(f"repetition = {k}").collect()]
        report = preference.preference_shift(pairs.withColumn("selected", pairs["id"].isin(ids)), numbers, "prompt")
        for r in preference.preference_effects(report).collect():
            assert got[k, r["domain"]] == pytest.approx(r["effect"], abs=1e-9), r
    base = {r["domain"]: r for r in baselines.random_baseline(effects, 0.9).collect()}
    for d in base:
        own = [v for (_, name), v in got.items() if name == d]
        assert base[d]["mean_effect"] == pytest.approx(np.mean(own)) and base[d]["quantile_effect"] == pytest.approx(np.quantile(own, 0.9)) and base[d]["repetitions"] == 12
    mine = spark.createDataFrame([("m", "length", 0.5), ("m", "other", 0.1)], "method string, domain string, effect double")
    over = {r["domain"]: r["excess"] for r in baselines.over_baseline(mine, baselines.random_baseline(effects, 0.9)).collect()}
    assert over["length"] == pytest.approx(0.5 - base["length"]["quantile_effect"]) and over["other"] is None


def test_prompts_without_words(spark):
    rows = spark.createDataFrame([(k, 1, None, "") for k in range(9)], "id int, words int, preferred_response int, prompt string")
    got = {r["domain"]: r["effect"] for r in baselines.random_effects(rows, "id", {"words": "length"}, "prompt", 3, 1, 1).collect()}
    assert got == {"length": 0.0, "preference_direction": 0.0, "prompt_distribution": 0.0}
    assert math.isclose(sum(got.values()), 0)
