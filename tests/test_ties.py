"""Selections at scores that all tie, unnormalised probabilities, terciles."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quotaforge.functions import expr
from quotaforge.operators import choose, selectors


def first(rows, budget):
    return sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], str(r[0])))[:budget]


@pytest.mark.parametrize("law", ["one", "two", "heavy_top", "heavy_low", "spread"])
def test_top_budget_is_exact_however_scores_tie(spark, monkeypatch, law):
    monkeypatch.setattr(choose, "SORTED", 60)
    score = {"one": lambda k: 1.0, "two": lambda k: float(k % 2), "heavy_top": lambda k: float(min(k, 40)), "heavy_low": lambda k: float(max(k, 2960)), "spread": lambda k: float(k * 7919 % 3001)}[law]
    rows = [(k, None if k % 97 == 5 else score(k)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "id long, s double").cache()
    for budget in (1, 45, 1700, 5000):
        want = {r[0] for r in first(rows, budget)}
        before, band, left = choose.narrowed(frame, "s", "id", budget)
        assert frame.filter(band).count() <= 60  # what one task sorts
        assert {r["id"] for r in choose.top_budget(frame, "s", "id", budget).collect()} == want
        assert {r["id"] for r in choose.marked_top(frame, "s", "id", budget).filter("selected").collect()} == want


def test_top_budget_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(choose, "SORTED", 10)
    rows = spark.range(200).select(F.lit("same").alias("id"), F.lit(1.0).alias("s"), F.col("id").alias("k"))
    assert choose.top_budget(rows, "s", "id", 50).count() == 50


def test_constrained_and_coverage_against_loops(spark, monkeypatch):
    monkeypatch.setattr(choose, "SORTED", 20)
    data = [(k, float(k * 31 % 17), "abc"[0 if k < 400 else k % 3]) for k in range(600)]
    rows = spark.createDataFrame(data, "id long, u double, g string")
    for budget, slack in ((90, 0.05), (300, 0.0), (200, 0.3)):
        sizes = {g: sum(r[2] == g for r in data) for g in "abc"}
        low = {g: max(0, int(np.ceil((n / 600 - slack) * budget - 1e-9))) for g, n in sizes.items()}
        high = {g: min(n, int(np.floor((n / 600 + slack) * budget + 1e-9))) for g, n in sizes.items()}
        if not sum(low.values()) <= budget <= sum(high.values()):
            with pytest.raises(choose.Infeasible):
                choose.constrained(rows, "u", "id", "g", budget, slack)
            continue
        order = {g: first([r for r in data if r[2] == g], high[g]) for g in "abc"}
        must = [r for g in "abc" for r in order[g][: low[g]]]
        want = must + first([r for g in "abc" for r in order[g][low[g] :]], budget - len(must))
        assert {r["id"] for r in choose.constrained(rows, "u", "id", "g", budget, slack).collect()} == {r[0] for r in want}
    best = [first([r for r in data if r[2] == g], 1)[0] for g in "abc"]
    rest = first([r for r in data if r not in best], 47)
    assert {r["id"] for r in choose.coverage_first(rows, "u", "id", "g", 50).collect()} == {r[0] for r in best + rest}
    assert {r["id"] for r in choose.coverage_first(rows, "u", "id", "g", 2).collect()} == {r[0] for r in first(best, 2)}


def test_counts_as_probabilities_are_normalised(spark):
    pool = spark.createDataFrame([("a", [5.0, 5.0]), ("b", [0.9, 0.1]), ("c", [50.0, 1.0]), ("d", [0.5, 0.5])], "id string, p array<double>")
    for method in ("entropy", "margin"):
        assert {r["id"] for r in selectors.select(pool, method, 2).collect()} == {"a", "d"}
    assert spark.range(1).select(expr.checked_probabilities(F.lit(None).cast("array<double>"))).first()[0] is None
    for bad in ([1.0], [0.0, 0.0], [-0.1, 1.1], [None, 1.0], [float("nan"), 1.0]):
        with pytest.raises(PySparkException, match="probabilities must"):
            selectors.select(spark.createDataFrame([("a", bad), ("b", [0.5, 0.5])], "id string, p array<double>"), "entropy", 1).collect()


def test_exact_terciles(spark):
    lengths = [3, 3, 3, 4, 9, 10, 11, 30, None]
    low, high = np.quantile([x for x in lengths if x is not None], [1 / 3, 2 / 3])
    found = selectors.length_memberships(spark.createDataFrame([(x,) for x in lengths], "n int"), "n").collect()
    assert [r["length_group"] for r in found] == [None if x is None else "length_bin=" + ("short" if x <= low else "medium" if x <= high else "long") for x in lengths]
