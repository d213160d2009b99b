"""Guards, the selector entry, exact random trajectories, intervals and pair shifts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotaforge.functions import expr
from quotaforge.operators import audit, choose, evaluate, preference, selectors, soft, tables


def test_no_hidden_name_passes_the_guard(spark):
    for name in tables.HIDDEN_FIELDS:
        rows = spark.createDataFrame([(1, "x", ("y", 2), [("z",)], {"a": "b", name: "secret"})], f"id int, {name.upper()} string, s struct<{name}:string,k:int>, l array<struct<{name}:string>>, m map<string,string>")
        assert len(tables.hidden_columns(rows)) == 3 and tables.hidden_keys(rows) == ["m"]
        view = tables.safe_view(rows)
        assert view.columns == ["id", "s", "l", "m"]
        row = view.first()
        assert row["s"].asDict() == {"k": 2} and row["m"] == {"a": "b"} and "secret" not in str(row)
        assert tables.hidden_columns(view) == [] and tables.hidden_keys(view) == []
        with pytest.raises(ValueError, match="must not see m"):
            tables.assert_safe(rows.select("id", "m"))
    assert {"chosen", "rejected", "justification", "is_correct", "test_metric", "label", "groundtruth"} <= set(tables.HIDDEN_FIELDS)
    clean = spark.createDataFrame([(1, {"a": 1}), (2, None)], "id int, m map<string,int>")
    assert tables.assert_safe(clean) is clean and tables.safe_view(clean).collect() == clean.collect()


def test_marked_top_is_the_top_budget(spark):
    rows = spark.createDataFrame([(k, float(k % 7), None if k % 11 == 0 else float(k % 5)) for k in range(300)], "id int, a double, b double")
    for score in ("a", "b"):
        for budget in (1, 37, 150, 272):
            want = {r["id"] for r in choose.top_budget(rows, score, "id", budget).collect()}
            got = {r["id"] for r in choose.marked_top(rows, score, "id", budget).filter("selected").collect()}
            assert got == want and len(got) == budget
    assert choose.marked_top(rows.limit(0), "a", "id", 3).count() == 0
    plan = choose.marked_top(rows, "a", "id", 5)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_infeasible_is_told_from_wrong_arguments(spark):
    rows = spark.createDataFrame([(k, float(k), "ab"[k % 2], {"ab"[k % 2]: 1.0}) for k in range(9)], "id int, u double, g string, m map<string,double>")
    assert [r["status"] for r in choose.frontier(rows, "u", "id", "g", 1, [0.0, 0.6]).collect()] == ["infeasible", "chosen"]
    with pytest.raises(ValueError, match="at least one row"):
        choose.frontier(rows, "u", "id", "g", 0, [0.0])
    with pytest.raises(ValueError, match="cannot give"):
        soft.frontier(rows, "u", "id", "m", "m", {"a": 0.5, "b": 0.5}, 99, [0.0])
    assert [r["status"] for r in soft.frontier(rows, "u", "id", "m", "m", {"a": 0.5, "b": 0.5}, 1, [0.0, 0.6]).collect()] == ["infeasible", "chosen"]


def test_groups_without_a_target_are_drawn_to_zero(spark):
    rows = spark.createDataFrame([(k, float(k), {"a": 1.0} if k < 4 else {"a": 1.0, "other": 1.0}) for k in range(8)], "id int, u double, m map<string,double>")
    got = soft.select(rows, "u", "id", "m", "m", {"a": 1.0}, 3, 0.1)
    assert {r["id"] for r in got.ids.collect()} == {"1", "2", "3"}
    with pytest.raises(choose.Infeasible):
        soft.select(rows, "u", "id", "m", "m", {"a": 1.0}, 5, 0.1)


def test_a_selection_without_rows_is_an_error(spark):
    rows = spark.range(5).select(F.lit("x").alias("g"), F.lit(False).alias("selected"))
    with pytest.raises(Exception, match="the selection has no rows"):
        audit.group_audit(rows, ["g"]).collect()


def test_trajectories_have_exact_nested_sizes(spark):
    rows = spark.createDataFrame([(k, "abc"[k % 3] if k < 90 else "d") for k in range(100)], "id int, label string")
    got = evaluate.random_trajectories(rows, "label", [10, 40, 100], 60, 5)
    sums = got.groupBy("repetition", "budget").agg(F.sum("own").alias("n"), F.sum("pool").alias("p")).collect()
    assert len(sums) == 180 and all(r["n"] == r["budget"] and r["p"] == 100 for r in sums)
    by = {(r["repetition"], r["budget"], r["label"]): r["own"] for r in got.collect()}
    assert all(by[k, 10, x] <= by[k, 40, x] <= by[k, 100, x] for k in range(1, 61) for x in "abcd")
    law = {r["budget"]: r for r in evaluate.envelope(got).collect()}
    assert law[100]["mean_tv"] == 0 and law[10]["mean_tv"] > law[40]["mean_tv"] > 0 and law[10]["largest_z"] == law[40]["largest_z"] > 1
    mean = {(r["budget"], r["label"]): r["mean_enrichment"] for r in evaluate.enrichment_envelope(got).collect()}
    assert mean[40, "a"] == pytest.approx(1, abs=0.1) and mean[100, "d"] == 1
    with pytest.raises(ValueError, match="budgets"):
        evaluate.random_trajectories(rows, "label", [101], 1, 1)


def test_slope_intervals_hold_the_slope(spark):
    rng = np.random.default_rng(2)
    x, noise = rng.normal(size=400), rng.normal(size=400)
    rows = spark.createDataFrame([(k, "s", float(a), float(2 * a + e)) for k, (a, e) in enumerate(zip(x, noise, strict=True))] + [(999, "one", 1.0, 2.0)], "id int, s string, x double, y double")
    got = {r["setting"]: r for r in evaluate.slope_intervals(rows, "s", "x", "y", "id", 300, 4).collect()}
    assert got["s"]["lower"] < 2 < got["s"]["upper"] and got["s"]["upper"] - got["s"]["lower"] == pytest.approx(2 * 1.96 / math.sqrt(400), rel=0.25)
    assert (got["one"]["lower"], got["one"]["upper"]) == (0.0, 0.0)
    stats = {r["setting"]: r for r in evaluate.response_statistics(rows, "s", "x", "y").collect()}
    assert stats["s"]["slope"] == pytest.approx(np.polyfit(x, 2 * x + noise, 1)[0]) and stats["s"]["values"] == 400
    assert stats["one"]["spearman"] == 0 and stats["one"]["least_y"] == stats["one"]["most_y"] == 2.0


def test_medians_by_rank(spark):
    rows = spark.createDataFrame([(float(v), v % 2 == 0, None if v < 4 else 1.0) for v in (1, 2, 3, 4, 10, 10)], "a double, selected boolean, b double")
    got = {r["field"]: r for r in audit.numeric_shift(rows, ["a", "b"]).collect()}
    assert (got["a"]["pool_median"], got["a"]["selected_median"]) == (3.5, 7.0)
    assert (got["b"]["pool_median"], got["b"]["pool_count"]) == (1.0, 3)


@pytest.mark.parametrize(("name", "want"), [("EntropyGradient", "entropy_gradient"), ("BADGE", "badge"), ("matched random", "matched_random"), (" Margin ", "margin")])
def test_method_names(name, want):
    assert selectors.method_name(name) == want


def test_selector_entry(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        p = rng.dirichlet([1, 1, 1])
        rows.append((f"i{k:02d}", p.tolist(), rng.normal(size=4).tolist(), {"abc"[k % 3]: 1.0}))
    pool = spark.createDataFrame(rows, "id string, p array<double>, embedding array<double>, membership map<string,double>")
    chosen = {m: [r["id"] for r in selectors.select(pool, m, 6, 2).collect()] for m in selectors.NEEDS if not m.endswith("_constrained")}
    assert all(len(set(ids)) == 6 for ids in chosen.values())
    entropy = {r[0]: -sum(x * math.log(x) for x in r[1]) for r in rows}
    assert set(chosen["entropy"]) == set(sorted(entropy, key=lambda k: (-entropy[k], k))[:6])
    # greedy farthest points over the gradient embeddings, by loops
    made = {r[0]: (np.outer(np.eye(3)[np.argmax(r[1])] - np.array(r[1]), np.array(r[2]) / np.linalg.norm(r[2]))).ravel() for r in rows}
    order = [max(sorted(made), key=lambda k: np.linalg.norm(made[k]))]
    while len(order) < 6:
        order.append(max((k for k in sorted(made) if k not in order), key=lambda k: min(np.linalg.norm(made[k] - made[o]) for o in order)))
    assert set(chosen["badge"]) == set(order)
    with pytest.raises(ValueError, match="needs the columns"):
        selectors.select(pool.drop("p"), "badge", 6)
    with pytest.raises(ValueError, match="no method"):
        selectors.select(pool, "oracle", 6)
    with pytest.raises(ValueError, match="must not see label"):
        selectors.select(pool.withColumn("label", F.lit(1)), "entropy", 6)


def test_preference_shift_and_effects(spark):
    rows = [("a b", 1, 10, 0.5, True), ("a c", 2, 30, 0.7, True), ("d", 1, 50, 0.1, False), ("d", None, 70, None, False)]
    pairs = spark.createDataFrame(rows, "prompt string, preferred_response int, words int, score double, selected boolean")
    report = preference.preference_shift(pairs, {"words": "length", "score": "scoring"}, "prompt")
    got = {(r["field"], r["statistic"]): r["value"] for r in report.collect()}
    assert got["words", "pool_mean"] == 40 and got["words", "mean_delta"] == -20 and got["score", "pool_count"] == 3
    effect = {r["domain"]: r["effect"] for r in preference.preference_effects(report).collect()}
    assert effect["length"] == 0.5 and effect["scoring"] == pytest.approx(0.6 - 1.3 / 3)
    assert effect["preference_direction"] == pytest.approx((abs(0.5 - 0.5) + abs(0.25 - 0.5) + 0.25) / 2) and 0 < effect["prompt_distribution"] < math.log(2)


def test_paired_delta_and_capability(spark):
    pairs = spark.createDataFrame([(str(k), 1.0, 1.0 + k / 10) for k in range(10)], "seed string, base double, treat double")
    row = evaluate.paired_delta(pairs, 200, 200, 3).first()
    assert row["mean_delta"] == pytest.approx(0.45) and row["lower"] < 0.45 < row["upper"] and row["n"] == 10
    assert evaluate.capability_regression(pairs, "base", "treat").first()["capability_regression"] == pytest.approx(-0.45)


def test_influence_selection_end_to_end(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(240):
        y = k % 2
        rows.append((f"i{k:03d}", y, (rng.normal(size=3) + (1.5 if y else -1.5)).tolist(), int(rng.integers(1, 100))))
    every = spark.createDataFrame(rows, "id string, label int, embedding array<double>, n int")
    seeds, pool = every.filter("id < 'i060'"), every.filter("id >= 'i060'").drop("label")
    got = selectors.by_influence(pool, seeds, 30, 0.25, 4, length="n", grid=(0.1,), heads=2)
    ids = [r["id"] for r in got.ids.collect()]
    assert len(set(ids)) == 30 and min(ids) >= "i060" and got.breach == 0 and 0 < got.utility <= got.bound + 1e-9
    groups = selectors.length_memberships(pool, "n").groupBy("length_group").count().collect()
    assert sorted(r["length_group"] for r in groups) == ["length_bin=long", "length_bin=medium", "length_bin=short"] and all(50 <= r["count"] <= 70 for r in groups)
    with pytest.raises(ValueError, match="must not see label"):
        selectors.by_influence(every, seeds, 30, 0.25, 4)
    with pytest.raises(ValueError, match="ten labelled"):
        selectors.by_influence(pool, seeds.limit(3), 30, 0.25, 4)


def test_hot_keys_and_components(spark):
    from quotaforge.operators.components import key_components

    rows = [(k, "hot" if k < 700 else f"k{k // 3}", f"s{k // 2}" if k >= 650 else None) for k in range(900)]
    got = {r["id"]: r["component"] for r in key_components(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"]).collect()}
    root = list(range(900))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for at in (1, 2):
        first: dict = {}
        for r in rows:
            if r[at] is not None:
                x, y = sorted((top(first.setdefault(r[at], r[0])), top(r[0])))
                root[y] = x
    assert got == {k: top(k) for k in range(900)}


def test_farthest_points_beyond_one_written_block(spark):
    rng = np.random.default_rng(3)
    vectors = {f"i{k:03d}": rng.normal(size=5) for k in range(90)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "id string, v array<double>")
    order = [max(sorted(vectors), key=lambda k: np.linalg.norm(vectors[k]))]
    while len(order) < 40:
        order.append(max((k for k in sorted(vectors) if k not in order), key=lambda k: min(np.linalg.norm(vectors[k] - vectors[o]) for o in order)))
    assert [r["id"] for r in choose.farthest_points(rows, "v", "id", 40).orderBy("step").collect()] == order
    assert choose.farthest_points(rows.limit(3), "v", "id", 9).count() == 3


def test_groups_orders_and_pooling(spark):
    rows = spark.createDataFrame([(1, "a b c", "a", None, 4), (2, None, "x", 0.0, 5), (3, None, None, None, None)], "id int, response_a string, response_b string, length_gap double, prompt_cluster_id int")
    got = {r["id"]: (r["length_gap_bin"], r["prompt_cluster"], r["length_by_prompt_cluster"]) for r in preference.pair_groups(rows).collect()}
    assert got == {1: ("a_longer", "4", "a_longer|4"), 2: ("balanced", "5", "balanced|5"), 3: (None, None, None)}
    with pytest.raises(Exception, match="lacks the group field"):
        preference.pair_groups(rows, ("prompt_cluster",)).collect()
    source = spark.createDataFrame([(7, 2), (8, 0), (9, 1)], "id int, at int")
    assert [r["id"] for r in tables.restore_order(spark.createDataFrame([(7, "x"), (8, "y"), (9, "z")], "id int, v string"), source, "id", "at").collect()] == [8, 9, 7]
    vectors = spark.createDataFrame([([[3.0, 0.0], [3.0, 8.0]],), ([[1.0], [-1.0]],), ([],)], "v array<array<double>>")
    assert [r[0] for r in vectors.select(expr.mean_pooled(F.col("v"))).collect()] == [[0.6, 0.8], [0.0], []]
    assert spark.range(1).select(expr.margin_confidence(F.lit(-2.0), 1.0)).first()[0] == pytest.approx(1 / (1 + math.exp(-2)))
    with pytest.raises(ValueError, match="positive"):
        expr.margin_confidence(F.lit(1.0), 0.0)


def test_components_write_keys_once(spark, monkeypatch):
    """The rounds run over ids: keys, which may be long, are written once as rows and once each as groups; ids may be strings."""
    from quotaforge.llm import graph
    from quotaforge.operators import components

    wrote = []

    def noted(f):
        return lambda frame: (wrote.append(any(t == "string" for _, t in frame.dtypes)), f(frame))[1]

    monkeypatch.setattr(components, "cut", noted(components.cut))
    monkeypatch.setattr(graph, "cut", noted(graph.cut))
    rows = [(k, f"a{(k + 1) // 2}", f"b{k // 2}") for k in range(12)] + [(20, None, None)]
    frame = spark.createDataFrame(rows, "id int, a string, b string")
    found = components.key_components(frame, "id", ["a", "b"])
    assert found.dtypes == [("id", "int"), ("component", "int")]
    assert {r["id"]: r["component"] for r in found.collect()} == {k: 0 for k in range(12)} | {20: 20}
    assert sum(wrote) <= 3
    named = components.key_components(frame.withColumn("id", F.format_string("n%02d", "id")), "id", ["a", "b"])
    assert {r["id"]: r["component"] for r in named.collect()} == {f"n{k:02d}": "n00" for k in range(12)} | {"n20": "n20"}
