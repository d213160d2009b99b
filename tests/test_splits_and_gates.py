"""Three-way splits that keep repeats together, label stores, and the decisions after the shift gates."""

import json
import random

import pytest

from quotaforge.operators import audit, tables
from quotaforge.sources import jsonl


def test_three_way_split_keeps_groups_and_quotas(spark):
    r = random.Random(3)
    rows, n = [], 0
    for g in range(150):
        for _ in range(r.choice([1, 1, 1, 2, 5, 30 if g % 50 == 0 else 1])):
            rows.append((n, f"q{g % 7}" if g % 9 else None, f"d{g}", "yes" if g % 3 else None))
            n += 1
    frame = spark.createDataFrame(rows, "id int, query string, document string, label string").selectExpr("*", "id _key", "id _k", "'old' split").repartition(5)
    for stratified in (True, False):
        got = tables.three_way_split(frame, ["query", "document"], "label", 0.2, 0.1, 8, stratified).collect()
        assert sorted(x["id"] for x in got) == list(range(n))
        where = {}
        for x in got:
            where.setdefault(x["document"], set()).add(x["split"])
        assert all(len(s) == 1 for s in where.values())
        for part in ("yes", None) if stratified else ("all",):
            own = [x for x in got if part == "all" or x["label"] == part]
            for name, share in (("train", 0.2), ("validation", 0.1)):
                have = sum(x["split"] == name for x in own)
                assert round(len(own) * share) <= have < round(len(own) * share) + 30
    again = tables.three_way_split(frame.coalesce(1), ["query", "document"], "label", 0.2, 0.1, 8, False).collect()
    assert {x["id"]: x["split"] for x in again} == {x["id"]: x["split"] for x in got}


def test_three_way_split_of_few_rows_and_refusals(spark):
    frame = spark.createDataFrame([(1, "a", "b", 0), (2, "ab", "", 0), (3, "x", "y", 1)], "id int, q string, d string, y int")
    got = {x["id"]: x["split"] for x in tables.three_way_split(frame, ["q", "d"], "y", 0.1, 0.1, 1).collect()}
    assert got[3] == "train" and sorted([got[1], got[2]]) == ["test", "train"]
    assert tables.three_way_split(frame.limit(0), ["q", "d"], "y", 0.1, 0.1, 1).count() == 0
    mixed = frame.union(spark.createDataFrame([(4, "a", "b", None)], frame.schema))
    with pytest.raises(ValueError, match="more than one label"):
        tables.three_way_split(mixed, ["q", "d"], "y", 0.1, 0.1, 1)
    for bad in ((0, 0.1), (0.5, 0.5), (0.5, -0.1)):
        with pytest.raises(ValueError, match="below 1"):
            tables.three_way_split(frame, ["q", "d"], "y", *bad, 1)


def test_label_store(spark, tmp_path):
    path = tmp_path / "store.json"
    path.write_text(json.dumps({"b": {"label": 1, "label_name": "x\n"}, "a": {"label": None}}, indent=1))
    schema = "label int, label_name string"
    want = {("a", None, None), ("b", 1, "x\n")}
    assert {tuple(r) for r in jsonl.label_store(spark, str(path), schema).collect()} == want
    lines = tmp_path / "store.jsonl"
    lines.write_text('{"id": "a", "label": null}\n\n{"id": "b", "label": 1, "label_name": "x\\n"}\n')
    assert {tuple(r) for r in jsonl.label_store(spark, str(lines), schema, lines=True).collect()} == want
    for text, as_lines, match in (
        ("[1]", False, "keyed by id"), ('{"a": 3}', False, "no object"), ('{"a": {"label": 1}, "a": {"label": 2}}', False, "repeat"),
        ('{"label": 3}', True, "without an id"), ('{"id": "a"}\n{"id": "a"}', True, "repeat"),
    ):
        path.write_text(text)
        with pytest.raises(Exception, match=match):
            jsonl.label_store(spark, str(path), schema, as_lines).collect()


def test_preference_gate_and_decision(spark):
    rows = [
        ("a", "length", 0.2, None), ("a", "attributes", 0.5, 0.1), ("a", "order_disagreement", 9.0, 9.0), ("b", "length", 0.3, 0.0), ("b", "prompt_distribution", 0.02, 0.01),
        ("c", "length", 0.1, None), ("c", "preference_direction", 0.05, None), ("random", "length", 9.0, None), ("random", "attributes", 9.0, None),
    ]
    gates = audit.preference_gate(spark.createDataFrame(rows, "method string, domain string, effect double, excess double"))
    got = {r["method"]: (r["material_domains"], round(r["gate_score"], 9), r["established"]) for r in gates.collect()}
    assert got == {"a": (["attributes", "length"], 4.0, True), "b": (["prompt_distribution"], 2.0, False), "c": (["length", "preference_direction"], 2.0, True)}
    assert tuple(audit.preference_decision(gates, 0.1).first()) == (True, "a", False, True, "run_random_vs_uncertainty_dpo")
    assert tuple(audit.preference_decision(gates, 0.2).first()) == (True, "a", True, False, "repair_pairwise_scoring_first")
    assert tuple(audit.preference_decision(gates.filter("method = 'b'"), None).first()) == (False, None, False, False, "collect_more_preference_evidence")
    assert audit.preference_decision(gates.limit(0), None).first()["next_step"] == "collect_more_preference_evidence"


def test_every_recommendation(spark):
    T, F_ = True, False
    cases = [
        ("repair_pairwise_scoring_first", F_, F_, T, None, None, None, None), ("repair_pairwise_scoring_first", T, T, T, -0.04, -0.5, None, -0.5),
        ("keep_current_algorithm", F_, F_, T, -0.05, -0.5, -0.5, -0.5), ("keep_current_algorithm", None, None, None, None, None, None, None),
        ("defer_algorithm_change_until_training", T, F_, F_, None, None, None, -0.5), ("defer_algorithm_change_until_training", T, T, F_, None, -0.5, None, None),
        ("restructure_algorithm", T, T, F_, None, 0.0, -0.01, -0.01), ("introduce_wsr", T, T, F_, None, 0.0, 0.0, -0.02), ("introduce_wsr", F_, T, F_, None, -0.5, None, -0.02),
        ("refine_dcms_constraints", T, T, F_, None, -0.3, None, 0.0), ("keep_current_algorithm_with_monitoring", T, T, F_, None, 0.1, -0.009, 0.2),
    ]
    names = "want string, classification_established boolean, preference_established boolean, position_bias boolean, order_delta double, accuracy_delta double, macro_f1_delta double, preference_delta double"
    for r in audit.recommended_action(spark.createDataFrame(cases, names)).collect():
        assert r["recommendation"] == r["want"], r
