"""Order, interventions, components, records, clusters and streams against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotaforge.operators import cluster, components, order, records, response
from quotaforge.streaming import shares


def test_ranks_inside_groups(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1009).alias("s"))
    got = {r["id"]: r["rank"] for r in order.rank_in_groups(rows, "g", [F.desc("s"), F.col("id")]).collect()}
    for g in range(3):
        want = sorted(range(g, 3000, 3), key=lambda k: (-(k * 7919 % 1009), k))
        assert [got[k] for k in want] == list(range(1, 1001))
    first = order.first_of_groups(rows, "g", [F.desc("s"), F.col("id")], 5, "id").collect()
    assert {(r["id"], r["_place"]) for r in first} == {(k, p) for k, p in got.items() if p <= 5}


def test_average_rank_shares_ties(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 2.0), (4, 5.0)], "id int, s double")
    assert {r["id"]: r["r"] for r in order.average_rank(rows, "s", "r").collect()} == {2: 0.0, 1: 1.5, 3: 1.5, 4: 3.0}


def test_response_curve_and_slope(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0, "x"), ("b", 0.5, 0.0, "y"), ("c", 0.4, 0.0, "y"), ("d", 0.1, 1.0, "x")], "id string, m double, gap double, g string")
    curve = response.response_curve(rows, "id", "g", [0.0, 1.0], lambda s: F.col("m") + s * F.col("gap"), 2)
    got = {(r["setting"], r["group"]): (r["selected_count"], r["propensity"]) for r in curve.collect()}
    assert got == {(0.0, "x"): (0, 0.0), (0.0, "y"): (2, 1.0), (1.0, "x"): (2, 1.0), (1.0, "y"): (0, 0.0)}
    assert response.curve_slope(curve, "x").first()["slope"] == pytest.approx(1.0)


def test_replacement_and_swaps(spark):
    rows = spark.createDataFrame([(1, 3.0, 1.0, "x"), (2, 2.0, 2.0, "y"), (3, 1.0, 3.0, "y")], "id int, a double, b double, g string")
    row = response.replacement(rows, "id", "a", "b", "g", 2).first()
    assert (row["overlap"], row["jaccard"], row["tv"], row["spearman"]) == (1, pytest.approx(1 / 3), pytest.approx(0.5), pytest.approx(-1.0))
    swaps = spark.createDataFrame([(1, "original", 0.2), (1, "swapped", 0.5), (2, "original", 0.1)], "pair int, position string, s double")
    row = response.swap_summary(swaps, "pair", "position", "s").first()
    assert (row["pairs"], row["max_delta"]) == (1, pytest.approx(0.3))


def test_dependence_is_found_and_refuted(spark):
    rows = spark.range(400).select("id", F.col("id").cast("double").alias("s"), (F.col("id") >= 200).cast("string").alias("near"), F.md5(F.col("id").cast("string")).substr(1, 1).alias("far"))
    near = response.group_dependence(rows, "id", "s", "near", 4, 99, 1).first()
    far = response.group_dependence(rows, "id", "s", "far", 4, 99, 1).first()
    assert near["p_value"] == 0.01 and near["mutual_information"] == pytest.approx(np.log(2))
    assert far["p_value"] > 0.02 and far["mutual_information"] < 3 * far["permuted_mean"]
    assert response.group_dependence(rows.limit(0), "id", "s", "near", 4, 9, 1).first()["p_value"] == 1.0


def test_components_against_brute_force(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, *range(25)]), r.choice([None, *range(40)])) for k in range(90)] + [(k, 100 + k // 2, 200 + (k + 1) // 2) for k in range(100, 140)]
    least = {k: k for k, _, _ in rows}
    moved = True
    while moved:
        moved = False
        for x, y in itertools.permutations(rows, 2):
            if any(a is not None and a == b for a, b in zip(x[1:], y[1:], strict=True)) and least[x[0]] < least[y[0]]:
                least[y[0]], moved = least[x[0]], True
    found = components.key_components(spark.createDataFrame(rows, "id long, a long, b long"), "id", ["a", "b"])
    assert {x["id"]: x["component"] for x in found.collect()} == least


def test_component_split_is_exact_and_whole(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") < 120, F.col("id") % 40).alias("prompt"), F.lit(None).cast("long").alias("pair"))
    parts = components.component_split(rows, "id", ["prompt", "pair"], {"seed": 21, "active": 100, "test": 40}, 3).collect()
    sizes: dict = {}
    where: dict = {}
    for p in parts:
        sizes[p["split"]] = sizes.get(p["split"], 0) + 1
        where.setdefault(p["component"], set()).add(p["split"])
    assert sizes == {"seed": 21, "active": 100, "test": 40} and all(len(w) == 1 for w in where.values())
    assert components.take_exact({3: 2}, 4) is None and components.take_exact({3: 2, 2: 1}, 5) == {3: 1, 2: 1}
    with pytest.raises(ValueError):
        components.component_split(rows.filter("id < 120"), "id", ["prompt"], {"seed": 20}, 3)


def test_records_and_stages(spark):
    rows = spark.createDataFrame([(1, 0.5, True, "A"), (2, 0.4, False, "B")], "id int, s double, selected boolean, label string")
    done = records.acquisition_records(rows, "id", "s", "selected", "label", {"method": "m", "seed": 1})
    assert [r["revealed_label"] for r in done.orderBy("sample_id").collect()] == ["A", None] and records.leaked(done).count() == 0
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id string")
    plan = records.execution_manifest(runs, [("select", [], ["{run}/ids"]), ("train", ["{run}/ids"], ["{run}/model", "{run}/log"]), ("judge", ["{run}/model"], ["{run}/wins"])])
    status = records.stage_status(plan, spark.createDataFrame([("r1/ids",), ("r1/log",), ("r2/ids",), ("r2/model",), ("r2/log",), ("r2/wins",)], "path string"))
    got = {(r["run_id"], r["stage"]): r["status"] for r in status.collect()}
    assert [got["r1", s] for s in ("select", "train", "judge")] == ["complete", "partial", "blocked"]
    assert [got["r3", s] for s in ("select", "train", "judge")] == ["ready", "blocked", "blocked"]
    assert {r["run_id"]: (r["status"], r["next_stage"]) for r in records.run_status(status).collect()} == {"r1": ("in_progress", "train"), "r2": ("complete", None), "r3": ("not_started", "select")}


def test_gates_claims_and_budgets(spark):
    gates = spark.createDataFrame([("g1", ["a", "b"]), ("g2", ["a"]), ("g3", [])], "gate string, required array<string>")
    found = {r["gate"]: (r["missing"], r["ready"]) for r in records.gate_readiness(gates, spark.createDataFrame([("a",)], "evidence string")).collect()}
    assert found == {"g1": ("b", False), "g2": ("", True), "g3": ("", True)}
    claims = spark.createDataFrame([("c1", "tv", ["e1"]), ("c2", "tv", []), ("c3", "acc", ["e1"]), ("c4", "tv", ["e9"]), ("c5", "tv", ["e2"])], "claim_id string, kind string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "tv", 3), ("e2", "tv", 1)], "evidence_id string, kind string, n_seeds int")
    got = {r["claim_id"]: r["issue"] for r in records.claim_issues(claims, evidence, 2).collect()}
    assert got == {"c2": "no_evidence", "c3": "other_kind", "c4": "unknown_evidence", "c5": "too_few_seeds"}
    runs = spark.createDataFrame([("r1", 10, 5, 2, 100), ("r2", 12, 3, 2, 104)], "run_id string, seed int, active int, test int, tokens int")
    assert {(r["supervision"], r["equal_supervision"], r["tokens_within"]) for r in records.budget_report(runs, ["seed", "active"], ["test"], "tokens", 0.05).collect()} == {(15, True, True)}


def test_clusters_and_facility_location(spark):
    g = np.random.default_rng(1)
    means = np.eye(3)
    data = [(f"{k:03d}", (means[k % 3] + 0.1 * g.normal(size=3)).tolist(), float(k == 7)) for k in range(90)]
    rows = spark.createDataFrame(data, "id string, v array<double>, p double")
    centres = cluster.fit_clusters(rows, "v", "id", 3)
    found = cluster.assign_clusters(rows, "v", "id", centres, 0.5).collect()
    groups: dict = {}
    for r in found:
        groups.setdefault(r["cluster"], set()).add(int(r["id"]) % 3)
        assert sum(r["memberships"]) == pytest.approx(1.0) and int(np.argmax(r["memberships"])) == r["cluster"]
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
    steps = cluster.facility_location(rows, rows.filter("cast(id as int) < 30"), "v", "id", "p", 4).collect()
    u = np.array([v for _, v, _ in data])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near, chosen = np.maximum(0, u @ u[:30].T), [7]
    while len(chosen) < 4:
        gain = np.maximum(0, near - near[:, chosen].max(1, keepdims=True)).sum(0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    assert [int(s["id"]) for s in steps] == chosen
    assert len(cluster.fit_clusters(rows.limit(0), "v", "id", 3)) == 0 and cluster.facility_location(rows, rows.limit(0), "v", "id", "p", 4).count() == 0


@pytest.mark.parametrize(("block", "held"), [(512, 20_000), (20, 30)])
def test_facility_location_over_the_whole_pool(spark, block, held):
    g = np.random.default_rng(5)
    centres = g.normal(size=(6, 5))
    # the rows of most priority lie between the classes, the dense clusters elsewhere
    data = [(f"{k:03d}", (centres[min(k % 17, 5)] + 0.2 * g.normal(size=5)).tolist(), 0.0) for k in range(300)]
    data += [(f"{300 + k}", (0.05 * g.normal(size=5)).tolist(), 1.0 + k) for k in range(64)] + [("364", [0.0] * 5, 0.0), ("365", None, 99.0)]
    rows = spark.createDataFrame(data, "id string, v array<double>, p double").repartition(3)
    steps = cluster.facility_location(rows, rows, "v", "id", "p", 9, block, held).orderBy("step").collect()
    u = np.array([v for _, v, _ in data[:-1]])
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    near, chosen = u @ u.T, [363]
    want = [near[:, 363].sum()]
    while len(chosen) < 9:
        gain = np.maximum(0, near - near[:, chosen].max(1, keepdims=True)).sum(0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
        want.append(gain.max())
    assert [int(s["id"]) for s in steps] == chosen and [s["gain"] for s in steps] == pytest.approx(want)
    assert min(chosen[1:]) < 300


def test_facility_location_scores_a_loose_pool_in_few_jobs(spark):
    g = np.random.default_rng(9)
    u = g.normal(size=(1200, 16))  # no direction stands out, so that bounds rule nothing out
    rows = spark.createDataFrame([(f"{k:04d}", v.tolist(), float(k == 5)) for k, v in enumerate(u)], "id string, v array<double>, p double")
    spark.sparkContext.setJobGroup("facility", "facility")
    steps = cluster.facility_location(rows, rows, "v", "id", "p", 4, 20, 128).orderBy("step").collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("facility")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near, chosen = u @ u.T, [5]
    while len(chosen) < 4:
        gain = np.maximum(0, near - near[:, chosen].max(1, keepdims=True)).sum(0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    assert [int(s["id"]) for s in steps] == chosen and steps[-1]["gain"] == pytest.approx(np.maximum(0, near[:, chosen[3]] - near[:, chosen[:3]].max(1)).sum())
    assert len(jobs) < 120, len(jobs)


def test_stream_counts_and_scoring_sink(spark, tmp_path):
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).cast("string").alias("g"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    counts = shares.windowed_counts(shares.arriving(spark, f"{tmp_path}/in", "*.parquet", rows.schema), "ts", "g", "30 minutes", "1 day")
    got = shares.run_to_table(counts, f"{tmp_path}/run")
    assert sorted(r["n"] for r in got.collect()) == [5, 5, 15, 15, 15, 15, 15, 15]
    for k in range(2):
        shares.score_arrivals(shares.arriving(spark, f"{tmp_path}/in", "*.parquet", rows.schema), f"{tmp_path}/out", "id", lambda b: b.select("id", (F.col("id") * 2).alias("s")), "id long, s long", f"{tmp_path}/state{k}")
    assert spark.read.json(f"{tmp_path}/out").count() == 100


def test_influence_is_the_change_of_the_validation_loss(spark):
    from quotaforge.operators import influence

    g = np.random.default_rng(3)
    x = g.normal(size=(120, 4))
    y = (x @ g.normal(size=(4, 3)) + 0.5 * g.normal(size=(120, 3))).argmax(1)
    rows = spark.createDataFrame([(k, x[k].tolist(), int(y[k])) for k in range(120)], "id int, f array<double>, y int")
    head = influence.calibrated(influence.fit_head(rows.filter("id < 60"), "f", "y", 0.1), rows.filter("id between 60 and 79"), "f", "y")
    val = slice(80, 100)
    gradient = influence.mean_gradient(head, rows.filter("id between 80 and 99"), "f", "y")

    def loss(w, b):
        p = influence.Head(w, b, head.temperature).probabilities(x[val])
        return -np.log(p[np.arange(20), y[val]]).mean()

    found = {int(r["id"]): r for r in influence.expected_influence(head, gradient, rows.filter("id >= 100"), "id", "f").collect()}
    assert len(found) == 20
    for k in range(100, 105):
        p = head.probabilities(x[k : k + 1])[0]
        for label in range(3):
            own = np.outer(p - np.eye(3)[label], [*x[k], 1.0]) / head.temperature
            step = 1e-5
            change = (loss(head.weights - step * own[:, :-1], head.bias - step * own[:, -1]) - loss(head.weights, head.bias)) / step
            assert found[k]["influences"][label] == pytest.approx(-change, rel=1e-2, abs=1e-4)
        assert found[k]["utility"] == pytest.approx(sum(q * max(0, i) for q, i in zip(p, found[k]["influences"], strict=True)))


def test_farthest_points_against_brute_force(spark):
    from quotaforge.operators import choose

    g = np.random.default_rng(5)
    v = g.normal(size=(40, 3))
    rows = spark.createDataFrame([(k, v[k].tolist()) for k in range(40)], "id int, v array<double>")
    want = [int(np.linalg.norm(v, axis=1).argmax())]
    while len(want) < 5:
        gap = np.linalg.norm(v[:, None] - v[want], axis=2).min(1)
        want.append(int(gap.argmax()))
    assert [int(r["id"]) for r in choose.farthest_points(rows, "v", "id", 5).orderBy("step").collect()] == want


def test_preflight_names_each_breach(spark):
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "id int")
    got = records.preflight(ids(1, 2, 3), ids(1, 2), ids(2, 9), ids(3, 9, 10), "id").collect()
    assert {(r["issue"], r["key"]) for r in got} == {("pool_without_label", "3"), ("seed_in_pool", "2"), ("heldout_in_pool", "3"), ("seed_in_heldout", "9")}


def test_bootstrap_and_envelope_are_near_their_laws(spark):
    from quotaforge.operators import evaluate

    rows = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("v"), (F.col("id") % 2).cast("string").alias("g"))
    row = evaluate.bootstrap_mean(rows, "v", "id", [], 300, 3).first()
    assert row["mean"] == 0.5 and row["upper"] - row["lower"] == pytest.approx(2 * 1.96 * 0.5 / 20, rel=0.2)
    row = evaluate.random_envelope(rows, "id", "g", 100, 200, 9).first()
    assert row["mean_tv"] == pytest.approx(0.5 * np.sqrt(0.75 / 100) * np.sqrt(2 / np.pi), rel=0.25) and row["repetitions"] == 200
