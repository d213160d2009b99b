"""Adapters, layered joins, deltas and calibrated shifts on small known cases."""

import pytest
from pyspark.sql import functions as F

from quotaforge.operators import evaluate, soft, tables
from quotaforge.sources import adapters


def test_labels_by_number_name_and_code(spark):
    raw = spark.createDataFrame([(0, "hum", " a "), (1, "Location", None), (2, "5", ""), (3, None, "b")], "line int, label string, text string")
    rows = adapters.classification_rows(raw, "trec", "train", "line", ["text", "text"], "label", adapters.TREC, adapters.TREC_CODES).orderBy("id").collect()
    assert [(r["id"], r["label"], r["label_name"], r["text"]) for r in rows] == [
        ("trec:train:0", 3, "HUMAN_BEING", "a\n\na"), ("trec:train:1", 4, "LOCATION", ""), ("trec:train:2", 5, "NUMERIC_VALUE", ""), ("trec:train:3", None, None, "b\n\nb"),
    ]
    with pytest.raises(Exception, match="unknown label"):
        adapters.classification_rows(raw.withColumn("label", F.lit("9")), "ag", "train", "line", ["text"], "label", adapters.AG_NEWS).collect()


def test_binary_and_remapped_rows(spark):
    raw = spark.createDataFrame([(0, "a", "x ", 1), (1, None, "y", 0)], "line int, key string, doc string, y int")
    rows = adapters.binary_rows(raw, "imdb", "test", "line", "is it good?", "doc", "y").orderBy("id").collect()
    assert [(r["query"], r["document"], r["groundtruth"]) for r in rows] == [("is it good?", "x", 1), ("is it good?", "y", 0)]
    for bad in (raw.withColumn("y", F.lit(2)), raw.withColumn("doc", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="bad imdb row"):
            adapters.binary_rows(bad, "imdb", "test", "line", "q", "doc", "y").collect()
    assert [r["id"] for r in adapters.remapped(raw, "key", "q", "doc", "y", "row", "line").orderBy("id").collect()] == ["a", "row_1"]
    assert adapters.repeated_ids(spark.createDataFrame([("a",), ("a",), ("b",)], "id string")).collect() == [("a", 2)]


def test_embedding_issues(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, float("nan")])], "id int, v array<double>")
    got = adapters.embedding_issues(spark.range(1, 5).select(F.col("id").cast("int")), vectors, "id", "v", 2)
    assert {(r["id"], r["issue"]) for r in got.collect()} == {(2, "size"), (3, "not finite"), (4, "missing")}


def test_layers_deltas_and_calibration(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, n string, s double")
    got = tables.layered_join(base, [spark.createDataFrame([(1, 9.0, 5)], "id int, s double, t int"), spark.createDataFrame([(1, None), (2, 3.0)], "id int, s double")], "id").orderBy("id").collect()
    assert [(r["s"], r["t"], r["n"]) for r in got] == [(9.0, 5, "a"), (3.0, None, "b")]
    metrics = spark.createDataFrame([("base", 0.5, 3), ("new", 0.75, 4)], "model string, accuracy double, n int")
    assert {(r["model"], r["metric"]): r["delta"] for r in evaluate.metric_deltas(metrics, "model", "base").collect()} == {("base", "accuracy"): 0.0, ("base", "n"): 0.0, ("new", "accuracy"): 0.25, ("new", "n"): 1.0}
    law = spark.createDataFrame([(10, 0.1, 0.05, 0.2), (20, 0.1, 0.0, 0.1)], "budget int, mean_tv double, std_tv double, quantile_tv double")
    rows = evaluate.calibrated_shift(spark.createDataFrame([(10, 0.25), (20, 0.1), (30, 0.5)], "budget int, tv double"), law, "budget", "tv").orderBy("budget").collect()
    assert [r["z"] for r in rows] == [pytest.approx(3.0), 0.0, None] and rows[0]["over_upper"] == pytest.approx(0.05)


def test_matched_random_is_within_tolerance_and_seeded(spark):
    rows = spark.range(8).select("id", F.create_map(F.when(F.col("id") < 4, "a").otherwise("b"), F.lit(1.0)).alias("m"))
    seen = set()
    for seed in range(6):
        ids = sorted(int(r["id"]) for r in soft.matched_random(rows, "id", "m", {"a": 0.5, "b": 0.5}, 4, 0.01, seed).collect())
        assert len(ids) == 4 and sum(i < 4 for i in ids) == 2
        seen.add(tuple(ids))
    assert len(seen) > 1
    with pytest.raises(ValueError):
        soft.matched_random(rows, "id", "m", {"a": 0.5}, 3, 0.01, 1)
