"""Templates, records, chunks, positions and shift decisions on small known cases."""

from pyspark.sql import functions as F

from quotaforge.functions import templates
from quotaforge.operators import audit


def test_messages_and_records(spark):
    rows = spark.createDataFrame([(1, "good", 1), (2, None, 0), (3, "x", None), (4, "y", 7)], "id int, text string, label int")
    got = templates.classification_records(rows, "id", "text", "label", ["no", "yes"]).orderBy("id").collect()
    assert [(r["id"], r["answer"]) for r in got] == [(1, "B"), (2, "A")]
    assert got[0]["messages"][1]["content"] == "Text:\ngood\n\nCategories:\nA: no\nB: yes\n\nClassify the text and answer with exactly one letter from A to B."
    pairs = spark.createDataFrame([(1, "p", "u", "v", 2), (2, "p", "u", "v", 0), (3, "p", "u", "v", None)], "id int, prompt string, r1 string, r2 string, preferred int")
    record = templates.preference_records(pairs, "id", "prompt", "r1", "r2", "preferred").collect()
    assert [(r["id"], r["chosen"], r["rejected"]) for r in record] == [(1, "v", "u")]
    said = pairs.select(templates.pairwise_messages(F.col("prompt"), F.col("r1"), F.lit(None).cast("string")).alias("m")).first()["m"]
    assert "Response A:\nu\n\nResponse B:\n\n\n" in said[1]["content"]
    assert spark.range(1).select(templates.embedding_prompt(F.lit(" d "), F.lit("q"), instruction="i")).first()[0] == "Instruction:\ni\n\nQuery:\nq\n\nDocument:\nd"


def test_chunks_keep_sentences_and_overlap(spark):
    one = lambda text, size, overlap: spark.range(1).select(templates.chunks(F.lit(text).cast("string"), size, overlap)).first()[0]
    assert one("Aa bb. Cc dd. Ee ff.", 14, 3) == ["Aa bb. Cc dd.", "dd. Ee ff."]
    assert one("Aa bb. Cc dd. Ee ff.", 1, 0) == ["Aa bb.", "Cc dd.", "Ee ff."]
    assert one("", 10, 3) == [""] and one(None, 10, 3) == [""]


def test_positions_move_the_label(spark):
    rows = spark.createDataFrame([(k, "x", "y", p) for k, p in enumerate([1, 2, 0, None])], "id int, response_1 string, response_2 string, preferred_response int").withColumn("id", F.col("id").cast("string"))
    got = {r["id"]: (r["response_a"], r["label"]) for r in templates.positioned_pairs(rows, "id", 1, True).collect()}
    assert got == {
        "0:original": ("x", "A"), "0:swapped": ("y", "B"), "1:original": ("x", "B"), "1:swapped": ("y", "A"),
        "2:original": ("x", "tie"), "2:swapped": ("y", "tie"), "3:original": ("x", None), "3:swapped": ("y", None),
    }
    once = templates.positioned_pairs(rows, "id", 5)
    assert once.count() == 4 and sorted(map(str, once.collect())) == sorted(map(str, templates.positioned_pairs(rows, "id", 5).collect()))


def test_shift_decisions(spark):
    report = spark.createDataFrame([("entropy", 10, 0.05), ("entropy", 20, 0.05), ("margin", 10, 0.06), ("margin", 20, 0.06), ("odd", 10, 0.5), ("odd", 20, 0.0)], "method string, budget int, tv_excess double")
    classes = spark.createDataFrame([(m, b, "c", 0.2) for m in ("entropy", "margin", "odd") for b in (10, 20)] + [("margin", 10, "d", 0.2)], "method string, budget int, class string, enrichment_excess double")
    shifts = audit.established_shifts(report, classes)
    assert {r["method"]: (r["established"], r["stable_classes"]) for r in shifts.collect()} == {"entropy": (True, ["c"]), "margin": (True, ["c"]), "odd": (False, [])}
    assert audit.recommended_method(shifts).first()["method"] == "entropy"
    assert audit.recommended_method(shifts, comparable=0.001).first()["method"] == "margin"
    assert audit.recommended_method(shifts.filter("method = 'odd'")).count() == 0
