"""JSON Lines sources and sinks, and id-to-vector files, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.operators.tables import pending


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line (gzip by suffix; a folder: its *.jsonl and *.jsonl.gz files); the schema is always given."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.jsonl*").json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def append_pending(rows: DataFrame, path: str, key: str, score, schema: str) -> DataFrame:
    """Scores only the rows that `path` does not hold yet, appends them, and gives what is there now."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(schema).json(path)
        done.limit(1).collect()
        rows = pending(rows, done, key)
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    score(rows).write.mode("append").json(path)
    return spark.read.schema(schema).json(path)


def load_examples(spark: SparkSession, path: str, query: str = "query", document: str = "document", label: str = "label") -> DataFrame:
    """Typed query/document/label rows; the label is the first of the named field, label, groundtruth and parsed_answer."""
    fields = list(dict.fromkeys(["id", "sample_id", query, document, label, "label", "groundtruth", "parsed_answer"]))
    raw = spark.read.schema(", ".join([*(f"`{f}` string" for f in fields), "weight double"])).option("pathGlobFilter", "*.jsonl*").json(path)
    first = F.coalesce(*[F.col(f) for f in dict.fromkeys([label, "label", "groundtruth", "parsed_answer"])])
    return raw.select(
        F.coalesce("id", "sample_id").alias("id"), F.col(query).alias("query"), F.col(document).alias("document"),
        F.lower(F.trim(first)).try_cast("int").alias("label"), F.coalesce("weight", F.lit(1.0)).alias("weight"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def label_store(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """(id, the fields of `schema`) of a label store: JSON objects keyed by id, one a file, or JSON Lines with an id (`lines`).

    A file, or a folder of them at any depth. What is no object of objects, a row without an
    id and an id that stands twice (in one object or in several files) are errors. An object is
    parsed by one task, so large stores are lines or many objects.
    """
    text = spark.read.text(path, wholetext=not lines, recursiveFileLookup=True).filter(F.trim("value") != "")
    if lines:
        each = text.select(F.get_json_object("value", "$.id").alias("id"), F.col("value").alias("v"))
    else:
        each = text.select(F.explode(F.coalesce(F.from_json("value", "map<string,string>"), F.raise_error(F.lit("a label store must be an object keyed by id")).cast("map<string,string>"))).alias("id", "v"))
    fields = F.from_json("v", schema)
    bad = F.when(F.col("id").isNull(), F.lit("a label without an id")).when(~F.ltrim(F.coalesce("v", F.lit(""))).startswith("{"), F.concat(F.lit("no object of labels: "), F.col("id")))
    checked = each.select("id", F.when(bad.isNotNull(), F.raise_error(bad).cast(spark.createDataFrame([], schema).schema)).otherwise(fields).alias("row"))
    if twice := each.groupBy("id").count().filter("count > 1").limit(5).collect():
        raise ValueError(f"ids repeat: {', '.join(str(r['id']) for r in twice)}")
    return checked.select("id", *[F.col("row")[f.name].alias(f.name) for f in spark.createDataFrame([], schema).schema if f.name != "id"])
