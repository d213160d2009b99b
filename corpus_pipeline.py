"""Corpus pipeline: language ID, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; `run` writes each result as Parquet into the shared folder and reads it again.
Every stage but the last returns the columns of its input.

Defined cases: rows with null or letterless texts have no known language and go in
the first stage; of a group of near-duplicates the row with the least doc_id stays
(nulls last; of rows that repeat an id, the one first by text, source and lang); an
empty table stays empty; further columns are carried along unchanged until the last
stage, which returns the mix: doc_id, size, source_size, target, taken, copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm import decontam, language, mixing, secrets, simhash
from quotaforge.llm.common import shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose language is rejected; fits on the labelled rows of two of three folds."""
    model = language.train(docs.filter(~language.in_fold(F.col("doc_id"), 3, 1)).select("doc_id", "text", "lang"))
    return language.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group whose fingerprints are linked."""
    return simhash.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated rows."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars, where there is one, follows the new text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all rows that are left."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}-{name}")
        docs = spark.read.parquet(f"{where}/{k}-{name}")
    return docs


#: The learned language model, the fingerprints and the guess costs have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None
