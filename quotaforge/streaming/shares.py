"""Streams: group shares by time window, late data bounded by a watermark, and a sink that scores each arriving row once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.operators.tables import pending


def arriving(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The Parquet files below `folder` whose names match `name`, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, group: str, window: str, watermark: str) -> DataFrame:
    """Rows per window and group; state of windows older than the watermark is dropped."""
    at = F.col(time).cast("timestamp")
    return stream.withColumn("_at", at).withWatermark("_at", watermark).groupBy(F.window("_at", window).alias("w"), F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(counts: DataFrame, folder: str) -> DataFrame:
    """Runs the aggregation over all that has arrived, and gives its table: the last write of each window and group holds.

    Offsets and state lie below `folder`, so a run that is broken off goes on where it was.
    Each micro-batch writes its changed groups under its own number; a repeated batch
    overwrites itself.
    """
    spark = counts.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("start"), "group", "n", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    found = spark.read.schema("start timestamp, group string, n long, batch long").parquet(f"{folder}/out")
    return found.groupBy("start", "group").agg(F.max_by("n", "batch").alias("n"))


def score_arrivals(stream: DataFrame, path: str, key: str, score: Callable[[DataFrame], DataFrame], schema: str, state: str) -> None:
    """Appends the scores of arriving rows to the JSON Lines at `path`; ids that are there already are left out, so a repeat adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            batch = pending(batch, spark.read.schema(schema).json(path), key)
        score(batch.dropDuplicates([key])).write.mode("append").json(path)

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(run).start().awaitTermination()


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below the one that `spark.checkpoint.dir` names."""
    from quotaforge.operators.order import cut

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        cut(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
