"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` (or `setCheckpointDir`) names; where neither is set, one of our own on a local master, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where and context._jsc.sc().getCheckpointDir().isDefined():
        where = context._jsc.sc().getCheckpointDir().get()
    if not where and context.master.startswith("local"):
        where = "file://" + tempfile.mkdtemp(prefix="quotaforge-checkpoint-")
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(where)
    return where


def cut(frame: DataFrame) -> DataFrame:
    """`frame` written to the shared checkpoint folder: its lineage ends there and lost executors do not redo it."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """`frame` written as Parquet to the shared folder and read again: lineage ends there, and readers take only the columns they use."""
    where = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(where)
    return frame.sparkSession.read.schema(frame.schema).parquet(where)


#: A key with more than so great a part of all rows, and more rows than the least, is hot; there are at most 1000 such keys.
HOT_PART, HOT_LEAST = 1000, 256


def meet(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join of `many` with `one`, which has a row per key and counts that key's rows of `many` in `_rows`.

    The hot keys, fewer than `HOT_PART`, are broadcast, so their rows stay where they are; all others are shuffled.
    """
    total, largest = one.agg(F.sum("_rows"), F.max("_rows")).first()
    most = max((total or 0) // HOT_PART, HOT_LEAST)
    hot, rest = one.filter(F.col("_rows") > most).drop("_rows"), one.filter(F.col("_rows") <= most).drop("_rows")
    if (largest or 0) <= most:
        return many.join(rest, key)
    return many.join(F.broadcast(hot), key).unionByName(many.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions that a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_hashed(frame: DataFrame, n: int, *keys: str) -> DataFrame:
    """About `n` rows of `frame`: those whose hash of `keys` is at most the n-th least (with `_least_hash`).

    Only hashes are ranked, so tasks send 8 bytes a row and texts stay where they are.
    """
    hashed = frame.withColumn("_least_hash", F.xxhash64(*keys))
    last = hashed.select("_least_hash").orderBy("_least_hash").limit(n).agg(F.max("_least_hash")).first()[0]
    return hashed.filter(F.col("_least_hash") <= F.lit(last if last is not None else 0).cast("long"))
