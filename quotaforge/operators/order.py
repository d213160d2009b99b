"""Ranks over whole tables and inside groups of any size, without a window over all of a group."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts into which a group is cut before its first rows are taken.
SALTS = 64


def cut(frame: DataFrame) -> DataFrame:
    """`frame` written to the folder of `spark.checkpoint.dir`; where it is unset, one of our own on a local master, an error on a cluster."""
    spark = frame.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = where or "file://" + tempfile.mkdtemp(prefix="quotaforge-")
        spark.sparkContext.setCheckpointDir(where)
    return frame.checkpoint()


def global_rank(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based rank by `order`: ranges are sorted apart and offset by their sizes.

    The sorted ranges are written once, so that both uses see the same range bounds even
    where an executor is lost between them.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_least"))
    offset = sizes.select(F.col("_part").alias("_p"), "_least", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    return placed.join(F.broadcast(offset), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_seq") - F.col("_least") + 1).drop("_part", "_p", "_seq", "_least", "_before")


def running_sum(rows: DataFrame, order: list, value: str, name: str = "before") -> DataFrame:
    """Sum of the whole numbers `value` over the rows before a row in `order`: ranges add up their own rows and start where the range before ends."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    offset = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return placed.withColumn("_in", inside).join(F.broadcast(offset), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_p", "_in", "_before")


def rank_in_groups(rows: DataFrame, group: str, order: list, name: str = "rank") -> DataFrame:
    """1-based rank inside each group: one order by (group, order), less the rank of the group's first row."""
    ranked = global_rank(rows, [F.col(group).asc_nulls_first(), *order], "_at")
    first = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("_at").alias("_first"))
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_g", "_first")


def first_of_groups(rows: DataFrame, group: str, order: list, k: int, id_: str, name: str = "_place") -> DataFrame:
    """The first `k` rows of each group with their place.

    A group is cut into `SALTS` parts by a hash of the id; each part gives its first `k`
    rows, so no task holds more of a group than a part or `SALTS * k` rows.
    """
    inner, outer = Window.partitionBy(group, "_salt").orderBy(*order), Window.partitionBy(group).orderBy(*order)
    part = rows.withColumn("_salt", F.pmod(F.xxhash64(id_), F.lit(SALTS))).withColumn("_own", F.row_number().over(inner)).filter(F.col("_own") <= k)
    return part.withColumn(name, F.row_number().over(outer)).filter(F.col(name) <= k).drop("_salt", "_own")


def average_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """0-based rank by `value`, ties sharing their mean."""
    ranked = global_rank(rows, [F.col(value).asc()], "_at")
    mean = ranked.groupBy(F.col(value).alias("_v")).agg((F.avg("_at") - 1).alias(name))
    return ranked.drop("_at").join(mean, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")
