"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash of its id and text. A source's budget is met by
whole copies of all of its documents plus one more copy of those whose hash lies
below a threshold. The threshold is found without sorting the documents: sizes are
summed by (source, leading hash digits), a running sum over at most 4,096 bucket
sums per source finds the bucket that the budget ends in, and only that bucket's
documents are summed again by their next digits, until it holds one document. Rows
that share id and text go on by the digits of a row number, so they are taken one
by one; as they are alike, the result does not depend on which of them are.

Defined cases: a null text has size 0; null sources form one source, last in
order; a null doc_id hashes like the empty text; rows that repeat are rows of their
own; of two thresholds around the budget the nearer one is used, the lower on a tie;
a source without words takes nothing; an empty table gives no rows. Further columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotaforge.llm.common import cut, table

#: Fixed by the query's contract.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Hexadecimal digits of the hash and of the row number, and how many of them each histogram resolves.
DIGITS, NUMBER, STEP = 15, 16, 3
#: Sources (rows of a few dozen bytes) up to which the per-source table is broadcast; beyond it the joins shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of blank-separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """Targets of sources (`source`, `source_size`): `share` of all sizes by weight, at most `most` times a source's size.

    The excess of capped sources goes to the others by weight until none is above:
    with caps C and weights w the level x solves sum(min(C, x * w)) = budget. In the
    order of C / w the capped sources come first, so running sums give x directly.
    One row per source passes through here, never one per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    placed = (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_all_w", F.sum("_w").over(every))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_at", F.row_number().over(by_ratio))
        .withColumn("_level", (F.col("_budget") - F.col("_cap_before")) / (F.col("_all_w") - F.col("_w_before")))
    )
    # the first source, in the order of the ratios and, among equal ones, of the names, that its level does not cap: its level holds for it and all after it
    level = F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_at", "_level"))).over(every)
    return placed.select(
        "source", "source_size",
        F.coalesce(F.least(F.col("_cap"), level["_level"] * F.col("_w")), F.col("_cap")).alias("target"),
    )


def _place(level: int) -> Column:
    """Digits of the hash that histogram `level` resolves."""
    return F.substring("_hash", 1 + level * STEP, STEP)


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken and `copies` (taken = copies * size)."""
    about = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    number = F.lower(F.lpad(F.hex(F.monotonically_increasing_id()), NUMBER, "0"))
    slim = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.concat(F.substring(F.md5(about), 1, DIGITS), number).alias("_hash")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    # whole copies for all, and what is left of the target for the threshold
    plan = (
        targets(sizes, weights, most, share)
        .withColumn("_whole", F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))))
        .withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_prefix", F.lit(""))
    )
    plan = cut(plan)
    small = plan.count() <= BROADCAST_SOURCES
    held = F.broadcast if small else lambda frame: frame
    inside = slim
    level = 0
    while True:
        key = plan.select(F.col("source").alias("_s"), F.col("_prefix").alias("_p"), F.col("_left").alias("_l"))
        inside = inside.join(held(key), F.col("source").eqNullSafe(F.col("_s")) & F.startswith(F.col("_hash"), F.col("_p")), "inner")
        sums = inside.groupBy("source", _place(level).alias("_bucket")).agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.first("_l").alias("_l"))
        inside = inside.drop("_s", "_p", "_l")
        run = F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket"))
        # the bucket in which the budget ends: the first that reaches it
        ends = (
            sums.withColumn("_run", run)
            .filter(F.col("_run") >= F.col("_l"))
            .groupBy("source")
            .agg(F.min(F.struct("_bucket", "_sum", "_run", "_n")).alias("_end"))
        )
        renamed = ends.select(F.col("source").alias("_s"), "_end")
        before = F.col("_end._run") - F.col("_end._sum")
        found = F.col("_end").isNotNull()
        left = F.when(found, F.col("_left") - before).otherwise(F.col("_left"))
        # once the bucket is one document, either side of it: the nearer sum wins, the lower on a tie
        over = F.col("_end._run") - F.col("_left")
        plan = (
            plan.drop("_take_end", "_n").join(held(renamed), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
            .withColumn("_take_end", F.coalesce(over < left, F.lit(False)))
            .withColumn("_n", F.coalesce("_end._n", F.lit(0)))
            .withColumn("_left", left)
            .withColumn("_prefix", F.when(found, F.concat("_prefix", F.col("_end._bucket"))).otherwise(F.concat("_prefix", F.lit("z"))))
            .drop("_end")
        )
        plan = cut(plan)
        level += 1
        if level * STEP >= DIGITS + NUMBER or (plan.agg(F.max("_n")).first()[0] or 0) <= 1:
            break
    rule = plan.select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_prefix", "_take_end")
    below = (F.startswith(F.col("_hash"), F.col("_prefix")) & F.col("_take_end")) | (F.col("_hash") < F.col("_prefix"))
    copies = (F.col("_whole") + F.when(below & (F.col("_whole") < most), 1).otherwise(0)).cast("long")
    return (
        slim.join(held(rule), F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"))
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_sql(documents: str = "documents") -> str:
    """The same mix by sorting: a running sum over each source's documents in the order of their hashes."""
    return f"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15) AS h, row_number() OVER () AS k
  FROM {documents}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r
), x AS (SELECT level FROM l WHERE level < ratio ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
t AS (
  SELECT l.source, l.source_size, coalesce(least(l.cap, x.level * l.w), l.cap) AS target FROM l LEFT JOIN x ON true
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, copies * size AS taken, copies
FROM (SELECT *, (whole + CASE WHEN whole < 3 AND (run < budget OR (run - size < budget AND run - budget < budget - (run - size)))
                         THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
"""
