"""Batches under a budget of padded tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaforge.functions.expr import seeded
from quotaforge.operators.order import global_rank


def plan(histogram: list[tuple[int, int]], most_rows: int, most_tokens: int) -> list[tuple[int, int, int, int, int]]:
    """Per (length, rows) in ascending order: (length, rows before, first batch, rows already in it, rows of a full batch).

    Rows of one length fill the open batch and then batches of equal size; what crosses
    from one length to the next is the number of the open batch and its rows.
    """
    out, before, batch, open_ = [], 0, 0, 0
    for length, n in histogram:
        full = max(1, min(most_rows, most_tokens // length))
        if open_ >= full:
            batch, open_ = batch + 1, 0
        out.append((length, before, batch, open_, full))
        closed = (open_ + n - 1) // full
        batch, open_, before = batch + closed, open_ + n - closed * full, before + n
    return out


def token_batches(rows: DataFrame, length: str, id_: str, most_rows: int, most_tokens: int) -> DataFrame:
    """All rows with `batch` (from 0) and `place` in it (from 0): filled greedily by ascending length, ties by the id's string.

    A batch holds at most `most_rows` rows, and rows times its longest length is at most
    `most_tokens`; a longer row is a batch of its own. Lengths below 1, and null, count as 1.
    Batches follow from a histogram of lengths, which has at most `most_tokens` + 1 bars as
    all longer rows are alone; the rows themselves are ordered by ranges.
    """
    if most_rows < 1 or most_tokens < 1:
        raise ValueError("a batch holds at least one row and one token")
    sized = rows.withColumn("_length", F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(1)), F.lit(1)))
    bar = F.least(F.col("_length"), F.lit(most_tokens + 1).cast("long"))
    bars = sized.groupBy(bar.alias("bar")).count().orderBy("bar").collect()  # most_tokens + 1 rows at most
    table = rows.sparkSession.createDataFrame(plan([(r["bar"], r["count"]) for r in bars], most_rows, most_tokens), "_bar long, _before long, _batch long, _open long, _full long")
    ranked = global_rank(sized, [F.col("_length"), F.coalesce(F.col(id_).cast("string"), F.lit(""))], "_rank").withColumn("_bar", bar)
    at = F.col("_open") + F.col("_rank") - 1 - F.col("_before")
    placed = ranked.join(table, "_bar").withColumn("batch", F.col("_batch") + F.floor(at / F.col("_full"))).withColumn("place", at % F.col("_full"))
    return placed.select(*rows.columns, F.col("batch").cast("long"), F.col("place").cast("long"))


def epoch_order(batches: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Rows (batch, turn): a seeded order of the batches, another one each epoch."""
    each = batches.select("batch").distinct()
    return global_rank(each, [seeded(seed + epoch, F.col("batch")), F.col("batch")], "turn").select("batch", "turn")
