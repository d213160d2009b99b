"""Random selections of exactly B rows whose law is known: within bounds on group shares, and with given inclusion probabilities.

Uniform draws of B rows within bounds fall into two steps. How many rows each group gives
follows from the sizes of the groups alone, so it is drawn on the driver from one number a
group; which rows those are is a seeded hash, ranked inside the groups.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotaforge.functions.expr import coin, seeded
from quotaforge.operators.choose import Infeasible
from quotaforge.operators.order import cut, rank_in_groups

#: Slip of sums of shares and of probabilities.
SLIP = 1e-9
#: Moves of the chain over overlapping groups for each row of the budget and doubling of it.
MOVES = 6


def _law(size: int, odds: float, low: int, high: int) -> tuple[int, np.ndarray]:
    """First count and probabilities of Binomial(size, odds / (1 + odds)) held to [low, high]; tails below 1e-30 are left out."""
    p = odds / (1 + odds)
    middle = min(max(int((size + 1) * p), low), high)
    reach = int(12 * math.sqrt(size * p * (1 - p))) + 60
    first, last = max(low, middle - reach), min(high, middle + reach)
    k = np.arange(first, last, dtype=float)
    steps = np.concatenate([[0.0], np.cumsum(np.log((size - k) / (k + 1)) + math.log(odds))])  # log ratios of neighbours
    weights = np.exp(steps - steps.max())
    return first, weights / weights.sum()


def _convolved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if min(len(a), len(b)) < 512:
        return np.convolve(a, b)
    n = len(a) + len(b) - 1
    return np.maximum(np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n), 0.0)


def draw_counts(sizes: list[int], low: list[int], high: list[int], budget: int, seed: int) -> list[int]:
    """How many rows each group gives in a uniform draw of `budget` rows, given that group g gives low[g] to high[g].

    That is the multivariate hypergeometric law restricted to the bounds. It equals the law
    of independent binomials of equal odds, each held to its bounds, given their sum; the
    odds are set so that the expected sum is the budget, the partial sums are convolved and
    the counts are drawn from the last group back. Time grows with the groups and with the
    square root of the budget, not with the rows.
    """
    low = [max(0, x) for x in low]
    high = [min(n, x) for n, x in zip(sizes, high, strict=True)]
    if any(a > b for a, b in zip(low, high, strict=True)) or not sum(low) <= budget <= sum(high):
        raise Infeasible("no selection keeps all groups within the tolerance")
    free = [g for g in range(len(sizes)) if low[g] < high[g]]
    counts, rest = list(low), budget - sum(low[g] for g in range(len(sizes)) if low[g] == high[g])
    if rest == sum(low[g] for g in free):
        return counts
    if rest == sum(high[g] for g in free):
        return list(high)
    below, above = -60.0, 60.0  # log odds
    for _ in range(80):
        middle = (below + above) / 2
        laws = [_law(sizes[g], math.exp(middle), low[g], high[g]) for g in free]
        mean = sum(first + float(np.arange(len(p)) @ p) for first, p in laws)
        below, above = (middle, above) if mean < rest else (below, middle)
        if above - below < 1e-9 or abs(mean - rest) < 1e-6:
            break
    sums = [(0, np.ones(1))]
    for first, p in laws:
        sums.append((sums[-1][0] + first, _convolved(sums[-1][1], p)))
    random = np.random.default_rng([seed & 0xFFFFFFFF, budget])
    for g, (first, p), (start, before) in reversed(list(zip(free, laws, sums[:-1], strict=True))):
        at = rest - first - np.arange(len(p)) - start  # places of what the groups before must give
        fits = (at >= 0) & (at < len(before))
        weights = np.where(fits, p * before[np.clip(at, 0, len(before) - 1)], 0.0)
        counts[g] = first + int(random.choice(len(p), p=weights / weights.sum()))
        rest -= counts[g]
    return counts


def walk_counts(sizes: np.ndarray, member: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, seed: int, moves: int) -> np.ndarray:
    """Counts of each cell after `moves` steps of a chain whose law tends to that of a uniform subset within bounds.

    A cell holds the rows of equal memberships (`member`: cells x groups), and `start` must fit. A step proposes
    to swap a uniform selected row with a uniform other one, which only the counts see, and
    stays where a bound would break: proposals are symmetric over subsets, so the uniform law
    on the subsets that swaps can reach is kept.
    """
    random = np.random.default_rng([seed & 0xFFFFFFFF, int(start.sum()), moves])
    taken, left = start.astype(np.int64).copy(), (sizes - start).astype(np.int64)
    sums = taken @ member
    if not left.sum() or not taken.sum():
        return taken
    for u, v in random.random((moves, 2)):
        out = int(np.searchsorted(np.cumsum(taken), u * taken.sum(), side="right"))
        into = int(np.searchsorted(np.cumsum(left), v * left.sum(), side="right"))
        if out != into:
            after = sums - member[out] + member[into]
            if (after <= high + SLIP).all() and (after >= low - SLIP).all():
                taken[out] -= 1
                taken[into] += 1
                left[out] += 1
                left[into] -= 1
                sums = after
    return taken


def rows_of_cells(rows: DataFrame, id_: str, cell: str, counts: dict[str, int], sizes: dict[str, int], seed: int) -> DataFrame:
    """`counts[c]` rows of each cell: those of least seeded hash. `rows` is scanned for rows below a hash bound that holds more than enough.

    The bound lets through about as many rows as are wanted, so only those are ranked; where it should
    let through too few (odds below 1e-12), all rows are.
    """
    spark = rows.sparkSession
    share = lambda c: (counts[c] + 8 * math.sqrt(counts[c]) + 40) / sizes[c] if counts[c] else 0.0
    table = spark.createDataFrame([(c, counts[c], share(c)) for c in counts if counts[c]], "_cell string, _count long, _share double")  # one row a cell
    wanted = rows.join(F.broadcast(table) if len(counts) <= 10_000 else table, F.col(cell) == F.col("_cell"))
    near = wanted.filter(coin(seed, F.col(id_)) < F.col("_share"))
    got = {r["_cell"]: r["n"] for r in near.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = near if all(got.get(c, 0) >= n for c, n in counts.items()) else wanted
    ranked = rank_in_groups(held, "_cell", [seeded(seed, F.col(id_)), F.col(id_).cast("string")], "_place")
    return ranked.filter(F.col("_place") <= F.col("_count")).drop("_cell", "_count", "_share", "_place")


def limits(target: float, tolerance: float, budget: int) -> tuple[int, int]:
    """Least and most rows of a group of `target` whose share of the budget lies within `tolerance`."""
    slip = SLIP * budget
    return max(0, math.ceil(budget * (target - tolerance) - slip)), math.floor(budget * (target + tolerance) + slip)


def systematic(rows: DataFrame, probability: str, id_: str, budget: int, seed: int | None = None) -> DataFrame:
    """Exactly `budget` rows, each with a probability in proportion to `probability`: the marks u, u + 1, ... over its running sum.

    Probabilities are scaled to a sum of `budget`; rows that reach 1 are taken for sure and
    the rest is scaled again, until none does. Rows stand in the order of the id's string,
    cut into ranges; each range sums its own rows and starts where the range before ends, so
    no task sees more than a range and every mark falls into one row. Rows with a null, NaN
    or no positive probability are never taken; where fewer than `budget` have one, that is
    an error. u is seeded, or a half without a seed. All columns are kept; ids must be unique.
    """
    if budget < 1:
        raise ValueError("a budget selects at least one row")
    p = F.col(probability).cast("double")
    usable = rows.filter(p.isNotNull() & ~F.isnan(p) & (p > 0))
    sure, left = float("inf"), budget
    while True:  # each round takes more rows for sure; what remains is a sum and a count
        row = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if(p >= sure).alias("sure"), F.sum(F.when(p < sure, p)).alias("rest")).first()
        if row["n"] < budget:
            raise ValueError(f"{row['n']} rows of positive probability cannot give {budget}")
        left = budget - row["sure"]
        if left <= 0 or row["rest"] is None:
            left = 0
            break
        bar = row["rest"] / left * (1 - SLIP)
        if bar >= sure or not usable.filter((p >= bar) & (p < sure)).limit(1).count():
            break
        sure = bar
    certain = usable.filter(p >= sure)
    if not left:
        return certain
    others = usable.filter(p < sure)
    key = F.col(id_).cast("string")
    placed = cut(others.select(F.struct("*").alias("_row"), p.alias("_p"), key.alias("_key")).repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_part", F.spark_partition_id()))
    ends, at = {}, 0.0
    for r in placed.groupBy("_part").agg(F.sum("_p").alias("s")).orderBy("_part").collect():  # one row a range
        ends[r["_part"]] = (at, at + r["s"])
        at += r["s"]
    table = placed.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in ends.items()], "_range int, _from double, _to double")
    u = 0.5 if seed is None else float(np.random.default_rng(seed & 0xFFFFFFFF).random())
    own = Window.partitionBy("_part").orderBy("_key")
    # A row ends at the least of its running sum and its range's end, the last row at the range's end itself: rows tile the line.
    running = F.when(F.lead("_key").over(own).isNull(), F.col("_to")).otherwise(F.least(F.col("_from") + F.sum("_p").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_to")))
    tiled = placed.join(F.broadcast(table), F.col("_part") == F.col("_range")).withColumn("_end", running)
    tiled = tiled.withColumn("_start", F.coalesce(F.lag("_end").over(own), F.col("_from")))
    marks = lambda c: F.ceil(F.when(F.col(c) >= at, F.lit(float(left))).otherwise(F.col(c) * left / at) - u)
    return certain.unionByName(tiled.filter(marks("_end") > marks("_start")).select("_row.*"))
