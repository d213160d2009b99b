"""Interventions on scores: what a fixed budget selects when a score is changed, replaced or swapped."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotaforge.operators.audit import correlation, every
from quotaforge.operators.choose import top_budget
from quotaforge.operators.order import average_rank, global_rank


def response_curve(rows: DataFrame, id_: str, group: str, settings: list[float], score: Callable[[float], Column], budget: int) -> DataFrame:
    """Per setting and group: pool and selected counts, propensity and selected share of the top `budget` rows by `score(setting)`.

    `settings` is a short list; each one narrows to its top rows without sorting the pool.
    """
    pool = rows.groupBy(F.col(group).cast("string").alias("group")).agg(F.count(F.lit(1)).alias("pool_count"))
    taken = None
    for s in settings:
        own = top_budget(rows.withColumn("_score", score(s)), "_score", id_, budget).select(F.lit(float(s)).alias("setting"), F.col(group).cast("string").alias("group"))
        taken = own if taken is None else taken.unionByName(own)
    counts = taken.groupBy("setting", "group").agg(F.count(F.lit(1)).alias("selected_count"))
    grid = pool.withColumn("setting", F.explode(F.array(*[F.lit(float(s)) for s in settings])))
    both = grid.join(counts.select(F.col("setting").alias("_s"), F.col("group").alias("_g"), "selected_count"), (F.col("setting") == F.col("_s")) & F.col("group").eqNullSafe(F.col("_g")), "left")
    own = F.coalesce("selected_count", F.lit(0))
    share = F.coalesce(F.try_divide(own.cast("double"), F.sum(own).over(Window.partitionBy("setting"))), F.lit(0.0))
    return both.select("setting", "group", "pool_count", own.alias("selected_count"), (own / F.col("pool_count")).alias("propensity"), share.alias("selected_share"))


def curve_slope(curve: DataFrame, group: str) -> DataFrame:
    """Least-squares slope of one group's propensity over the settings; 0 where it has none."""
    own = curve.filter(F.col("group") == group)
    return own.agg(F.lit(group).alias("group"), F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(F.covar_pop("setting", "propensity"), F.var_pop("setting")), F.lit(0.0)).alias("slope"))


def replacement(rows: DataFrame, id_: str, first: str, second: str, group: str, budget: int) -> DataFrame:
    """Two scores under one budget: overlap and Jaccard of the selections, rank correlation of all scores, total variation of groups."""
    a = top_budget(rows, first, id_, budget).select(F.col(id_).alias("_id"), F.col(group).alias("_g"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = top_budget(rows, second, id_, budget).select(F.col(id_).alias("_id"), F.col(group).alias("_g"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = a.unionByName(b).groupBy("_id", "_g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    groups = each.groupBy("_g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("both"), F.count(F.lit(1)).alias("any"))
    shares = groups.select("both", "any", (F.col("a") / F.sum("a").over(every()) - F.col("b") / F.sum("b").over(every())).alias("d"))
    sets = shares.agg(F.sum("both").alias("overlap"), (F.sum("both") / F.sum("any")).alias("jaccard"), (F.sum(F.abs("d")) / 2).alias("tv"))
    ranked = average_rank(average_rank(rows.select(first, second), first, "_ra"), second, "_rb")
    return sets.crossJoin(ranked.agg(correlation(F.col("_ra"), F.col("_rb")).alias("spearman")))  # one row each


def swap_summary(rows: DataFrame, pair: str, position: str, score: str) -> DataFrame:
    """Pairs of an original and a swapped row: their number, mean and largest absolute difference of scores, and their correlation."""
    side = lambda name: F.max(F.when(F.col(position) == name, F.col(score).cast("double")))
    both = rows.groupBy(pair).agg(side("original").alias("o"), side("swapped").alias("s")).filter("o is not null and s is not null")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.abs(F.col("o") - F.col("s"))).alias("mean_delta"), F.max(F.abs(F.col("o") - F.col("s"))).alias("max_delta"), correlation(F.col("o"), F.col("s")).alias("correlation"))


def _information(table: np.ndarray) -> np.ndarray:
    """Mutual information (nats) of the last two axes of counts."""
    p = table / table.sum(axis=(-2, -1), keepdims=True)
    m = p.sum(-1, keepdims=True) * p.sum(-2, keepdims=True)
    return (p * np.log(np.divide(p, m, out=np.ones_like(p), where=p > 0))).sum(axis=(-2, -1))


def group_dependence(rows: DataFrame, id_: str, score: str, group: str, bins: int, permutations: int, seed: int) -> DataFrame:
    """Mutual information of groups and equal-count score bins, its permutation mean and p = (k + 1) / (R + 1).

    Shuffling the groups over rows changes only the (group, bin) counts, whose law given
    both margins is a multivariate hypergeometric one. So replicates are drawn from that
    small table (groups x bins), and the rows are ranked once.
    """
    ranked = global_rank(rows.select(id_, score, group), [F.col(score).asc(), F.col(id_).cast("string").asc()], "_at")
    n = rows.count()
    at = F.least(F.lit(bins - 1), F.floor((F.col("_at") - 1) * bins / F.lit(max(n, 1)))).cast("int")
    counts = ranked.groupBy(F.col(group).cast("string").alias("g"), at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # groups x bins
    names = sorted({r["g"] for r in counts}, key=lambda g: (g is not None, g))
    table = np.zeros((len(names), bins), np.int64)
    for r in counts:
        table[names.index(r["g"]), r["b"]] = r["n"]
    if not n:
        return rows.sparkSession.createDataFrame([(0, 0.0, 0.0, 1.0)], "n long, mutual_information double, permuted_mean double, p_value double")
    draw, own = np.random.default_rng(seed), float(_information(table))
    left, permuted = np.tile(table.sum(0), (permutations, 1)), np.zeros((permutations, *table.shape), np.int64)
    for k, size in enumerate(table.sum(1)):
        for r in range(permutations):
            permuted[r, k] = draw.multivariate_hypergeometric(left[r], int(size), method="marginals")
        left -= permuted[:, k]
    other = _information(permuted)
    p = (int((other >= own - 1e-15).sum()) + 1) / (permutations + 1)
    return rows.sparkSession.createDataFrame([(n, own, float(other.mean()), p)], "n long, mutual_information double, permuted_mean double, p_value double")
