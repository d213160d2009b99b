"""Evaluation: classification and preference metrics, learning curves, calibration, intervals, tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotaforge.functions.expr import coin
from quotaforge.operators.audit import slope
from quotaforge.operators.order import global_rank


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def binary_metrics(rows: DataFrame, label: str, score: str, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Confusion counts at score > threshold and the usual ratios (0 on empty denominators)."""
    y, p = F.col(label) == 1, F.col(score) > threshold
    counts = rows.groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    return counts.select(
        *(by or []), "tp", "fp", "fn", "tn",
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((recall + specificity) / 2).alias("balanced_accuracy"),
        _ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"),
    )


def class_metrics(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class of labels or predictions: support, precision, recall and F1, and the accuracy and macro F1 of all."""
    y, p = F.col(label).cast("string"), F.col(prediction).cast("string")
    each = rows.select(F.inline(F.array(F.struct(y.alias("label"), F.lit(1).alias("is"), F.lit(0).alias("said")), F.struct(p.alias("label"), F.lit(0).alias("is"), F.lit(1).alias("said")))), (y == p).alias("_hit"))
    counts = each.groupBy("label").agg(F.sum("is").alias("support"), F.sum("said").alias("predicted"), F.sum(F.when(F.col("_hit"), F.col("is")).otherwise(0)).alias("hits"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f1 = _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    return counts.select(
        "label", "support", _ratio(F.col("hits"), F.col("predicted")).alias("precision"), _ratio(F.col("hits"), F.col("support")).alias("recall"), f1.alias("f1"),
        _ratio(F.sum("hits").over(every), F.sum("support").over(every)).alias("accuracy"), F.avg(f1).over(every).alias("macro_f1"),
    )


def group_accuracy(rows: DataFrame, group: str, label: str, prediction: str) -> DataFrame:
    """Accuracy per group, and the worst one."""
    found = rows.groupBy(F.col(group).alias("group")).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("worst", F.min("accuracy").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def length_controlled_win(rows: DataFrame, win: str, length_bin: str) -> DataFrame:
    """The plain mean of wins and the unweighted mean of the bins' means."""
    bins = rows.groupBy(length_bin).agg(F.avg(win).alias("m"), F.sum(win).alias("s"), F.count(win).alias("n"))
    return bins.agg((F.sum("s") / F.sum("n")).alias("raw_win_rate"), F.avg("m").alias("length_controlled_win_rate"))


def learning_curve_area(rows: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Trapezoid area over the largest y of each x, divided by the range of x; a single point gives its y."""
    points = rows.groupBy(F.col(by).alias("series"), F.col(x).cast("double").alias("x")).agg(F.max(y).alias("y"))
    w = Window.partitionBy("series").orderBy("x")
    steps = points.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    area = F.sum((F.col("x") - F.col("px")) * (F.col("y") + F.col("py")) / 2)
    return steps.groupBy("series").agg(F.coalesce(F.try_divide(area, F.max("x") - F.min("x")), F.max("y")).alias("aulc"))


def membership_calibration(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """Of (id, group, membership) tables: mean prediction, observation, error and Brier score per group; absent means 0."""
    both = predicted.select("id", "group", F.col("membership").alias("p")).join(observed.select("id", "group", F.col("membership").alias("o")), ["id", "group"], "full")
    p, o = F.coalesce("p", F.lit(0.0)), F.coalesce("o", F.lit(0.0))
    return both.groupBy("group").agg(F.avg(p).alias("predicted"), F.avg(o).alias("observed"), F.avg(p - o).alias("error"), F.avg((p - o) * (p - o)).alias("brier"))


def ensemble_intervals(draws: DataFrame, confidence: float) -> DataFrame:
    """Of (id, draw, group, membership): mean and the two quantiles per id and group."""
    tail = (1 - confidence) / 2
    return draws.groupBy("id", "group").agg(F.avg("membership").alias("mean"), F.percentile("membership", tail).alias("lower"), F.percentile("membership", 1 - tail).alias("upper"))


def interval_coverage(intervals: DataFrame, observed: DataFrame) -> DataFrame:
    """Share of observations inside their interval, by group and (null) over all."""
    both = intervals.join(observed.select("id", "group", F.col("membership").alias("o")), ["id", "group"])
    inside = (F.col("o") >= F.col("lower") - 1e-12) & (F.col("o") <= F.col("upper") + 1e-12)
    return both.rollup("group").agg(F.avg(inside.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def paired(rows: DataFrame, method: str, seed: str, metric: str, baseline: str, treatment: str) -> DataFrame:
    """(seed, base, treat) of the seeds that both methods have."""
    pick = lambda name: F.max(F.when(F.col(method) == name, F.col(metric)))
    return rows.groupBy(F.col(seed).cast("string").alias("seed")).agg(pick(baseline).alias("base"), pick(treatment).alias("treat")).filter("base is not null and treat is not null")


def poisson(u):
    """Poisson(1) counts, up to 6, from uniform numbers."""
    edges, term = [math.exp(-1)], math.exp(-1)
    for k in range(1, 6):
        term /= k
        edges.append(edges[-1] + term)
    return sum(F.when(u >= e, 1).otherwise(0) for e in edges)


def bootstrap_mean(rows: DataFrame, value: str, id_: str, by: list[str], resamples: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """Percentile bootstrap of the mean: each row is drawn a hash-seeded Poisson(1) number of times in each resample.

    Resamples are partial sums, so nothing but (sum, weight) per resample is shuffled.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_rep")
    drawn = rows.select(*by, F.col(value).cast("double").alias("_v"), F.col(id_).alias("_i"), rep)
    weight = poisson(coin(seed, F.col("_rep"), F.col("_i")))
    means = drawn.groupBy(*by, "_rep").agg(F.try_divide(F.sum(F.col("_v") * weight), F.sum(weight)).alias("_m"))
    tail = (1 - confidence) / 2
    found = means.groupBy(*by).agg(F.percentile("_m", tail).alias("lower"), F.percentile("_m", 1 - tail).alias("upper"))
    mean = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return mean.join(found, by) if by else mean.crossJoin(found)  # one row each without groups


def sign_flip_test(pairs: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Paired permutation test of (seed, base, treat): mean delta and p = (k + 1) / (R + 1) of hash-seeded sign flips."""
    rep = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("rep")
    flips = pairs.select((F.col("treat") - F.col("base")).alias("d"), "seed", rep)
    sign = F.when(coin(seed, F.col("rep"), F.col("seed")) < 0.5, -1.0).otherwise(1.0)
    means = flips.groupBy("rep").agg(F.avg(F.col("d") * sign).alias("m"), F.avg("d").alias("observed"))
    hit = F.abs(F.col("m")) >= F.abs(F.col("observed")) - 1e-12
    return means.agg(F.first("observed").alias("mean_delta"), ((F.count_if(hit) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def paired_delta(pairs: DataFrame, permutations: int, resamples: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """One row of (seed, base, treat): the mean delta, its bootstrap interval and the p-value of `sign_flip_test`."""
    spread = bootstrap_mean(pairs.select("seed", (F.col("treat") - F.col("base")).alias("d")), "d", "seed", [], resamples, seed, confidence)
    return sign_flip_test(pairs, permutations, seed).crossJoin(spread.select("n", "lower", "upper"))  # one row each


def capability_regression(rows: DataFrame, baseline: str, policy: str) -> DataFrame:
    """One row: the mean loss of the policy against the baseline, positive where the policy is worse."""
    return rows.agg(F.avg(F.col(baseline).cast("double") - F.col(policy).cast("double")).alias("capability_regression"), F.count(F.lit(1)).alias("n"))


def preference_metrics(rows: DataFrame, label: str, prediction: str, group: str, win: str, length_bin: str, baseline: str, policy: str) -> DataFrame:
    """One row: accuracy, that of the worst group, raw and length-controlled win rates, and the capability regression."""
    groups = group_accuracy(rows, group, label, prediction).agg((F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"), F.first("worst").alias("worst_group_accuracy"), F.sum("n").alias("n"))
    return groups.crossJoin(length_controlled_win(rows, win, length_bin)).crossJoin(capability_regression(rows, baseline, policy).drop("n"))  # one row each


def response_statistics(rows: DataFrame, setting: str, x: str, y: str) -> DataFrame:
    """Per setting: points and values of the intervention, ranges, Spearman correlation (average ranks) and least-squares slope.

    Ranks are taken in one range-sorted order by (setting, value); inside a setting they
    differ from its own ranks by a constant, which no correlation sees.
    """
    named = rows.select(F.col(setting).alias("setting"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for c in ("x", "y"):
        ranked = global_rank(named, [F.col("setting").asc_nulls_first(), F.col(c).asc_nulls_first()], "_at")
        mean = ranked.groupBy(F.col("setting").alias("_s"), F.col(c).alias("_v")).agg(F.avg("_at").alias(f"r{c}"))
        named = ranked.drop("_at").join(mean, F.col("setting").eqNullSafe(F.col("_s")) & F.col(c).eqNullSafe(F.col("_v"))).drop("_s", "_v")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    return named.groupBy("setting").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(F.covar_pop("rx", "ry"), spread), F.lit(0.0)).alias("spearman"), slope(F.col("x"), F.col("y")).alias("slope"),
        F.count_distinct("x").alias("values"), F.min("x").alias("least_x"), F.max("x").alias("most_x"), F.min("y").alias("least_y"), F.max("y").alias("most_y"),
    )


def slope_intervals(rows: DataFrame, setting: str, x: str, y: str, id_: str, resamples: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """Percentile bootstrap of each setting's slope; as in `bootstrap_mean`, only sums of each resample are shuffled.

    A setting of fewer than two points has the interval (0, 0).
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_rep")
    drawn = rows.select(F.col(setting).alias("setting"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(id_).alias("_i"), rep)
    w = poisson(coin(seed, F.col("_rep"), F.col("_i"))).cast("double")
    add = lambda v: F.sum(w * v)
    sums = drawn.groupBy("setting", "_rep").agg(F.sum(w).alias("w"), add(F.col("x")).alias("x"), add(F.col("y")).alias("y"), add(F.col("x") * F.col("y")).alias("xy"), add(F.col("x") * F.col("x")).alias("xx"), F.count(F.lit(1)).alias("n"))
    spread = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    one = F.when(spread > 1e-9 * F.col("w") * F.col("xx"), (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / spread).otherwise(0.0)
    tail = (1 - confidence) / 2
    pick = lambda q: F.when(F.max("n") < 2, 0.0).otherwise(F.percentile("_b", q))
    return sums.withColumn("_b", one).groupBy("setting").agg(pick(tail).alias("lower"), pick(1 - tail).alias("upper"), F.max("n").alias("n"))


def random_trajectories(rows: DataFrame, label: str, budgets: list[int], repetitions: int, seed: int) -> DataFrame:
    """(repetition, budget, label, pool, own): class counts of nested random selections of exactly each budget.

    The counts of a uniform selection without replacement follow the multivariate
    hypergeometric law, and a larger budget adds a draw from what is left, so only the pool's
    class counts (a row a class) reach the driver, never the rows.
    """
    pool = rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()
    size, steps = np.array([r["n"] for r in pool], np.int64), sorted(set(budgets))
    if not steps or steps[0] < 1 or steps[-1] > size.sum():
        raise ValueError(f"budgets lie between 1 and the pool's {size.sum()} rows")
    rng = np.random.default_rng(seed)
    out = []
    for rep in range(1, repetitions + 1):
        own = np.zeros_like(size)
        for before, budget in zip([0, *steps], steps, strict=False):
            own = own + rng.multivariate_hypergeometric(size - own, budget - before, method="marginals")
            out += [(rep, budget, r["label"], int(n), int(k)) for r, n, k in zip(pool, size, own, strict=True)]
    return rows.sparkSession.createDataFrame(out, "repetition int, budget long, label string, pool long, own long")


def _distances(trajectories: DataFrame) -> DataFrame:
    share = F.abs(F.col("pool") / F.sum("pool").over(Window.partitionBy("repetition", "budget")) - F.col("own") / F.col("budget"))
    return trajectories.withColumn("d", share).groupBy("repetition", "budget").agg((F.sum("d") / 2).alias("tv"))


def envelope(trajectories: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Per budget: mean, deviation and quantile of the total variation of random selections, and the quantile of the largest z of a trajectory."""
    tv = _distances(trajectories)
    law = tv.groupBy("budget").agg(F.avg("tv").alias("mean_tv"), F.stddev_pop("tv").alias("std_tv"), F.percentile("tv", quantile).alias("quantile_tv"), F.count("tv").alias("repetitions"))
    z = F.coalesce(F.try_divide(F.col("tv") - F.col("mean_tv"), F.col("std_tv")), F.lit(0.0))
    largest = tv.join(law.select("budget", "mean_tv", "std_tv"), "budget").groupBy("repetition").agg(F.max(z).alias("z")).agg(F.percentile("z", quantile).alias("largest_z"))
    return law.crossJoin(F.broadcast(largest))  # one row


def enrichment_envelope(trajectories: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Per budget and class: mean and quantile of the enrichment (selected over pool share) of random selections."""
    pool = F.col("pool") / F.sum("pool").over(Window.partitionBy("repetition", "budget"))
    each = trajectories.select("budget", "label", (F.col("own") / F.col("budget") / pool).alias("e"))
    return each.groupBy("budget", "label").agg(F.avg("e").alias("mean_enrichment"), F.percentile("e", quantile).alias("quantile_enrichment"))


def random_envelope(rows: DataFrame, id_: str, label: str, budget: int, repetitions: int, seed: int, quantile: float = 0.95) -> DataFrame:
    """Total variation of random selections of exactly `budget` rows: mean, deviation and quantile. `id_` is not needed for the law."""
    return envelope(random_trajectories(rows, label, [budget], repetitions, seed), quantile).select("mean_tv", "std_tv", "quantile_tv", "repetitions")


def metric_deltas(metrics: DataFrame, by: str, baseline: str) -> DataFrame:
    """(by, metric, value, delta): every number of a table with a row per model, less the baseline's."""
    names = [c for c, t in metrics.dtypes if c != by and t in ("double", "float", "int", "bigint")]
    long = metrics.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select(by, "x.*")
    base = long.filter(F.col(by) == baseline).select(F.col("metric").alias("_m"), F.col("value").alias("_v"))  # a row a metric
    return long.join(F.broadcast(base), F.col("metric") == F.col("_m"), "left").select(by, "metric", "value", (F.col("value") - F.col("_v")).alias("delta"))


def calibrated_shift(report: DataFrame, envelope: DataFrame, key: str, value: str) -> DataFrame:
    """`report` with its value's z score and its excess over the mean and upper quantile of random selections (`random_envelope`) of the same `key`.

    A spread of zero gives a z score of 0 at the mean, and null elsewhere.
    """
    law = envelope.select(F.col(key).alias("_k"), F.col("mean_tv").alias("_mean"), F.col("std_tv").alias("_std"), F.col("quantile_tv").alias("_upper"))
    off = F.col(value) - F.col("_mean")
    return (
        report.join(law, F.col(key).eqNullSafe(F.col("_k")), "left")
        .withColumn("z", F.when(F.col("_std") > 0, off / F.col("_std")).when(off == 0, 0.0))
        .withColumn("over_mean", off).withColumn("over_upper", F.col(value) - F.col("_upper")).drop("_k", "_mean", "_std", "_upper")
    )
