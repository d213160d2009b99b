"""Preference pairs: normalising raw pairs, log-probability audits, acquisition scores, candidates and matched utilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaforge.functions.expr import entropy, gradient_preference, length_bin, length_gap, reward_margin, word_count
from quotaforge.operators.audit import group_audit, numeric_shift, shift_summary, token_divergence
from quotaforge.operators.choose import best_of_groups, top_budget
from quotaforge.operators.order import cut, global_rank

#: Gaps nearer to zero than this count as no preference.
ZERO = 1e-12


def attribute_index(rows: DataFrame, keys: list[str], line: str, attributes: list[str]) -> DataFrame:
    """One row per key: the attributes of its last line."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(a).cast("double").alias(a) for a in attributes]), line).alias("_last"))
    return last.select(*keys, *[F.col("_last")[a].alias(a) for a in attributes])


def normalised_pairs(raw: DataFrame, index: DataFrame, attributes: list[str]) -> DataFrame:
    """id, prompt, response_1, response_2, preference_strength to rows with the preferred response, counts and both responses' attributes.

    The preferred response is 2 for a positive strength, 1 for a negative one and 0 for a tie; null stays null.
    """
    sign = F.signum("preference_strength")
    preferred = F.when(sign > 0, 2).when(sign < 0, 1).when(sign == 0, 0)
    out = raw.withColumn("preferred_response", preferred)
    for k in (1, 2):
        text = F.col(f"response_{k}")
        own = index.select(F.col("prompt").alias("_p"), F.col("response").alias("_r"), *[F.col(a).alias(f"{a}_{k}") for a in attributes])
        out = out.join(own, (F.col("prompt") == F.col("_p")) & (text == F.col("_r")), "left").drop("_p", "_r")
        out = out.withColumn(f"words_{k}", word_count(text)).withColumn(f"characters_{k}", F.coalesce(F.length(text), F.lit(0)).cast("long"))
    gap = length_gap(F.col("words_1"), F.col("words_2"))
    return out.withColumn("length_gap", gap).withColumn("length_bin", length_bin(gap))


def short_pairs(rows: DataFrame, most: int, first: str = "response_1", second: str = "response_2") -> DataFrame:
    """The pairs whose responses both have at most `most` words."""
    return rows.filter((word_count(F.col(first)) <= most) & (word_count(F.col(second)) <= most))


def log_gaps(rows: DataFrame, policy: tuple[str, str], reference: tuple[str, str]) -> DataFrame:
    """`rows` with policy_gap, reference_gap and implicit_gap (their difference); fails where a log probability is null or not finite."""
    for c in (*policy, *reference):
        value = F.col(c).cast("double")
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        rows = rows.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(value))
    gaps = rows.withColumn("policy_gap", F.col(policy[0]) - F.col(policy[1])).withColumn("reference_gap", F.col(reference[0]) - F.col(reference[1]))
    return gaps.withColumn("implicit_gap", F.col("policy_gap") - F.col("reference_gap"))


def log_gap_audit(gaps: DataFrame) -> DataFrame:
    """One row a gap: rows, mean, population variance, and how many are positive, negative or zero within `ZERO`."""
    names = ("policy_gap", "reference_gap", "implicit_gap")
    pair = F.explode(F.array(*[F.struct(F.lit(n).alias("gap"), F.col(n).alias("v")) for n in names])).alias("x")
    return gaps.select(pair).select("x.*").groupBy("gap").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"),
        F.count_if(F.col("v") > ZERO).alias("positive"), F.count_if(F.col("v") < -ZERO).alias("negative"), F.count_if(F.abs("v") <= ZERO).alias("zero"),
    )


def pair_scores(
    rows: DataFrame, tokens: Column, clusters: str | None = None, probability: str | None = None, entropy_weight: float = 1.0, novelty_weight: float = 0.0, by_length: bool = False
) -> DataFrame:
    """`rows` (with the gaps of `log_gaps`) and the label-free acquisition scores of a pair.

    - `reward_margin`: 1 where both responses are judged alike, 0 where one is sure to win
    - `prompt_entropy`: entropy of the prompt's cluster probabilities (0 without them)
    - `margin_entropy`: reward margin and weighted prompt entropy
    - `update_size`: distance of the policy's gap from the reference's, over the tokens if `by_length`, and weighted novelty
    - `cheap_gradient`: uncertainty over 1 + that distance, the filter before gradients are taken

    The probability that the first response wins is the sigmoid of the implicit gap, clamped
    at 60, where that is not null, else the column `probability`, if given.
    """
    clamped = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("implicit_gap")))
    margin = reward_margin(clamped)
    if probability:
        margin = F.coalesce(margin, 1 - F.abs(2 * F.col(probability) - 1))
    spread = F.coalesce(entropy(F.col(clusters)), F.lit(0.0)) if clusters else F.lit(0.0)
    distance = F.abs("implicit_gap")
    size = distance / F.greatest(tokens, F.lit(1)) if by_length else distance
    return (
        rows.withColumn("reward_margin", margin).withColumn("prompt_entropy", spread)
        .withColumn("margin_entropy", F.col("reward_margin") + entropy_weight * F.col("prompt_entropy"))
        .withColumn("update_size", size + novelty_weight * F.col("prompt_entropy"))
        .withColumn("cheap_gradient", F.col("reward_margin") / (1 + distance))
    )


def preference_shift(rows: DataFrame, numbers: dict[str, str], prompt: str, direction: str = "preferred_response", selected: str = "selected") -> DataFrame:
    """Long report (domain, field, statistic, value) of how a selection of pairs shifts.

    `numbers` maps numeric columns to their domain (such as length, attributes or scoring);
    directions are compared as categories, prompts by their words.
    """
    long = lambda frame, names: frame.select("domain", "field", F.inline(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in names])))
    domain = F.create_map(*[F.lit(x) for c, d in numbers.items() for x in (c, d)])
    shifts = numeric_shift(rows, list(numbers), selected).withColumn("domain", domain[F.col("field")])
    out = long(shifts, ["pool_count", "selected_count", "pool_mean", "selected_mean", "mean_delta", "pool_median", "selected_median"])
    kinds = rows.withColumn("_kind", F.coalesce(F.col(direction).cast("string"), F.lit("0")))
    tv = shift_summary(group_audit(kinds, ["_kind"], selected)).withColumn("domain", F.lit("preference_direction")).withColumn("field", F.lit(direction))
    words = token_divergence(rows.withColumn("_words", F.coalesce(F.col(prompt), F.lit(""))), "_words", selected).withColumn("domain", F.lit("prompt_distribution")).withColumn("field", F.lit(prompt))
    return out.unionByName(long(tv, ["tv"])).unionByName(long(words, ["js", "vocabulary"]))


def preference_effects(report: DataFrame) -> DataFrame:
    """(domain, effect) of `preference_shift`: the largest relative length change, the largest other mean change, the divergences."""
    wide = report.groupBy("domain", "field").pivot("statistic", ["mean_delta", "pool_mean", "tv", "js"]).agg(F.first("value"))
    moved = F.abs(F.coalesce("mean_delta", F.lit(0.0)))
    effect = (
        F.when(F.col("domain") == "length", moved / F.greatest(F.abs(F.coalesce("pool_mean", F.lit(0.0))), F.lit(1.0)))
        .when(F.col("domain") == "preference_direction", F.abs("tv")).when(F.col("domain") == "prompt_distribution", F.abs("js")).otherwise(moved)
    )
    return wide.groupBy("domain").agg(F.max(F.coalesce(effect, F.lit(0.0))).alias("effect"))


def pair_groups(rows: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with the group fields that can be derived: length_gap_bin, prompt_cluster and length_by_prompt_cluster.

    A field's own value comes first; then the bin of length_gap, or that of the texts
    response_a and response_b, and prompt_cluster_id. A required field that a row lacks is an error.
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    gap = has("length_gap").cast("double")
    if {"response_a", "response_b"} <= set(rows.columns):
        own = length_gap(word_count(F.col("response_a")), word_count(F.col("response_b")))
        gap = F.coalesce(gap, F.when(F.col("response_a").isNotNull() & F.col("response_b").isNotNull(), own))
    bin_ = F.coalesce(has("length_gap_bin").cast("string"), F.when(gap.isNotNull(), length_bin(gap)))
    cluster = F.coalesce(has("prompt_cluster").cast("string"), has("prompt_cluster_id").cast("string"))
    both = F.coalesce(has("length_by_prompt_cluster").cast("string"), F.when(bin_.isNotNull() & cluster.isNotNull(), F.concat_ws("|", bin_, cluster)))
    out = rows.withColumns({"length_gap_bin": bin_, "prompt_cluster": cluster, "length_by_prompt_cluster": both})
    for field in required:
        out = out.withColumn(field, F.when(F.col(field).isNull(), F.raise_error(F.lit(f"a row lacks the group field {field}")).cast("string")).otherwise(F.col(field)))
    return out


def covering_candidates(rows: DataFrame, score: str, id_: str, budget: int, multiplier: int, coverage: list[str]) -> DataFrame:
    """`multiplier * budget` rows: first the best row of every value of each coverage column, then the best others."""
    first = None
    for c in coverage:
        best = best_of_groups(rows.filter(F.col(c).isNotNull() & F.col(score).isNotNull()), score, id_, c).select(F.col(id_).alias("_first"))
        first = best if first is None else first.unionByName(best)
    flagged = rows.withColumn("covers", F.lit(False))
    if first is not None:
        flagged = rows.join(first.distinct(), F.col(id_) == F.col("_first"), "left").withColumn("covers", F.col("_first").isNotNull()).drop("_first")
    flagged = cut(flagged)
    wanted = multiplier * budget
    sure = top_budget(flagged.filter("covers"), score, id_, wanted)
    left = wanted - sure.count()
    return sure if left < 1 else sure.unionByName(top_budget(flagged.filter("not covers"), score, id_, left))


def gradient_scores(candidates: DataFrame, norms: DataFrame, id_: str, tokens: str) -> DataFrame:
    """Candidates with their final utility, from gradient norms that a model run has written; a candidate without one fails."""
    joined = candidates.join(norms.select(F.col(id_).alias("_id"), "gradient_norm"), F.col(id_) == F.col("_id"), "left").drop("_id")
    norm = F.when(F.col("gradient_norm").isNull(), F.raise_error(F.lit("a candidate has no gradient norm")).cast("double")).otherwise(F.col("gradient_norm"))
    return joined.withColumn("utility", gradient_preference(F.col("cheap_gradient"), norm, F.col(tokens)))


def utility_profile(rows: DataFrame, utility: str, bins: int) -> DataFrame:
    """Mean utility of `bins` runs of the sorted rows; run k starts at k * n / bins, halves rounded to even."""
    usable = rows.filter(F.col(utility).isNotNull()).select(F.col(utility).cast("double").alias("u"))
    n = usable.count()
    if not 1 <= bins <= n:
        raise ValueError(f"{n} utilities cannot fill {bins} bins")
    starts = [round(k * n / bins) for k in range(1, bins)]
    bin_ = sum((F.when(F.col("_rank") > s, 1).otherwise(0) for s in starts), F.lit(0))
    ranked = global_rank(usable, [F.col("u").asc()], "_rank")
    return ranked.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("mean")).withColumn("midpoint", (F.col("bin") + 0.5) / bins)


def coverage_deviation(observed: DataFrame, target: DataFrame) -> DataFrame:
    """Half the sum of absolute differences of (group, value) tables, absent groups counting 0."""
    both = observed.select("group", F.col("value").alias("o"), F.lit(0.0).alias("t")).unionByName(target.select("group", F.lit(0.0).alias("o"), F.col("value").alias("t")))
    each = both.groupBy("group").agg(F.abs(F.sum("o") - F.sum("t")).alias("d"))
    return each.agg((F.coalesce(F.sum("d"), F.lit(0.0)) / 2).alias("deviation"))


def matched_utility(baseline: DataFrame, treatment: DataFrame, utility: str, bins: int = 4, mean_tolerance: float = 0.02, bin_tolerance: float = 0.05) -> DataFrame:
    """One row: difference of the means, largest difference of a bin's mean, and whether both are tolerable."""
    one, two = (utility_profile(r, utility, bins).select("bin", F.col("n").alias(f"n_{k}"), F.col("mean").alias(f"mean_{k}")) for k, r in (("b", baseline), ("t", treatment)))
    mean = lambda k: F.sum(F.col(f"n_{k}") * F.col(f"mean_{k}")) / F.sum(f"n_{k}")
    row = one.join(two, "bin").agg((mean("t") - mean("b")).alias("mean_delta"), F.max(F.abs(F.col("mean_t") - F.col("mean_b"))).alias("largest_bin_delta"))
    return row.withColumn("matched", (F.abs("mean_delta") <= mean_tolerance) & (F.col("largest_bin_delta") <= bin_tolerance))
