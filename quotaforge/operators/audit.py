"""Audits of how a selection shifts groups, numbers and words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotaforge.operators.order import cut, rank_in_groups


def every():
    """The window of all rows; made when used, as it needs a session."""
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def group_audit(rows: DataFrame, fields: list[str], selected: str = "selected") -> DataFrame:
    """Per field and group: counts, shares, propensity, predicted and actual share of the selection, and their error.

    All fields are audited in one aggregation; only one row per group is looked at afterwards.
    A selection without rows has no shares: it is an error.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("group")) for f in fields])
    each = rows.select(F.inline(pairs), F.col(selected).cast("boolean").alias("_s"))
    counts = each.groupBy("field", "group").agg(F.count(F.lit(1)).alias("pool_count"), F.count_if("_s").alias("selected_count"))
    whole = Window.partitionBy("field").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pool, taken = F.sum("pool_count").over(whole), F.sum("selected_count").over(whole)
    out = counts.select(
        "field", "group", "pool_count", "selected_count",
        (F.col("pool_count") / pool).alias("pool_share"),
        (F.col("selected_count") / F.col("pool_count")).alias("propensity"),
        F.when(taken == 0, F.raise_error(F.lit("the selection has no rows")).cast("double")).otherwise(F.col("selected_count") / taken).alias("selected_share"),
        F.coalesce(F.try_divide(taken, pool), F.lit(0.0)).alias("_rate"),
    )
    predicted = F.coalesce(F.try_divide(F.col("pool_share") * F.col("propensity"), F.col("_rate")), F.lit(0.0))
    return out.withColumn("predicted_share", predicted).withColumn("share_error", F.abs(F.col("predicted_share") - F.col("selected_share"))).drop("_rate")


def shift_summary(audit: DataFrame) -> DataFrame:
    """Per field: total variation, Jensen-Shannon divergence, largest propensity ratio (over positive ones, else 0), worst coverage, error."""
    p, q = F.col("pool_share"), F.col("selected_share")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    positive = F.when(F.col("propensity") > 0, F.col("propensity"))
    return audit.groupBy("field").agg(
        (F.sum(F.abs(p - q)) / 2).alias("tv"),
        ((F.sum(part(p)) + F.sum(part(q))) / 2).alias("js"),
        F.coalesce(F.try_divide(F.max(positive), F.min(positive)), F.lit(0.0)).alias("max_propensity_ratio"),
        F.min(q / p).alias("worst_coverage"),
        F.sum("share_error").alias("identity_error"),
    )


def class_shift(rows: DataFrame, label: str, selected: str = "selected") -> DataFrame:
    """Per class: shares, signed shift and enrichment (selected over pool share)."""
    found = group_audit(rows, [label], selected)
    return found.select(
        F.col("group").alias("label"), "pool_count", "selected_count", "pool_share", "selected_share",
        (F.col("selected_share") - F.col("pool_share")).alias("shift"),
        (F.col("selected_share") / F.col("pool_share")).alias("enrichment"),
    )


def numeric_shift(rows: DataFrame, fields: list[str], selected: str = "selected") -> DataFrame:
    """Per field: counts, means and medians of pool and selection, nulls skipped.

    Medians come from ranks of range-sorted values, so no task holds a whole field.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    each = rows.select(F.inline(pairs), F.col(selected).cast("boolean").alias("_s")).filter("value is not null")
    own = F.when(F.col("_s"), F.col("value"))
    each = cut(each)
    means = each.groupBy("field").agg(
        F.count("value").alias("pool_count"), F.count(own).alias("selected_count"),
        F.avg("value").alias("pool_mean"), F.avg(own).alias("selected_mean"),
        (F.avg(own) - F.avg("value")).alias("mean_delta"),
    )
    middle = _medians(each, means, "pool").join(_medians(each.filter("_s"), means, "selected"), "field", "left")
    return means.join(middle, "field").select("field", "pool_count", "selected_count", "pool_mean", "selected_mean", "pool_median", "selected_median", "mean_delta")


def _medians(each: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """(field, `name`_median): the mean of the one or two values in the middle of each field."""
    n = counts.select(F.col("field").alias("_f"), F.col(f"{name}_count").alias("_n"))  # a row a field
    ranked = rank_in_groups(each.select("field", "value"), "field", [F.col("value")], "_r").join(F.broadcast(n), F.col("field") == F.col("_f"))
    middle = ranked.filter((F.col("_r") >= F.floor((F.col("_n") + 1) / 2)) & (F.col("_r") <= F.ceil((F.col("_n") + 1) / 2)))
    return middle.groupBy("field").agg(F.avg("value").alias(f"{name}_median"))


def token_shift(rows: DataFrame, text: str, selected: str = "selected", top: int = 20) -> DataFrame:
    """The `top` words most enriched and depleted in the selection, by the log ratio of smoothed shares (a report)."""
    from quotaforge.functions.expr import lower_tokens

    words = rows.select(F.explode(lower_tokens(F.col(text))).alias("token"), F.col(selected).cast("boolean").alias("_s"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("pool_count"), F.count_if("_s").alias("selected_count"))
    total = counts.agg(F.sum("pool_count").alias("_p"), F.sum("selected_count").alias("_q"))
    share = counts.join(F.broadcast(total)).select(  # one row
        "token", "pool_count", "selected_count",
        F.ln((F.coalesce(F.try_divide("selected_count", "_q"), F.lit(0.0)) + 1e-12) / (F.col("pool_count") / F.col("_p") + 1e-12)).alias("log_ratio"),
    )
    up = share.orderBy(F.desc("log_ratio"), "token").limit(top).withColumn("direction", F.lit("enriched"))
    down = share.orderBy("log_ratio", "token").limit(top).withColumn("direction", F.lit("depleted"))
    return up.unionByName(down)


def token_divergence(rows: DataFrame, text: str, selected: str = "selected") -> DataFrame:
    """Jensen-Shannon divergence of the words of pool and selection, and the number of words."""
    from quotaforge.functions.expr import lower_tokens

    words = rows.select(F.explode(lower_tokens(F.col(text))).alias("token"), F.col(selected).cast("boolean").alias("_s"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("a"), F.count_if("_s").alias("b"))
    total = counts.agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"), F.count(F.lit(1)).alias("vocabulary"))
    p, q = F.col("a") / F.col("_a"), F.coalesce(F.try_divide("b", "_b"), F.lit(0.0))
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return counts.join(F.broadcast(total)).groupBy("vocabulary").agg(((F.sum(part(p)) + F.sum(part(q))) / 2).alias("js"))


def mutual_information(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Mutual information (nats) of two columns and the entropies, from their joint counts."""
    joint = rows.groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").over(every())
    by = lambda c: F.sum("n").over(Window.partitionBy(c))
    shares = joint.select((F.col("n") / n).alias("p"), (by("l") / n).alias("pl"), (by("r") / n).alias("pr"))
    return shares.agg(
        F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pl") * F.col("pr")))).alias("mutual_information"),
        (-F.sum(F.col("p") * F.ln("pl"))).alias("left_entropy"),
        (-F.sum(F.col("p") * F.ln("pr"))).alias("right_entropy"),
    )


def expected_coverage(memberships: DataFrame, selected: str = "selected") -> DataFrame:
    """Of (id, group, membership, selected) rows: mean membership in pool and selection per group, and half the summed deviation."""
    sums = memberships.groupBy("group").agg(F.avg("membership").alias("target"), F.avg(F.when(F.col(selected), F.col("membership"))).alias("observed"))
    return sums.select("group", "target", "observed", (F.sum(F.abs(F.col("observed") - F.col("target"))).over(every()) / 2).alias("coverage_deviation"))


def correlation(x, y):
    """Pearson; 0 without variance."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def slope(x, y):
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0))


def score_audit(rows: DataFrame, score: str, length: str) -> DataFrame:
    """Range, mean and variance of scores, whether they are all alike, and their correlation with a length."""
    return rows.agg(
        F.count(score).alias("n"), F.min(score).alias("least"), F.max(score).alias("most"), F.avg(score).alias("mean"), F.var_pop(score).alias("variance"),
        (F.max(score) == F.min(score)).alias("degenerate"), correlation(F.col(score), F.col(length)).alias("length_correlation"),
    )


def established_shifts(report: DataFrame, classes: DataFrame, least_tv: float = 0.02, least_enrichment: float = 0.1, budgets: int = 2) -> DataFrame:
    """Per method: mean excess TV, budgets that reach `least_tv`, classes enriched at `budgets` or more of those, and whether both hold.

    `report`: method, budget, tv_excess; `classes`: method, budget, class, enrichment_excess (both over random selection).
    """
    reached = report.filter(F.col("tv_excess") >= least_tv).select("method", "budget")
    stable = (
        classes.filter(F.col("enrichment_excess") >= least_enrichment).join(reached, ["method", "budget"]).groupBy("method", "class")
        .agg(F.count_distinct("budget").alias("n")).filter(F.col("n") >= budgets).groupBy("method").agg(F.array_sort(F.collect_set("class")).alias("stable_classes"))
    )
    means = report.groupBy("method").agg(F.avg("tv_excess").alias("mean_tv_excess"), F.count_if(F.col("tv_excess") >= least_tv).alias("budgets_reached"))
    out = means.join(stable, "method", "left").withColumn("stable_classes", F.coalesce("stable_classes", F.array().cast("array<string>")))
    return out.withColumn("established", (F.col("budgets_reached") >= budgets) & (F.size("stable_classes") > 0))


def recommended_method(shifts: DataFrame, preferred: str = "entropy", comparable: float = 0.02) -> DataFrame:
    """One row, or none without an established method: the largest mean excess, but `preferred` where it is within `comparable` of that."""
    sure = shifts.filter("established")
    top = sure.agg(F.max("mean_tv_excess").alias("_top"))
    near = sure.crossJoin(F.broadcast(top)).withColumn("_first", (F.col("method") == preferred) & (F.col("_top") - F.col("mean_tv_excess") <= comparable))  # `top` is one row
    return near.orderBy(F.desc("_first"), F.desc("mean_tv_excess"), F.desc(F.size("stable_classes")), F.desc("method")).limit(1).select("method", "mean_tv_excess", "stable_classes")


#: Domains of preference shifts that count, and the effect from which each is material.
MATERIAL = {"length": 0.10, "attributes": 0.25, "preference_direction": 0.05, "prompt_distribution": 0.01}


def preference_gate(effects: DataFrame, required: int = 2, material: dict[str, float] = MATERIAL) -> DataFrame:
    """Per method: its material domains, their effects over the thresholds summed, and whether `required` domains are material.

    `effects`: method, domain, effect, and `excess` over the upper quantile of random
    selections (null where none were drawn: the effect alone decides). Random itself and
    other domains are left out.
    """
    if required < 1:
        raise ValueError("at least one domain is required")
    bar = F.create_map(*[x for d, v in material.items() for x in (F.lit(d), F.lit(float(v)))])
    known = effects.filter(F.col("method") != "random").withColumn("_bar", F.try_element_at(bar, F.col("domain")))
    counts = F.coalesce((F.col("effect") >= F.col("_bar")) & (F.coalesce("excess", F.lit(1.0)) > 0), F.lit(False))
    out = known.groupBy("method").agg(
        F.array_sort(F.collect_set(F.when(counts, F.col("domain")))).alias("material_domains"),  # at most one entry a domain
        F.coalesce(F.sum(F.when(counts, F.col("effect") / F.col("_bar"))), F.lit(0.0)).alias("gate_score"),
    )
    return out.withColumn("established", F.size("material_domains") >= required)


def preference_decision(gates: DataFrame, disagreement: float | None, bias: float = 0.20) -> DataFrame:
    """One row: whether a shift is established, the method of largest gate score among those, the warning of position bias, and the next step.

    `disagreement` is the pool's mean disagreement between the two orders of a pair; from `bias` on, scoring comes first.
    """
    order = F.struct("gate_score", F.size("material_domains"), "method")
    row = gates.agg(F.coalesce(F.bool_or("established"), F.lit(False)).alias("established"), F.max(F.when(F.col("established"), order)).alias("_best"))
    warned = F.lit(disagreement is not None and disagreement >= bias)
    step = F.when(warned, "repair_pairwise_scoring_first").when(F.col("established"), "run_random_vs_uncertainty_dpo").otherwise("collect_more_preference_evidence")
    return row.select("established", F.col("_best")["method"].alias("method"), warned.alias("position_bias_warning"), (F.col("established") & ~warned).alias("training_ready"), step.alias("next_step"))


def recommended_action(cases: DataFrame, drop: float = 0.01, repaired: float = 0.05) -> DataFrame:
    """`cases` with `recommendation`: the first rule that holds.

    Columns: classification_established, preference_established, position_bias (booleans, null:
    no), order_delta (change of order disagreement by training, null: unknown), and
    accuracy_delta, macro_f1_delta and preference_delta, uncertainty less random after training
    (all of a task null: not compared yet). A loss of `drop` or more is an underperformance.
    """
    if drop < 0:
        raise ValueError("drop must not be negative")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    lost = lambda *names: F.coalesce(F.least(*[F.coalesce(n, F.lit(0.0)) for n in names], F.lit(0.0)) <= -drop, F.lit(False))
    by_class, by_pair = yes("classification_established"), yes("preference_established")
    open_ = (by_class & F.col("accuracy_delta").isNull() & F.col("macro_f1_delta").isNull()) | (by_pair & F.col("preference_delta").isNull())
    worse_class, worse_pair = by_class & lost("accuracy_delta", "macro_f1_delta"), by_pair & lost("preference_delta")
    rules = (
        (yes("position_bias") & F.coalesce(F.col("order_delta") > -repaired, F.lit(True)), "repair_pairwise_scoring_first"),
        (~by_class & ~by_pair, "keep_current_algorithm"),
        (open_, "defer_algorithm_change_until_training"),
        (worse_class & worse_pair, "restructure_algorithm"),
        (worse_pair, "introduce_wsr"),
        (worse_class, "refine_dcms_constraints"),
    )
    return cases.withColumn("recommendation", F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in rules], F.lit("keep_current_algorithm_with_monitoring")))
