"""What random selections of a pool of pairs do to its domains: many selections of exactly B rows from two scans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaforge.functions.expr import lower_tokens
from quotaforge.operators.order import cut

#: Standard deviations on both sides of the expected edge within which a repetition's last row is looked for first.
REACH = 6.0


def _uniform(id_: str, seed: int, repetition: Column) -> Column:
    """A whole number below 2^62 that is the same for a row and repetition on any cluster."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_).cast("string"), F.lit(seed), repetition), 2)


def thresholds(rows: DataFrame, id_: str, budget: int, repetitions: int, seed: int) -> list[int]:
    """Per repetition the hash of its last row, so that exactly `budget` rows (of unique ids) lie at or below it.

    Hashes are uniform, so the edge lies within a few square roots of the budget of where it is expected:
    one scan counts the rows below that band and keeps the hashes inside it, which a task
    per repetition sorts. A band that misses an edge is doubled for all.
    """
    n = rows.count()
    if not 1 <= budget <= n or repetitions < 1:
        raise ValueError(f"{n} rows cannot give {budget} rows {repetitions} times")
    share, reach = budget / n, REACH * math.sqrt(budget * (n - budget) / n + 1) / n
    every = F.sequence(F.lit(0), F.lit(repetitions - 1))
    while True:
        low, high = (int(min(max(x, 0.0), 1.0) * 2**62) for x in (share - reach, share + reach))
        near = rows.select(F.explode(F.filter(F.transform(every, lambda r: F.struct(r.alias("r"), _uniform(id_, seed, r).alias("u"))), lambda x: x["u"] < F.lit(high))).alias("x"))
        bands = near.groupBy("x.r").agg(F.count_if(F.col("x.u") < F.lit(low)).alias("below"), F.array_sort(F.collect_list(F.when(F.col("x.u") >= F.lit(low), F.col("x.u")))).alias("band"))
        edges = {r["r"]: r["u"] for r in bands.select("r", F.when(F.col("below") < budget, F.get("band", (F.lit(budget - 1) - F.col("below")).cast("int"))).alias("u")).collect()}  # a number a repetition
        if len(edges) == repetitions and None not in edges.values():
            return [edges[r] for r in range(repetitions)]
        reach *= 2


def repeated_selections(rows: DataFrame, id_: str, budget: int, repetitions: int, seed: int) -> DataFrame:
    """`rows` once for each of the repetitions (0, 1, ...) that select them; smaller budgets of a seed are subsets."""
    edges = F.array(*[F.lit(u) for u in thresholds(rows, id_, budget, repetitions, seed)])
    at = F.filter(F.sequence(F.lit(0), F.lit(repetitions - 1)), lambda r: _uniform(id_, seed, r) <= F.get(edges, r))
    return rows.withColumn("repetition", F.explode(at))


def random_effects(rows: DataFrame, id_: str, numbers: dict[str, str], prompt: str, budget: int, repetitions: int, seed: int, direction: str = "preferred_response") -> DataFrame:
    """(repetition, domain, effect) of random selections, with the effects of `preference.preference_effects`.

    `numbers` maps numeric columns to their domain. Per repetition only sums leave the tasks: of each
    column, of each direction, of each word.
    """
    words = lower_tokens(F.coalesce(F.col(prompt), F.lit("")))
    named = {c: f"_n{k}" for k, c in enumerate(numbers)}
    kept = rows.select(F.col(id_).cast("string").alias("_id"), *[F.col(c).cast("double").alias(n) for c, n in named.items()], F.coalesce(F.col(direction).cast("string"), F.lit("0")).alias("_kind"), words.alias("_words"))
    drawn = cut(repeated_selections(kept, "_id", budget, repetitions, seed))
    pool = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_words")).alias("words"), *[F.avg(n).alias(n) for n in named.values()]).first()
    moved = {c: F.abs(F.coalesce(F.avg(n) - F.lit(pool[n]), F.lit(0.0))) for c, n in named.items()}
    each = {c: x / max(abs(pool[named[c]] or 0.0), 1.0) if numbers[c] == "length" else x for c, x in moved.items()}
    domains = sorted(set(numbers.values()))
    top = [F.greatest(*own, F.lit(0.0)).alias(d) for d in domains for own in [[x for c, x in each.items() if numbers[c] == d]]]
    long = lambda frame, names: frame.select("repetition", F.inline(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).alias("effect")) for d in names])))
    out = long(drawn.groupBy("repetition").agg(*top), domains) if domains else None

    # Shares that a selection lacks count by what the others leave of the pool's sum of 1.
    kinds = kept.groupBy("_kind").agg((F.count(F.lit(1)) / pool["n"]).alias("p"))
    own = drawn.groupBy("repetition", "_kind").agg((F.count(F.lit(1)) / budget).alias("q")).join(kinds, "_kind")
    tv = own.groupBy("repetition").agg(((F.sum(F.abs(F.col("q") - F.col("p"))) + 1 - F.sum("p")) / 2).alias("preference_direction"))
    parts = [long(tv, ["preference_direction"])]

    shares = kept.select(F.explode("_words").alias("w")).groupBy("w").agg((F.count(F.lit(1)) / max(pool["words"] or 0, 1)).alias("p"))
    said = drawn.select("repetition", F.explode("_words").alias("w")).groupBy("repetition", "w").agg(F.count(F.lit(1)).alias("k"))
    total = said.groupBy("repetition").agg(F.sum("k").alias("all"))  # a row a repetition
    p, q = F.col("p"), F.col("k") / F.col("all")
    both = said.join(F.broadcast(total) if repetitions <= 100_000 else total, "repetition").join(shares, "w")
    inner = F.sum(p * F.ln(2 * p / (p + q)) + q * F.ln(2 * q / (p + q)))
    js = both.groupBy("repetition").agg(((inner + F.lit(math.log(2)) * (1 - F.sum("p"))) / 2).alias("js"))
    silent = F.lit(math.log(2) / 2 if pool["words"] else 0.0)  # a selection without words keeps none of the pool's
    all_ = rows.sparkSession.range(repetitions).select(F.col("id").cast("int").alias("repetition"))
    parts.append(long(all_.join(js, "repetition", "left").select("repetition", F.greatest(F.coalesce("js", silent), F.lit(0.0)).alias("prompt_distribution")), ["prompt_distribution"]))
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def random_baseline(effects: DataFrame, quantile: float = 0.95) -> DataFrame:
    """(domain, mean_effect, quantile_effect, repetitions) of `random_effects`; quantiles are interpolated."""
    if not 0 < quantile < 1:
        raise ValueError("the quantile must lie between 0 and 1")
    return effects.groupBy("domain").agg(F.avg("effect").alias("mean_effect"), F.percentile("effect", quantile).alias("quantile_effect"), F.count(F.lit(1)).alias("repetitions"))


def over_baseline(effects: DataFrame, baseline: DataFrame) -> DataFrame:
    """`effects` (method, domain, effect) with `excess` over the baseline's quantile, as `audit.preference_gate` takes them."""
    law = baseline.select(F.col("domain").alias("_d"), "quantile_effect")  # a row a domain
    return effects.join(F.broadcast(law), F.col("domain") == F.col("_d"), "left").withColumn("excess", F.col("effect") - F.col("quantile_effect")).drop("_d", "quantile_effect")
