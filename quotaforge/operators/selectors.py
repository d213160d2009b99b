"""One entry to the selections: a pool, the name of a method and a budget."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaforge.functions.expr import checked_probabilities, entropy, gradient_embedding, gradient_utility, margin_uncertainty, norm
from quotaforge.operators import choose, cluster, influence, soft
from quotaforge.operators.order import cut
from quotaforge.operators.tables import assert_safe, stratified_split

#: Methods, and the columns that each needs beside the id.
NEEDS = {
    "random": (), "entropy": ("p",), "margin": ("p",), "entropy_gradient": ("p", "embedding"), "badge": ("p", "embedding"), "galaxy": ("p", "embedding"),
    "matched_random": ("membership",), "entropy_constrained": ("p",), "margin_constrained": ("p",), "entropy_gradient_constrained": ("p", "embedding"), "badge_constrained": ("p", "embedding"),
}


#: Temperature of the soft cluster memberships.
TEMPERATURE = 1.0
#: Tolerances that the constrained methods try in turn, and the share of utility that they may lose.
SLACKS, LOSS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5), 0.05


def method_name(name: str) -> str:
    """Lower case, with one underscore for whatever separates words (also before a capital inside, as in EntropyGradient)."""
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip())
    found = re.sub(r"[^a-z0-9]+", "_", split.lower()).strip("_")
    if found not in NEEDS:
        raise ValueError(f"no method {name!r}; there are {', '.join(NEEDS)}")
    return found


def select(pool: DataFrame, method: str, budget: int, seed: int = 0, id_: str = "id", targets: str | dict[str, float] | None = None, tolerance: float = 0.05) -> DataFrame:
    """The `budget` rows that `method` selects, all columns as they were.

    Columns: p (class probabilities), embedding, membership (a map of groups). Hidden fields
    in the pool are an error, and so are probabilities that are negative, without a positive
    sum or of one class; others are brought to a sum of 1. Uncertainty methods take the highest scores, ties by id;
    `badge` spreads over gradient embeddings, `galaxy` covers the pool's embeddings; `random`
    and `matched_random` are seeded. The methods named `_constrained` are those of `constrained`.
    """
    name = method_name(method)
    assert_safe(pool)
    if missing := [c for c in NEEDS[name] if c not in pool.columns]:
        raise ValueError(f"{name} needs the columns {', '.join(missing)}")
    if name.endswith("_constrained"):
        ids = constrained(pool, name.removesuffix("_constrained"), budget, id_, targets or "pool")[0].ids
        return pool.join(ids.select(F.col("id").alias("_chosen")), F.col(id_).cast("string") == F.col("_chosen"), "left_semi")
    p = checked_probabilities(F.col("p").cast("array<double>")) if "p" in NEEDS[name] else None
    if name == "random":
        return choose.random_budget(pool, id_, budget, seed)
    if name in ("entropy", "margin", "entropy_gradient"):
        score = {"entropy": entropy, "margin": margin_uncertainty}[name](p) if name != "entropy_gradient" else gradient_utility(p, F.col("embedding"))
        return choose.top_budget(pool.withColumn("_score", score), "_score", id_, budget).drop("_score")
    if name == "badge":
        ids = choose.farthest_points(pool.select(id_, gradient_embedding(p, F.col("embedding")).alias("_g")), "_g", id_, budget)
    elif name == "galaxy":
        scored = pool.select(id_, "embedding", entropy(p).alias("_entropy"))
        ids = cluster.facility_location(scored, scored, "embedding", id_, "_entropy", budget)
    else:
        want = targets or {r["group"]: r["target"] for r in soft.target_moments(pool, "membership").collect()}  # a row a group
        ids = soft.matched_random(pool, id_, "membership", want, budget, tolerance, seed)
    return pool.join(ids.select(F.col("id").alias("_chosen")).distinct(), F.col(id_).cast("string") == F.col("_chosen"), "left_semi")


def constrained(
    pool: DataFrame, base: str, budget: int, id_: str = "id", targets: str | dict[str, float] = "pool", slacks: tuple[float, ...] = SLACKS, loss: float = LOSS,
    clusters: int | None = None, candidates: int = 4,
) -> tuple[soft.Selection, float]:
    """`budget` rows of most utility whose class and cluster shares are near their targets, and the slack that it took.

    Utility: the rank (0 to 1) of the entropy, margin, entropy gradient, or norm of the gradient
    embedding (badge). Groups: class=k with the probabilities `p` as memberships (or those of a
    column `posterior`, which then no row may lack), and, where all rows have an embedding,
    semantic_cluster=c by `clusters` spherical clusters (a quarter of the budget unless given,
    2 to 32). Class targets: the pool's means, "uniform", or a number for every class; cluster
    targets are the pool's means. `entropy_gradient` takes its `candidates` times `budget` best rows as
    its pool, but keeps the targets of the whole one.
    """
    assert_safe(pool)
    held = checked_probabilities(F.col("p").cast("array<double>"))
    scores = {"entropy": lambda: entropy(held), "margin": lambda: margin_uncertainty(held), "entropy_gradient": lambda: gradient_utility(held, F.col("embedding")), "badge": lambda: norm(gradient_embedding(held, F.col("embedding")))}
    if base not in scores:
        raise ValueError(f"no utility {base!r}; there are {', '.join(scores)}")
    has = pool.agg(F.count(F.lit(1)).alias("n"), *[(F.count(c) if c in pool.columns else F.lit(0)).alias(c) for c in ("posterior", "embedding")]).first()
    if not 1 <= budget <= has["n"]:
        raise ValueError(f"{has['n']} rows cannot give {budget}")
    if 0 < has["posterior"] < has["n"]:
        raise ValueError("posterior must be there for every row or for none")
    shown = checked_probabilities(F.col("posterior").cast("array<double>")) if has["posterior"] else held
    names = lambda kind, p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.concat(F.lit(f"{kind}="), k.cast("string")))
    rows = cut(pool.select(F.col(id_).cast("string").alias("id"), scores[base]().alias("score"), shown.alias("p")))
    sizes = rows.agg(F.min(F.size("p")).alias("a"), F.max(F.size("p")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError("all rows must have probabilities of the same classes")
    classes = [f"class={k}" for k in range(sizes["b"])]
    rows = rows.withColumn("m", F.map_from_arrays(names("class", "p"), "p"))
    if has["embedding"] == has["n"]:
        k = min(has["n"], clusters or min(32, max(2, math.ceil(budget / 4))))
        centres = cluster.fit_clusters(pool, "embedding", id_, k)
        near = cluster.assign_clusters(pool, "embedding", id_, centres, TEMPERATURE).select(F.col("id").alias("_i"), F.map_from_arrays(names("semantic_cluster", "memberships"), "memberships").alias("_m"))
        rows = rows.join(near, F.col("id") == F.col("_i")).withColumn("m", F.map_concat("m", "_m")).drop("_i", "_m")
    rows = cut(rows.select("id", "score", "m"))
    want = {r["group"]: r["target"] for r in soft.target_moments(rows, "m").collect()}  # a row a group
    if targets == "uniform":
        want |= {c: 1 / len(classes) for c in classes}
    elif isinstance(targets, dict):
        if set(targets) != set(classes):
            raise ValueError("explicit targets must name every class once")
        want |= targets
    elif targets != "pool":
        raise ValueError(f"no targets {targets!r}; there are pool, uniform and a number for every class")
    if base == "entropy_gradient" and budget * candidates < has["n"]:
        rows = choose.top_budget(rows, "score", "id", budget * candidates)
    ranked = cut(choose.rank_normalised(rows, "score", "id", "utility"))
    return soft.select_with_slack(ranked, "utility", "id", "m", "m", want, budget, slacks, loss)


def length_memberships(rows: DataFrame, length: str) -> DataFrame:
    """`rows` with `length_group`: length_bin=short, =medium or =long, up to the exact terciles (interpolated between neighbours) of a column; null for null."""
    low, high = rows.agg(F.percentile(length, [1 / 3, 2 / 3])).first()[0] or (0.0, 0.0)
    return rows.withColumn("length_group", F.when(F.col(length) <= low, "length_bin=short").when(F.col(length) <= high, "length_bin=medium").when(F.col(length).isNotNull(), "length_bin=long"))


def by_influence(
    pool: DataFrame, seeds: DataFrame, budget: int, tolerance: float | tuple[float, ...], seed: int, id_: str = "id", features: str = "embedding", label: str = "label",
    length: str | None = None, grid: tuple[float, ...] = (0.01, 0.1), heads: int = 4, loss: float = 0.1,
) -> soft.Selection:
    """`budget` pool rows of most expected influence on validation loss, with class (and length) shares near the pool's.

    The labelled seeds are split into fit, calibration and validation rows, stratified by
    label (class numbers from 0). A head is fitted, its l2 and temperature chosen on the
    calibration rows; utilities are expected influences along the validation gradient.
    Class memberships are the head's probabilities, bounded by the quantiles of resampled
    heads; length terciles are known memberships. Targets are the pool's means, and the
    selection is the robust one of `soft.select`; of several tolerances the least that keeps
    1 - `loss` of the utility counts. Features are centred and scaled as the fit rows are.
    Labels of the pool are never read.
    """
    assert_safe(pool)
    n = seeds.count()
    if n < 10:
        raise ValueError("at least ten labelled seeds")
    sizes = {"fit": n - 2 * (n // 5), "calibration": n // 5, "validation": n // 5}
    split = stratified_split(seeds.select(id_, F.col(label).cast("int").alias(label)), id_, label, sizes, seed).select(id_, "split")
    placed = cut(seeds.join(split, id_))
    mean, scale = influence.feature_scale(placed.filter("split = 'fit'"), features)
    placed, pool = influence.scaled(placed, features, mean, scale), influence.scaled(pool, features, mean, scale)
    part = lambda name: placed.filter(F.col("split") == name)
    head, l2 = influence.choose_l2(part("fit"), part("calibration"), features, label, list(grid))
    head = influence.calibrated(head, part("calibration"), features, label)
    gradient = influence.mean_gradient(head, part("validation"), features, label)
    resampled = influence.bootstrap_heads(part("fit"), part("calibration"), id_, features, label, l2, heads, seed)
    bounds = influence.posterior(head, resampled, pool, id_, features)
    gain = influence.expected_influence(head, gradient, pool, id_, features).select(F.col("id").alias("_i"), "utility")
    names = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.concat(F.lit("class:"), k.cast("string")))
    rows = bounds.select("id", *[F.map_from_arrays(names, c).alias(c) for c in ("p", "lower", "upper")])
    if length:
        known = length_memberships(pool.select(F.col(id_).cast("string").alias("_l"), length), length).select("_l", "length_group")
        one = F.when(F.col("length_group").isNotNull(), F.map_from_arrays(F.array("length_group"), F.array(F.lit(1.0)))).otherwise(F.create_map().cast("map<string,double>"))
        rows = rows.join(known, F.col("id") == F.col("_l")).select("id", *[F.map_concat(c, one).alias(c) for c in ("p", "lower", "upper")])
    rows = cut(rows.join(gain, F.col("id") == F.col("_i")).drop("_i"))
    targets = {r["group"]: r["target"] for r in soft.target_moments(rows, "p").collect()}  # a row a group
    if isinstance(tolerance, tuple):
        return soft.select_with_slack(rows, "utility", "id", "lower", "upper", targets, budget, tolerance, loss)[0]
    return soft.select(rows, "utility", "id", "lower", "upper", targets, budget, tolerance)
