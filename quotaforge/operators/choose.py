"""Selections of exactly B rows: top scores, best of each group, seeded samples, constrained utility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaforge.functions.expr import seeded
from quotaforge.operators.order import cut, global_rank, rank_in_groups

#: Rows of the undecided band that are sorted at once, and bands into which a band is cut.
SORTED, BANDS = 100_000, 32
#: Id strings of a single score that are sampled for edges.
SAMPLED = 2048
#: Steps of a greedy cover after which its distances are written.
WRITTEN = 16


class Infeasible(ValueError):
    """No selection of the wanted size meets the constraints; wrong arguments raise a plain ValueError."""


def _place(id_: str):
    """What breaks ties: the id's string; a null id counts as the empty one."""
    return F.coalesce(F.col(id_).cast("string"), F.lit(""))


def narrowed(rows: DataFrame, score: str, id_: str, budget: int):
    """Two predicates and a number: rows surely taken, the band of at most `SORTED` rows in which the last one lies, and how many of the band are taken.

    Counts around `BANDS` quantile edges narrow the band pass by pass, by the score alone,
    so ids are not even built; once one score is left, edges from a sample of about
    `SAMPLED` id strings go on. Only counts reach the driver, and no pass sorts. A band may
    be larger than `SORTED` only where score and id are the same throughout.
    """
    s, i = F.col(score), _place(id_)
    before, band, left = F.lit(False), s.isNotNull(), budget
    while True:
        held = rows.filter(band)
        marks = [k / BANDS for k in range(1, BANDS)]
        row = held.agg(F.count(F.lit(1)).alias("n"), F.min(s).eqNullSafe(F.max(s)).alias("one"), F.max(s).alias("top"), F.percentile_approx(score, marks, 1000).alias("edges")).first()
        if row["n"] <= left:
            return before | band, F.lit(False), 0
        if row["n"] <= SORTED:
            return before, band, left
        if row["one"]:
            value = F.lit(row["top"])
            break
        edges = list(dict.fromkeys(row["edges"]))
        counts = held.agg(*[c.alias(f"{n}{k}") for k, e in enumerate(edges) for n, c in (("over", F.count_if(s > F.lit(e))), ("from", F.count_if(s >= F.lit(e))))]).first()
        held_by = next((e for k, e in enumerate(edges) if counts[f"over{k}"] < left <= counts[f"from{k}"]), None)
        if held_by is not None:
            k = edges.index(held_by)
            before, band, left = before | (band & (s > F.lit(held_by))), s == F.lit(held_by), left - counts[f"over{k}"]
            continue
        full = [k for k in range(len(edges)) if counts[f"from{k}"] < left]
        short = [k for k in range(len(edges)) if counts[f"over{k}"] >= left]
        inner = band
        if full:
            before, inner, left = before | (band & (s >= F.lit(edges[full[0]]))), inner & (s < F.lit(edges[full[0]])), left - counts[f"from{full[0]}"]
        band = inner & (s > F.lit(edges[short[-1]])) if short else inner
    band, size = s == value, row["n"]
    while size > SORTED:
        held = rows.filter(band).select(i.alias("i"))
        sample = sorted(r["i"] for r in held.filter(F.pmod(F.xxhash64("i"), F.lit(max(1, size // SAMPLED))) == 0).distinct().collect())  # about SAMPLED strings
        ends = held.agg(F.min("i").alias("a"), F.max("i").alias("b")).first()
        if ends["a"] == ends["b"]:
            break
        edges = sorted({ends["a"], ends["b"], *(sample[k * len(sample) // BANDS] for k in range(1, BANDS) if sample)})
        counts = held.agg(*[c.alias(f"{n}{k}") for k, e in enumerate(edges) for n, c in (("under", F.count_if(F.col("i") < e)), ("upto", F.count_if(F.col("i") <= e)))]).first()
        k = next(k for k in range(len(edges)) if counts[f"upto{k}"] >= left)
        if counts[f"under{k}"] < left:
            before, band, left, size = before | (band & (i < edges[k])), band & (i == edges[k]), left - counts[f"under{k}"], counts[f"upto{k}"] - counts[f"under{k}"]
            break
        taken = counts[f"upto{k - 1}"]
        before, band, left, size = before | (band & (i <= edges[k - 1])), band & (i > edges[k - 1]) & (i < edges[k]), left - taken, counts[f"under{k}"] - taken
    return before, band, left


def top_budget(rows: DataFrame, score: str, id_: str, budget: int) -> DataFrame:
    """The `budget` rows of largest score, ties by the id's string; rows without a score are never taken.

    The pool is never sorted whole, and no task merges more than `SORTED` rows, however
    many scores tie: see `narrowed`. Rows equal in score and id are interchangeable.
    """
    if budget < 1:
        raise ValueError("a budget selects at least one row")
    before, band, left = narrowed(rows, score, id_, budget)
    sure = rows.filter(before)
    if not left:
        return sure
    return sure.unionByName(rows.filter(band).orderBy(F.desc(score), _place(id_)).limit(left))


def marked_top(rows: DataFrame, score: str, id_: str, budget: int) -> DataFrame:
    """All rows with the boolean `selected` for the `budget` rows of largest score, ties by the id's string; ids must be unique.

    The last selected row, one (score, id), tells the others: a filter, not a join over the pool.
    """
    place = _place(id_)
    before, band, left = narrowed(rows, score, id_, budget)
    if not left:
        return rows.withColumn("selected", F.coalesce(before, F.lit(False)))
    last = rows.filter(band).select(F.col(score).alias("s"), place.alias("i")).orderBy(F.desc("s"), "i").offset(left - 1).limit(1).first()
    edge = F.lit(last["s"])
    return rows.withColumn("selected", F.coalesce((F.col(score) > edge) | ((F.col(score) == edge) & (place <= F.lit(last["i"]))), F.lit(False)))


def marked(rows: DataFrame, chosen: DataFrame, id_: str) -> DataFrame:
    """All rows with the boolean `selected`."""
    keys = chosen.select(F.col(id_).alias("_chosen"))
    return rows.join(keys, F.col(id_) == F.col("_chosen"), "left").withColumn("selected", F.col("_chosen").isNotNull()).drop("_chosen")


def best_of_groups(rows: DataFrame, score: str, id_: str, group: str) -> DataFrame:
    """The best row of every group (ties by id), by a map-side maximum instead of a sort."""
    columns = [c for c in rows.columns]
    packed = rows.withColumn("_row", F.struct(*columns)).groupBy(group).agg(F.min_by("_row", F.struct((-F.col(score)).alias("s"), F.col(id_).cast("string").alias("i"))).alias("_row"))
    return packed.select(*[F.col("_row")[c].alias(c) for c in columns])


def top_budget_by_group(rows: DataFrame, score: str, id_: str, group: str, budget: int) -> DataFrame:
    return top_budget(best_of_groups(rows, score, id_, group), score, id_, budget)


def random_budget(rows: DataFrame, id_: str, budget: int, seed: int) -> DataFrame:
    """Seeded sample without replacement: the ids of least hash. Budgets nest."""
    keyed = rows.withColumn("_rank", -F.conv(F.substring(seeded(seed, F.col(id_)), 1, 13), 16, 10).cast("double"))
    return top_budget(keyed, "_rank", id_, budget).drop("_rank")


def random_by_group(rows: DataFrame, id_: str, group: str, budget: int, seed: int) -> DataFrame:
    """One seeded member of each of `budget` seeded groups."""
    member = rows.groupBy(F.col(group)).agg(F.min_by(id_, seeded(seed, F.col(id_))).alias(id_))
    return random_budget(member, group, budget, seed)


def coverage_first(rows: DataFrame, score: str, id_: str, cluster: str, budget: int) -> DataFrame:
    """The best row of each cluster first, then the best of the rest."""
    first = cut(best_of_groups(rows.filter(F.col(score).isNotNull()), score, id_, cluster))
    n = first.count()
    if n >= budget:
        return top_budget(first, score, id_, budget)
    rest = rows.join(first.select(F.col(id_).alias("_first")), F.col(id_) == F.col("_first"), "left_anti")
    return first.unionByName(top_budget(rest, score, id_, budget - n))


def rank_normalised(rows: DataFrame, score: str, id_: str, name: str = "utility") -> DataFrame:
    """rank / (n - 1) from 0 to 1 in ascending order, ties by id; 1 for a single row."""
    n = rows.count()
    ranked = global_rank(rows, [F.col(score).asc(), F.col(id_).cast("string").asc()], "_rank")
    return ranked.withColumn(name, F.lit(1.0) if n < 2 else (F.col("_rank") - 1) / F.lit(float(n - 1))).drop("_rank")


def retained_utility(rows: DataFrame, utility: str, selected: str, id_: str, budget: int) -> float:
    """Utility of the selection over that of the top `budget` rows; 1 where the latter is not positive."""
    best = top_budget(rows, utility, id_, budget).agg(F.sum(utility)).first()[0] or 0.0
    own = rows.filter(F.col(selected)).agg(F.sum(utility)).first()[0] or 0.0
    return own / best if best > 0 else 1.0


def constrained(rows: DataFrame, utility: str, id_: str, group: str, budget: int, slack: float) -> DataFrame:
    """Most utility with every group's share within `slack` of its pool share.

    Groups exclude each other here, so shares are counts between two bounds: each group
    gives its lower bound of best rows, and the rest of the budget goes to the best other
    rows below the upper bounds. That exchange is optimal for disjoint groups. Ranks come from
    one order by ranges, so neither a group nor the budget goes through one task.
    """
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    share = F.col("_n") / F.lit(float(total))
    bounds = sizes.select(
        "_g", "_n",
        F.greatest(F.lit(0), F.ceil((share - slack) * budget - 1e-9)).alias("_low"),
        F.least(F.col("_n"), F.floor((share + slack) * budget + 1e-9)).alias("_high"),
    )
    limits = bounds.agg(F.sum("_low"), F.sum("_high")).first()
    if limits[0] > budget or limits[1] < budget:
        raise Infeasible(f"no selection of {budget} rows keeps all groups within {slack}")
    ranked = rank_in_groups(_within_reach(rows, utility, group, bounds), group, [F.desc(utility), _place(id_)], "_place")
    ranked = cut(ranked.join(bounds, F.col(group).eqNullSafe(F.col("_g"))).filter("_place <= _high"))
    must, left = ranked.filter("_place <= _low").select(*rows.columns), budget - int(limits[0])
    return must.unionByName(top_budget(ranked.filter("_place > _low").select(*rows.columns), utility, id_, left)) if left else must


def _within_reach(rows: DataFrame, utility: str, group: str, bounds: DataFrame) -> DataFrame:
    """`rows` without those that surely lie beyond their group's upper bound, by quantiles that are exact to a five-hundredth of the group."""
    marks = [k / 200 for k in range(201)]
    quantiles = rows.groupBy(F.col(group).alias("_q")).agg(F.percentile_approx(utility, marks, 2000).alias("_marks"))
    known = bounds.join(quantiles, F.col("_g").eqNullSafe(F.col("_q")))
    at = F.greatest(F.lit(0), F.floor((1 - F.col("_high") / F.col("_n") - 0.002) * 200)).cast("int")
    least = known.select("_q", F.when(at > 0, F.get("_marks", at)).alias("_least"))
    near = rows.join(least, F.col(group).eqNullSafe(F.col("_q")))
    return near.filter(F.col("_least").isNull() | (F.col(utility) >= F.col("_least"))).select(*rows.columns)


def frontier(rows: DataFrame, utility: str, id_: str, group: str, budget: int, slacks: list[float], loss: float = 0.05):
    """Per slack: retained utility and status; the first slack that retains 1 - `loss` is chosen, all are traced."""
    best = top_budget(rows, utility, id_, budget).agg(F.sum(utility)).first()[0]
    trace, done = [], False
    for slack in sorted(slacks):
        try:
            kept = constrained(rows, utility, id_, group, budget, slack).agg(F.sum(utility)).first()[0]
            retained = kept / best if best > 0 else 1.0
            good = retained >= 1 - loss
            trace.append((float(slack), float(retained), "chosen" if good and not done else "feasible"))
            done |= good
        except Infeasible:
            trace.append((float(slack), None, "infeasible"))
    return rows.sparkSession.createDataFrame(trace, "slack double, retained double, status string")


def farthest_points(rows: DataFrame, vector: str, id_: str, budget: int) -> DataFrame:
    """Greedy k-centre: starts at the largest norm, adds the row farthest from all chosen ones, ties by id. One job a step.

    Every `WRITTEN` steps the distances to the points chosen so far are written, so that a
    step's plan holds no more than that many points.
    """
    from quotaforge.functions.expr import dot, norm

    state = rows.select(F.col(id_).cast("string").alias("id"), F.col(vector).alias("v"), F.lit(None).cast("double").alias("m"))
    chosen: list[str] = []
    recent: list[tuple[str, list[float]]] = []
    for step in range(budget):
        away = [F.sqrt(F.greatest(F.lit(0.0), dot(F.col("v"), F.col("v")) + sum(x * x for x in p) - 2 * dot(F.col("v"), F.array(*[F.lit(x) for x in p])))) for _, p in recent]
        gap = F.least(F.col("m"), *away) if away else F.col("m")
        left = state.filter(~F.col("id").isin([i for i, _ in recent])) if recent else state
        if len(recent) == WRITTEN:
            left = cut(left.withColumn("m", gap))
            recent, gap = [], F.col("m")
        row = left.select("id", "v", (gap if step else norm(F.col("v"))).alias("g")).orderBy(F.desc("g"), "id").limit(1).first()
        if row is None:
            break
        state = left if not recent else state
        chosen.append(row["id"])
        recent.append((row["id"], [float(x) for x in row["v"]]))
    return rows.sparkSession.createDataFrame([(k + 1, i) for k, i in enumerate(chosen)], "step int, id string")
