"""Exactly B rows of most utility where groups overlap and memberships are soft, or known only within bounds.

Every group's mean membership over the selection must lie within `tolerance` of its
target: the upper memberships may not exceed it, the lower ones may not fall below it.
The linear relaxation is solved through its dual, smoothed by entropy: one multiplier a
constraint and one for the budget, found by Newton steps whose sums (not rows) leave the
tasks. The selection is then the top B by utility less the multipliers' charge, and a
bounded core of rows nearest to the cut is swapped until the bounds hold. Pools of up to
`EXACT` rows are enumerated, as a Spark range of bit masks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaforge.functions.expr import coin, dot, seeded
from quotaforge.operators import sampling
from quotaforge.operators.choose import Infeasible, marked, top_budget
from quotaforge.operators.order import cut, first_of_groups

#: Most groups; pools that are enumerated; core rows a side; swaps; Newton steps for each smoothing.
GROUPS, EXACT, CORE, SWAPS, STEPS = 64, 18, 480, 64, 20
#: Most different memberships of a pool that are drawn as counts on the driver.
CELLS = 10_000
SMOOTHING = (0.3, 0.1, 0.03, 0.01, 0.003)
SLIP = 1e-9


@dataclass
class Selection:
    """The ids, their utility, the dual's upper bound on any selection's utility, and the largest breach of a tolerance (0: none)."""

    ids: DataFrame
    utility: float
    bound: float
    breach: float


def _table(rows: DataFrame, utility: str, id_: str, lower: str, upper: str, groups: list[str]) -> DataFrame:
    """id, u, a: upper memberships, then negated lower ones, so that all limits are upper limits."""
    at = lambda m, g: F.coalesce(F.try_element_at(F.col(m), F.lit(g)).cast("double"), F.lit(0.0))
    charges = F.array(*[at(upper, g) for g in groups], *[-at(lower, g) for g in groups])
    usable = rows.filter(F.col(utility).isNotNull() & ~F.isnan(F.col(utility).cast("double")))
    return usable.select(F.col(id_).cast("string").alias("id"), F.col(utility).cast("double").alias("u"), charges.alias("a"))


def all_groups(rows: DataFrame, targets: dict[str, float], *memberships: str) -> list[str]:
    """The groups of `targets` and of the map columns, in order; at most `GROUPS`."""
    seen = None
    for m in dict.fromkeys(memberships):
        own = rows.select(F.explode(F.transform(F.map_keys(m), lambda k: k.cast("string"))).alias("g")).distinct().limit(GROUPS + 1)
        seen = own if seen is None else seen.union(own)
    groups = sorted({*targets, *(r["g"] for r in seen.distinct().collect())})
    if not 0 < len(groups) <= GROUPS:
        raise ValueError(f"between 1 and {GROUPS} groups")
    return groups


def invalid_memberships(rows: DataFrame, membership: str) -> DataFrame:
    """The rows with a membership that is null, not finite or outside [0, 1]."""
    bad = F.exists(F.map_values(F.col(membership)), lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1))
    return rows.filter(F.coalesce(bad, F.lit(False)))


def target_moments(rows: DataFrame, membership: str) -> DataFrame:
    """Mean membership of each group over all rows, absent groups counting 0."""
    n = rows.count()
    each = rows.select(F.explode(membership).alias("group", "value"))
    return each.groupBy("group").agg((F.sum("value") / F.lit(float(max(n, 1)))).alias("target"))


def _fitting(table: DataFrame, n: int, budget: int, limits: np.ndarray) -> DataFrame:
    """(ids, u) of all subsets of `budget` of the `n` rows that keep the limits."""
    one = table.agg(F.array_sort(F.collect_list(F.struct("id", "u", "a"))).alias("rows"))  # at most EXACT rows
    masks = table.sparkSession.range(1 << n).filter(F.bit_count("id") == budget).withColumnRenamed("id", "mask")
    picked = masks.crossJoin(F.broadcast(one)).select(F.filter("rows", lambda r, k: F.getbit("mask", k) == 1).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, r: acc + f(r))
    fits = F.lit(True)
    for k, limit in enumerate(limits):
        fits &= total(lambda r, k=k: r["a"][k]) <= float(limit) + SLIP * budget
    return picked.filter(fits).select(F.col("p.id").alias("ids"), F.round(total(lambda r: r["u"]), 12).alias("u"))


def _enumerated(table: DataFrame, n: int, budget: int, limits: np.ndarray) -> list[str] | None:
    """The best subset that fits; ties by the joined ids."""
    found = _fitting(table, n, budget, limits).orderBy(F.desc("u"), F.array_join("ids", "\n")).limit(1).first()
    return found and found["ids"]


def _sums(table: DataFrame, point: np.ndarray, smooth: float):
    """Smoothed part of the dual at `point`, the selection's sums and their curvature: 1 + k + k * k numbers leave a task."""
    k = len(point)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for b in batches:
            if len(b):
                a = np.hstack([np.ones((len(b), 1)), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)])
                z = (b.column(0).to_numpy(zero_copy_only=False) - a @ point) / smooth
                x = np.exp(-np.logaddexp(0, -z))
                total[0] += smooth * np.logaddexp(0, z).sum()
                total[1 : 1 + k] += x @ a
                total[1 + k :] += ((a * (x * (1 - x))[:, None]).T @ a).ravel()
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(total), dtype=np.int32), "v": total})

    found = table.select("u", "a").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().set_index("k")["v"]
    v = found.reindex(range(1 + k + k * k), fill_value=0.0).to_numpy()
    return v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)


def multipliers(table: DataFrame, limits: np.ndarray, start: float) -> tuple[np.ndarray, float]:
    """Minimiser and value of the dual; utilities must lie in [0, 1], so a negative value proves that nothing fits.

    `limits` holds the budget first; its multiplier is free, the others are at least 0.
    """
    point = np.zeros(len(limits))
    point[0] = start
    value = np.inf
    for smooth in SMOOTHING:
        part, taken, bend = _sums(table, point, smooth)
        value = part + limits @ point
        for _ in range(STEPS):
            slope = limits - taken
            free = (point > 1e-12) | (slope < 0)
            free[0] = True
            if np.abs(slope[free]).max() <= 1e-3 * max(1.0, limits[0] ** 0.5):
                break
            h = bend[np.ix_(free, free)] / smooth
            move = np.zeros(len(point))
            move[free] = -np.linalg.solve(h + (1e-8 * np.trace(h) / len(h) + 1e-9) * np.eye(len(h)), slope[free])
            move *= min(1.0, 1.0 / np.abs(move).max())  # utilities span 1
            step = 1.0
            while step > 1e-5:
                trial = point + step * move
                trial[1:] = np.maximum(0, trial[1:])
                part, near, curve = _sums(table, trial, smooth)
                if part + limits @ trial <= value + 1e-4 * slope @ (trial - point):
                    break
                step /= 4
            else:
                break
            gained = value - (part + limits @ trial)
            point, value, taken, bend = trial, part + limits @ trial, near, curve
            if value < -1e-6 * limits[0]:
                raise Infeasible("no selection keeps all groups within the tolerance")
            if gained <= 1e-9 * max(1.0, abs(value)):
                break
    return np.round(point, 9), float(value)


def _swaps(inside: list, outside: list, sums: np.ndarray, limits: np.ndarray, slip: float) -> tuple[set[str], set[str]]:
    """Ids that leave and enter: swaps that mend the largest excess, then swaps that gain utility within the limits."""
    began = {r["id"] for r in inside}
    inside, outside, sums = list(inside), list(outside), sums.copy()
    for _ in range(SWAPS if inside and outside else 0):
        ui, uo = (np.array([r["u"] for r in side]) for side in (inside, outside))
        ai, ao = (np.array([r["a"] for r in side]) for side in (inside, outside))
        over = np.zeros((len(inside), len(outside)))
        for k in range(len(limits)):
            np.maximum(over, sums[k] - limits[k] - ai[:, k, None] + ao[None, :, k], out=over)
        gain = uo[None, :] - ui[:, None]
        now = max(0.0, (sums - limits).max())
        least = max(over.min(), slip)
        if now <= slip and gain[over <= slip].max(initial=-1.0) <= 1e-12 or now > slip and over.min() >= now - 1e-12:
            break
        i, j = np.unravel_index(np.where(over <= least + 1e-12, gain, -np.inf).argmax(), gain.shape)
        sums += ao[j] - ai[i]
        inside[i], outside[j] = outside[j], inside[i]
    ended = {r["id"] for r in inside}
    return began - ended, ended - began


def select(rows: DataFrame, utility: str, id_: str, lower: str, upper: str, targets: dict[str, float], budget: int, tolerance: float) -> Selection:
    """`budget` ids of most utility with all groups within `tolerance`; `lower` and `upper` are map columns (the same one where memberships are known).

    A group of the memberships that `targets` does not list has the target 0. Rows without a utility are left out; ids must be unique; ties go to the lesser id. Raises
    where the bounds cannot hold together; a breach that only whole rows cause is reported.
    """
    groups = all_groups(rows, targets, lower, upper)
    want = np.array([targets.get(g, 0.0) for g in groups])
    limits = budget * np.concatenate([want + tolerance, tolerance - want])
    raw = _table(rows, utility, id_, lower, upper, groups)
    has = raw.agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("least"), F.max("u").alias("most")).first()
    if not 1 <= budget <= has["n"]:
        raise ValueError(f"{has['n']} rows with a utility cannot give {budget}")
    if has["n"] <= EXACT:
        ids = _enumerated(raw, has["n"], budget, limits)
        if ids is None:
            raise Infeasible("no selection keeps all groups within the tolerance")
        chosen = raw.filter(F.col("id").isin(ids))
        total = float(chosen.agg(F.sum("u")).first()[0])
        return Selection(chosen.select("id"), total, total, 0.0)
    span = has["most"] - has["least"] or 1.0
    table = cut(raw.withColumn("u", (F.col("u") - F.lit(has["least"])) / F.lit(span)))
    start = table.agg(F.percentile_approx("u", 1 - budget / has["n"])).first()[0]
    point, value = multipliers(table, np.concatenate([[budget], limits]), start)
    priced = table.withColumn("r", F.col("u") - dot(F.col("a"), F.array(*[F.lit(float(x)) for x in point[1:]])))
    both = cut(marked(priced, top_budget(priced, "r", "id", budget), "id"))
    top = both.filter("selected").agg(F.min("r").alias("edge"), *[F.sum(F.col("a")[k]).alias(f"s{k}") for k in range(len(limits))]).first()
    sums = np.array([top[f"s{k}"] for k in range(len(limits))])
    own = F.slice("a", 1, len(groups))
    sides = both.withColumn("_side", F.concat_ws(":", "selected", F.array_position(own, F.array_max(own))))
    core = first_of_groups(sides, "_side", [F.abs(F.col("r") - F.lit(top["edge"])), F.col("id")], max(4, CORE // len(groups)), "id").select("id", "u", "a", "selected").orderBy("id").collect()
    out, into = _swaps([r for r in core if r["selected"]], [r for r in core if not r["selected"]], sums, limits, SLIP * budget)
    chosen = both.filter((F.col("selected") & ~F.col("id").isin(list(out))) | F.col("id").isin(list(into)))
    end = chosen.agg(F.sum("u").alias("u"), *[F.sum(F.col("a")[k]).alias(f"s{k}") for k in range(len(limits))]).first()
    breach = max((end[f"s{k}"] - limits[k]) / budget for k in range(len(limits)))
    back = lambda x: float(x * span + budget * has["least"])
    return Selection(chosen.select("id"), back(end["u"]), back(value), float(breach) if breach > SLIP else 0.0)


def frontier(rows: DataFrame, utility: str, id_: str, lower: str, upper: str, targets: dict[str, float], budget: int, slacks: list[float], loss: float = 0.05) -> DataFrame:
    """Per slack: utility over that of the top budget, breach and status; the first slack that keeps 1 - `loss` is chosen."""
    best = top_budget(rows, utility, id_, budget).agg(F.sum(utility)).first()[0]
    trace, done = [], False
    for slack in sorted(slacks):
        try:
            got = select(rows, utility, id_, lower, upper, targets, budget, slack)
        except Infeasible:
            trace.append((float(slack), None, None, "infeasible"))
            continue
        kept = got.utility / best if best > 0 else 1.0
        good = kept >= 1 - loss and got.breach == 0
        trace.append((float(slack), float(kept), got.breach, "chosen" if good and not done else "feasible" if got.breach == 0 else "breached"))
        done |= good
    return rows.sparkSession.createDataFrame(trace, "slack double, retained double, breach double, status string")


def select_with_slack(rows: DataFrame, utility: str, id_: str, lower: str, upper: str, targets: dict[str, float], budget: int, slacks: tuple[float, ...], loss: float) -> tuple[Selection, float]:
    """The selection of the least slack that keeps 1 - `loss` of the top budget's utility, and that slack; larger slacks are not tried.

    A slack at which whole rows leave a breach does not count. Without any, `Infeasible`.
    """
    if not slacks or not 0 <= loss <= 1:
        raise ValueError("slacks must be given, and the loss must lie in [0, 1]")
    best = top_budget(rows, utility, id_, budget).agg(F.sum(utility)).first()[0]
    for slack in sorted(slacks):
        try:
            got = select(rows, utility, id_, lower, upper, targets, budget, slack)
        except Infeasible:
            continue
        if not got.breach and (best <= 0 or got.utility / best >= 1 - loss - 1e-12):
            return got, float(slack)
    raise Infeasible("no slack keeps the wanted utility")


def error_audit(rows: DataFrame, utility: str, id_: str, estimated: str, lower: str, upper: str, observed: str, targets: dict[str, float], budget: int, tolerance: float) -> DataFrame:
    """The selection by estimated memberships and the one by their bounds, judged by the observed memberships.

    One row a selection and group: observed and target moments, and the selection's largest
    violation (distance of an observed moment from its target) and share of the best utility.
    """
    best = top_budget(rows, utility, id_, budget).agg(F.sum(utility)).first()[0]
    groups = rows.sparkSession.createDataFrame(sorted(targets.items()), "group string, target double")
    parts = []
    for name, low, high in (("nominal", estimated, estimated), ("robust", lower, upper)):
        got = select(rows, utility, id_, low, high, targets, budget, tolerance)
        seen = rows.join(got.ids.withColumnRenamed("id", "_id"), F.col(id_).cast("string") == F.col("_id"), "left_semi").select(F.explode(observed).alias("group", "v"))
        moments = seen.groupBy("group").agg((F.sum("v") / budget).alias("observed"))
        kept = float(got.utility / best) if best > 0 else 1.0
        parts.append(groups.join(moments, "group", "left").select(F.lit(name).alias("selection"), "group", "target", F.coalesce("observed", F.lit(0.0)).alias("observed"), F.lit(kept).alias("retained")))
    every = parts[0].unionByName(parts[1])
    worst = every.groupBy("selection").agg(F.max(F.abs(F.col("observed") - F.col("target"))).alias("violation"))  # two rows
    return every.join(F.broadcast(worst), "selection")


def _cells(rows: DataFrame, id_: str, membership: str) -> DataFrame:
    """id and cell: the positive memberships of a row as text, so that rows of equal memberships share a cell; no membership is the empty one."""
    entries = F.array_sort(F.transform(F.map_entries(F.map_filter(membership, lambda k, v: v > 0)), lambda e: F.struct(e["key"].cast("string").alias("g"), e["value"].cast("double").alias("v"))))
    return rows.select(F.col(id_).cast("string").alias("id"), F.coalesce(F.to_json(entries), F.lit("[]")).alias("cell"))


def matched_random(rows: DataFrame, id_: str, membership: str, targets: dict[str, float], budget: int, tolerance: float, seed: int) -> DataFrame:
    """A seeded random selection whose group means are within `tolerance` of the targets: the ids.

    It is uniform over the subsets that fit where every row is wholly in one group at most,
    whatever the number of rows and groups: see `sampling.draw_counts`. Other pools: up to
    `EXACT` rows the subset of least hash of its ids, which is uniform; up to `CELLS`
    different memberships a chain of swaps that starts from a fitting selection and tends to
    the uniform law (`sampling.walk_counts`, `MOVES` steps for each row of the budget and doubling
    of it); beyond that, seeded uniform utilities are maximised under the bounds, which is
    random but follows another law. A group that `targets` does not list has the target 0.
    """
    if budget < 1:
        raise ValueError("a budget selects at least one row")
    cells = _cells(rows, id_, membership)
    seen = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").limit(CELLS + 1).collect()  # a row a cell
    sizes = {r["cell"]: r["n"] for r in seen}
    n = sum(sizes.values())
    if len(sizes) <= CELLS:
        if budget > n:
            raise ValueError(f"{n} rows cannot give {budget}")
        held = {c: {e["g"]: e["v"] for e in json.loads(c)} for c in sizes}
        groups = sorted({*targets, *(g for m in held.values() for g in m)})
        bounds = {g: sampling.limits(targets.get(g, 0.0), tolerance, budget) for g in groups}
        if all(len(m) <= 1 and all(v == 1 for v in m.values()) for m in held.values()):
            if any(bounds[g][0] > 0 for g in groups if g not in {x for m in held.values() for x in m}):
                raise Infeasible("no selection keeps all groups within the tolerance")
            own = [bounds[next(iter(m))] if m else (0, budget) for m in held.values()]
            counts = sampling.draw_counts(list(sizes.values()), [a for a, _ in own], [b for _, b in own], budget, seed)
            return sampling.rows_of_cells(cells, "id", "cell", dict(zip(sizes, counts, strict=True)), sizes, seed).select("id")
    drawn = rows.withColumn("_u", coin(seed, F.col(id_)))
    if n <= EXACT:
        groups = all_groups(rows, targets, membership)
        want = np.array([targets.get(g, 0.0) for g in groups])
        table = _table(drawn, "_u", id_, membership, membership, groups)
        fits = _fitting(table, n, budget, budget * np.concatenate([want + tolerance, tolerance - want]))
        found = fits.orderBy(seeded(seed, F.array_join("ids", "\n")), "ids").limit(1).first()
        if found is None:
            raise Infeasible("no selection keeps all groups within the tolerance")
        return table.filter(F.col("id").isin(found["ids"])).select("id")
    start = select(drawn, "_u", id_, membership, membership, targets, budget, tolerance)
    if len(sizes) > CELLS or start.breach:
        return start.ids
    began = {r["cell"]: r["n"] for r in cells.join(start.ids, "id", "left_semi").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    member = np.array([[held[c].get(g, 0.0) for g in groups] for c in sizes])
    want = np.array([targets.get(g, 0.0) for g in groups])
    moves = sampling.MOVES * budget * max(4, budget.bit_length())
    ended = sampling.walk_counts(np.array(list(sizes.values())), member, budget * (want - tolerance), budget * (want + tolerance), np.array([began.get(c, 0) for c in sizes]), seed, moves)
    return sampling.rows_of_cells(cells, "id", "cell", dict(zip(sizes, map(int, ended), strict=True)), sizes, seed).select("id")
