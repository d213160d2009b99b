"""Rows that share a key belong together: components, and splits of exact sizes that never divide one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaforge.functions.expr import seeded
from quotaforge.operators.order import cut, global_rank, rank_in_groups


def key_components(rows: DataFrame, id_: str, keys: list[str]) -> DataFrame:
    """(id, component): the least id reachable over rows that share a value of any of `keys`; null keys join nothing.

    Each row is linked to the least id of each of its keys, and the links are contracted by
    stars (`llm.graph`), so the rounds run over ids alone and follow the logarithm of a
    chain's length. Ids that are no whole numbers stand for themselves by their rank.
    """
    from quotaforge.llm.common import meet
    from quotaforge.llm.graph import components

    whole = dict(rows.dtypes)[id_] in ("tinyint", "smallint", "int", "bigint")
    own = cut(rows.select(F.col(id_).alias("_id"), *[F.col(key).alias(f"_key{k}") for k, key in enumerate(keys)]))
    if not whole:
        ids = cut(global_rank(own.select("_id").filter("_id is not null").distinct(), [F.col("_id")], "_node"))
        own = cut(own.join(ids, "_id", "left"))
    else:
        own = own.withColumn("_node", F.col("_id").cast("long"))
    links = None
    for k in range(len(keys)):
        held = own.filter(F.col(f"_key{k}").isNotNull() & F.col("_node").isNotNull()).select(f"_key{k}", F.col("_node").alias("a"))
        least = cut(held.groupBy(f"_key{k}").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"))
        found = meet(held, least, f"_key{k}").select("a", "b").filter("a <> b")
        links = found if links is None else links.union(found)
    if links is None:
        return rows.select(id_, F.col(id_).alias("component"))
    roots = components(links).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    if not whole:
        roots = roots.join(ids.select(F.col("_node").alias("_root"), F.col("_id").alias("_least")), "_root").select("_node", F.col("_least").alias("_root"))
    least = F.coalesce(F.col("_root"), F.col("_id")).cast(rows.schema[id_].dataType)
    return own.select("_id", "_node").join(roots, "_node", "left").select(F.col("_id").alias(id_), least.alias("component"))


def take_exact(have: dict[int, int], target: int) -> dict[int, int] | None:
    """How many components of each size add up to `target` rows, near the pool's mix of sizes; None if none do.

    Each size first gives its proportional share, rounded down; the rest is a bounded
    subset sum over what is left. If that fails, the subset sum runs over everything.
    """
    total = sum(size * n for size, n in have.items())
    if target > total:
        return None
    start = {size: n * target // total for size, n in have.items()} if total else {}
    for base in (start, dict.fromkeys(have, 0)):
        rest = target - sum(size * n for size, n in base.items())
        chunks = []
        for size in sorted(have, reverse=True):
            left, step = min(have[size] - base[size], rest // size), 1
            while left > 0:
                chunks.append((size, min(step, left)))
                left, step = left - step, step * 2
        reach, mask = [1], (1 << (rest + 1)) - 1
        for size, n in chunks:
            reach.append((reach[-1] | reach[-1] << (size * n)) & mask)
        if reach[-1] >> rest & 1:
            out, at = dict(base), rest
            for k in range(len(chunks) - 1, -1, -1):
                size, n = chunks[k]
                if not reach[k] >> at & 1:
                    out[size] += n
                    at -= size * n
            return out
    return None


def component_split(rows: DataFrame, id_: str, keys: list[str], sizes: dict[str, int], seed: int) -> DataFrame:
    """(id, component, split): disjoint splits of exactly the given numbers of rows; a component lies in one split or none.

    Only the histogram of component sizes is looked at on the driver; components of one
    size are dealt in the order of a seeded hash. Raises where no exact split exists.
    """
    members = key_components(rows, id_, keys)
    comps = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    have = {r["size"]: r["n"] for r in comps.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    used, bounds = dict.fromkeys(have, 0), []
    for name, size in sizes.items():
        part = take_exact({s: n - used[s] for s, n in have.items()}, size)
        if part is None:
            raise ValueError(f"no whole components add up to {size} rows for {name}")
        for s, n in part.items():
            if n:
                bounds.append((s, name, used[s], used[s] + n))
                used[s] += n
    table = rows.sparkSession.createDataFrame(bounds, "_size long, split string, _after long, _upto long")
    placed = rank_in_groups(comps, "size", [seeded(seed, F.col("component")), F.col("component")], "_place")
    dealt = placed.join(F.broadcast(table), (F.col("size") == F.col("_size")) & (F.col("_place") > F.col("_after")) & (F.col("_place") <= F.col("_upto")))
    return members.join(dealt.select(F.col("component").alias("_c"), "split"), F.col("component") == F.col("_c")).select(id_, "component", "split")
