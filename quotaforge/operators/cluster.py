"""Spherical clusters and facility location over vectors: tasks hold only the centres, the driver only k x d numbers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaforge.operators.order import cut

#: Least rows of a block and blocks of a small pool (a task of Python costs as much as some ten million similarities), and bytes of the largest.
BLOCK, BLOCK_BYTES = (2048, 6), 1 << 25
#: Points and candidates whose similarities are held at once; gains that differ by less, as a part of the greatest, tie.
TILE, TIE = (512, 512), 1e-9
#: Rows beside the first block that the driver sends to all tasks to be scored exactly.
MORE = 2048
#: Points by which the candidates are guessed that a step scores first.
SAMPLE = 4096


def _units(column: pd.Series) -> np.ndarray:
    """Rows of length one; zero vectors stay zero."""
    v = np.array(column.tolist(), np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _ids(rows: DataFrame, vector: str, id_: str) -> DataFrame:
    return rows.filter(F.col(vector).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def spread_centres(points: DataFrame, k: int) -> np.ndarray:
    """Of (id, v): the least id's unit vector, then the row farthest from all chosen ones, ties by least id; one scan a step.

    Each task offers its own farthest row only.
    """
    first = points.orderBy("id").limit(1).toPandas()
    if not len(first):
        return np.zeros((0, 0))
    centres = _units(first["v"])

    def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            if len(b):
                gap = 1 - (_units(b["v"]) @ centres.T).max(1)
                at = min(np.flatnonzero(gap == gap.max()), key=lambda i: b["id"].iloc[i])
                offer = (float(gap[at]), b["id"].iloc[at], b["v"].iloc[at])
                if best is None or (-offer[0], offer[1]) < (-best[0], best[1]):
                    best = offer
        if best:
            yield pd.DataFrame({"gap": [best[0]], "id": [best[1]], "v": [list(best[2])]})

    while len(centres) < k:
        far = points.mapInPandas(farthest, "gap double, id string, v array<double>").orderBy(F.desc("gap"), "id").limit(1).toPandas()
        if far["gap"].iloc[0] <= 1e-12:
            break
        centres = np.vstack([centres, _units(far["v"])])
    return centres


def fit_clusters(rows: DataFrame, vector: str, id_: str, k: int, iterations: int = 50) -> np.ndarray:
    """Unit centres by Lloyd's rounds from spread starts: a round is one scan whose tasks emit k sums; empty clusters keep their centre."""
    points = _ids(rows, vector, id_)
    centres = spread_centres(points, k)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(centres)
        for b in batches:
            if len(b):
                u = _units(b["v"])
                np.add.at(total, (u @ centres.T).argmax(1), u)
        yield pd.DataFrame({"c": range(len(total)), "s": list(total.tolist())})

    for _ in range(iterations if len(centres) else 0):
        parts = points.mapInPandas(sums, "c int, s array<double>").select("c", F.posexplode("s").alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("x")).toPandas()
        new = np.zeros_like(centres)
        new[parts["c"], parts["d"]] = parts["x"]
        size = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(size > 1e-12, new / np.maximum(size, 1e-12), centres)
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-9:
            break
    return centres


def assign_clusters(rows: DataFrame, vector: str, id_: str, centres: np.ndarray, temperature: float = 0.0) -> DataFrame:
    """(id, cluster, distance, memberships): the nearest centre, and softmax(-d^2 / T) over all (one-hot for T <= 0)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            d = np.sqrt(np.maximum(0, 2 - 2 * _units(b["v"]) @ centres.T))
            near = d.argmin(1)
            if temperature > 0:
                soft = np.exp(-(d**2 - d.min(1, keepdims=True) ** 2) / temperature)
                soft /= soft.sum(1, keepdims=True)
            else:
                soft = np.eye(len(centres))[near]
            yield pd.DataFrame({"id": b["id"], "cluster": near.astype("int32"), "distance": d[np.arange(len(d)), near], "memberships": soft.tolist()})

    return _ids(rows, vector, id_).mapInPandas(run, "id string, cluster int, distance double, memberships array<double>")


def _gain_bounds(points: DataFrame, offers: DataFrame, first: np.ndarray, parts: int = 32, rings: int = 32, levels: int = 64, angles: int = 256) -> DataFrame:
    """(id, bound) of `offers`: no gain over the coverage by the unit vector `first` is above its bound.

    Rows are counted by their nearest of a few sample rows, their angle to it and their
    coverage. By the triangle inequality an offer's similarity to a row of such a cell is at
    most the cosine of the least difference of their angles to the sample row.
    """
    centres = _units(points.orderBy(F.xxhash64("id"), "id").limit(parts).toPandas()["v"])
    angle = lambda u: np.arccos(np.clip(u @ centres.T, -1, 1))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(centres), rings, levels), np.int64)
        for b in batches:
            if len(b):
                u = _units(b["v"])
                a = angle(u)
                near = a.argmin(1)
                ring = np.minimum((a[np.arange(len(u)), near] / np.pi * rings).astype(int), rings - 1)
                level = np.clip(((u @ first + 1) / 2 * levels).astype(int), 0, levels - 1)
                np.add.at(total, (near, ring, level), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total.ravel()[at]})

    found = points.mapInPandas(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(centres) * rings * levels)
    n[found["cell"]] = found["n"]
    n = n.reshape(len(centres), rings, levels)
    low, high = np.pi / rings * np.arange(rings), np.pi / rings * np.arange(1, rings + 1)
    own = np.pi / angles * np.arange(angles)[:, None]
    most = np.cos(np.maximum(0, np.maximum(own - high, low - own - np.pi / angles)))
    least = np.arange(levels) * 2 / levels - 1
    bound = np.einsum("crl,arl->ca", n, np.maximum(0, most[:, :, None] - least))
    slack = 1e-9 * (1 + n.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at = np.minimum((angle(_units(b["v"])) / np.pi * angles).astype(int), angles - 1)
                yield pd.DataFrame({"id": b["id"], "bound": bound[np.arange(len(centres)), at].sum(1) + slack})

    return offers.select("id", "v").mapInPandas(run, "id string, bound double")


def _packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Of (k, asof, v), v a unit vector's bytes: blocks (ks, asofs, vectors) of at most `size` rows each, as bytes, in `parts` partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            while (n := sum(len(b) for b in held)) >= size or batch is None and n:
                own = pa.Table.from_batches(held).combine_chunks()
                now, held = own[:size], own[size:].combine_chunks().to_batches()
                # an Arrow column of one length a row, end to end
                yield pa.RecordBatch.from_pydict({"ks": [now["k"].to_numpy().tobytes()], "asofs": [now["asof"].to_numpy().tobytes()], "vectors": [b"".join(now["v"].to_pylist())]})

    return rows.select("k", "asof", "v").repartition(parts, "k").mapInArrow(run, "ks binary, asofs binary, vectors binary")


def _block_size(n: int, held: int, others: int = BLOCK[1]) -> tuple[int, int]:
    """Rows a block, so that with `others` blocks there are pairs enough for all cores; and the number of blocks that `n` rows fill nine tenths of, so that parts by a hash seldom need one more."""
    size = max(1, min(held, max(BLOCK[0], -(-n // max(1, BLOCK[1] ** 2 // others)))))
    return size, -(-n * 10 // (size * 9)) or 1


def _clipped(points: np.ndarray, low: np.ndarray, high: np.ndarray | None, weights: np.ndarray, units: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each unit, the weighted sum over points of its similarity less `low`, cut at 0 and (if given) at `high - low`; and a bound on that sum's error.

    In single precision the bound is that of rounded inner products of vectors of length one
    and of sums by tiles, in double a trifle of the weights.
    """
    kind, mass = np.float32 if single else np.float64, np.zeros(len(units))
    # the last component subtracts `low` inside the product
    x, u = np.column_stack([points, -low]).astype(kind), np.column_stack([units, np.ones(len(units))]).astype(kind)
    zero, w = np.zeros((TILE[0], 1), kind), weights.astype(kind)
    room = None if high is None else (high - low).astype(kind)[:, None]
    halves = single and room is None
    buffer = np.empty(TILE[0] * TILE[1], kind)
    for b in range(0, len(u), TILE[1]):
        own = np.ascontiguousarray(u[b : b + TILE[1]].T)
        for a in range(0, len(x), TILE[0]):
            at = x[a : a + TILE[0]]
            near = np.matmul(at, own, out=buffer[: len(at) * own.shape[1]].reshape(len(at), -1))
            if halves:
                np.abs(near, out=near)
            else:
                np.maximum(near, zero[: len(at)], out=near)
            if room is not None:
                np.minimum(near, room[a : a + TILE[0]], out=near)
            mass[b : b + TILE[1]] += w[a : a + TILE[0]] @ near
    # max(y, 0) = (|y| + y) / 2, where the sum of y is cheap
    total = (mass + units @ (weights @ points) - weights @ low) / 2 if halves else mass
    off = np.full(len(units), 1e-15 * weights.sum())
    if single:
        off += 2.0**-24 * 1.1 * ((points.shape[1] + 8) * (weights @ (1 + np.abs(low))) + (TILE[0] + 8) * mass) / (2 if halves else 1)
    return total, off


def _gain_parts(units: np.ndarray, asofs: np.ndarray, points: np.ndarray, weights: np.ndarray, chosen: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a block of weighted points adds to the gains of `units` over the coverage by all `chosen` rows, and a bound on its error.

    For a unit whose gain is known over the first `asof` of them (0: not known), it is the
    change since then, to which only points that a later one covers better contribute.
    """
    total, off = np.zeros(len(units)), np.zeros(len(units))
    cover = np.maximum.accumulate(points @ chosen.T, axis=1)
    new = cover[:, -1]
    for asof in np.unique(asofs):
        own = np.flatnonzero(asofs == asof)
        if asof:
            at = np.flatnonzero(new > cover[:, asof - 1])
            lost, off[own] = _clipped(points[at], cover[at, asof - 1], new[at], weights[at], units[own], single)
            total[own] = -lost
        else:
            total[own], off[own] = _clipped(points, new, None, weights, units[own], single)
    return total, off


def facility_location(
    rows: DataFrame, candidates: DataFrame, vector: str, id_: str, priority: str, budget: int, block: int = 512, held: int = 1 << 16
) -> DataFrame:
    """(step, id, gain): greedy choice from `candidates` of the most summed cosine similarity to every one of `rows`.

    Starts at the candidate of most priority, the greatest id on a tie; later ties (to one
    part in 10^9) go to the least id. `candidates` may be the whole pool. A table keeps for
    each candidate a bound on its gain or its gain over the first chosen rows; since gains
    only fall as coverage grows, a step scores the `block` greatest first (and, of a larger
    pool, the `block` greatest by a sample of points) and then, in one join of blocks of at most `held` vectors, those that can still win. The join computes in
    single precision and bounds its error; whatever may win by that is scored again in double
    precision, so that the choice is exact. A known gain is only corrected by the points that
    have been covered better since; equal vectors are one point. The driver holds the chosen
    rows and at most 2 * `block` + `MORE` scored ones, a task two blocks and a tile of their
    similarities. Negative similarities count as they are.
    """
    spark = rows.sparkSession
    points = cut(_ids(rows, vector, id_))
    numbered = lambda frame: frame.withColumn("k", F.monotonically_increasing_id())
    offers = cut(numbered(candidates.filter(F.col(vector).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(priority).alias("p"))))
    start = offers.orderBy(F.desc_nulls_last("p"), F.desc("id")).limit(1).toPandas()
    if not len(start) or budget <= 0:
        return spark.createDataFrame([], "step int, id string, gain double")
    chosen = _units(start["v"])
    width = chosen.shape[1]
    held = max(1, min(held, BLOCK_BYTES // (8 * max(1, width))))

    def unit_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(v=[u.tobytes() for u in _units(b["v"])])

    # equal vectors become one point, its weight in the place of `asof`
    alike = cut(numbered(points.select("v").mapInPandas(unit_bytes, "v binary").groupBy("v").agg(F.count(F.lit(1)).alias("asof"))))
    size, parts = _block_size(alike.count(), held)
    blocks = cut(_packed(alike, size, parts).select(F.col("asofs").alias("weights"), F.col("vectors").alias("points")))
    first = chosen[0]

    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(w, np.int64) @ (np.frombuffer(x).reshape(-1, width) @ first) for b in batches for w, x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_pydict({"g": [float(total)]})

    sample = alike.withColumn("key", -F.log((F.pmod(F.xxhash64("v"), F.lit(1 << 20)) + 0.5) / (1 << 20)) / F.col("asof")).orderBy("key", "v").limit(SAMPLE).toPandas()
    near_by, heavy = np.frombuffer(b"".join(sample["v"])).reshape(-1, width), sample["asof"].to_numpy(float)
    heavy = heavy / -np.expm1(-heavy * sample["key"].max()) if len(sample) else heavy

    def guessed(now: np.ndarray):
        """Gains by a sample of points, drawn by weight, in which a point stands for those as likely to be drawn."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.frombuffer(b"".join(b.column("v").to_pylist())).reshape(-1, width)
                yield pa.RecordBatch.from_pydict({"k": b.column("k"), "guess": _gain_parts(own, np.zeros(len(own), np.int32), near_by, heavy, now, True)[0]})

        return run

    def measured(found: pd.DataFrame) -> pd.DataFrame:
        """`found` (k, id), a few thousand rows at most, with their vectors and exact gains over all chosen rows; all tasks are sent the vectors."""
        found = found.merge(units.filter(F.col("k").isin(found["k"].tolist())).toPandas(), on="k")
        own, now = np.frombuffer(b"".join(found["v"])).reshape(-1, width), chosen

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, asofs = np.zeros(len(own)), np.zeros(len(own), np.int32)
            for b in batches:
                for w, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    total += _gain_parts(own, asofs, np.frombuffer(x).reshape(-1, width), np.frombuffer(w, np.int64).astype(float), now, False)[0]
            yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

        parts = blocks.mapInArrow(run, "g binary").collect()  # a row a partition
        return found.assign(gain=sum((np.frombuffer(r["g"]) for r in parts), np.zeros(len(own))))

    def scored(state: DataFrame, stale: DataFrame, many: int, single: bool) -> DataFrame:
        """`state` with the gains over all chosen rows of its `many` rows that are `stale` (k, asof)."""
        now = chosen

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[bytes, np.ndarray] = {}
            for batch in batches:
                for ks, asofs, vectors, w, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    units, others = (np.frombuffer(v).reshape(-1, width) for v in (vectors, x))
                    part = np.array(_gain_parts(units, np.frombuffer(asofs, np.int32), others, np.frombuffer(w, np.int64).astype(float), now, single))
                    total[ks] = total[ks] + part if ks in total else part
            for ks, part in total.items():
                yield pa.RecordBatch.from_pydict({"_k": np.frombuffer(ks, np.int64), "_part": part[0], "_off": part[1]})

        pairs = cut(_packed(stale.join(units, "k"), *_block_size(many, held, parts))).hint("shuffle_replicate_nl").crossJoin(blocks)
        sums = pairs.mapInArrow(run, "_k long, _part double, _off double").groupBy("_k").agg(F.sum("_part").alias("_part"), F.sum("_off").alias("_off"))
        known = lambda c: F.when(F.col("asof") == 0, 0.0).otherwise(F.col(c)) if single else F.lit(0.0)
        fresh, off = F.col("_k").isNotNull(), F.col("_off") if single else F.lit(0.0)
        new = [F.when(fresh, known(c) + p).otherwise(F.col(c)).alias(c) for c, p in (("gain", F.col("_part")), ("off", off))]
        return cut(state.join(sums, F.col("k") == F.col("_k"), "left").select("k", "id", *new, F.when(fresh, len(now)).otherwise(F.col("asof")).alias("asof")))

    def told(state: DataFrame, found: pd.DataFrame) -> DataFrame:
        """`state` with the exact gains of `found`, a few thousand rows at most."""
        own = F.broadcast(spark.createDataFrame(list(zip(found["k"].tolist(), found["gain"].tolist(), strict=True)), "_k long, _g double"))
        fresh = F.col("_k").isNotNull()
        new = [F.coalesce("_g", "gain").alias("gain"), F.when(fresh, 0.0).otherwise(F.col("off")).alias("off"), F.when(fresh, len(chosen)).otherwise(F.col("asof")).alias("asof")]
        return state.join(own, F.col("k") == F.col("_k"), "left").select("k", "id", *new)

    steps = [(1, start["id"].iloc[0], float(blocks.mapInArrow(nearness, "g double").agg(F.sum("g")).first()[0] or 0.0))]
    offers = offers.filter(F.col("id") != steps[0][1])
    bounds = _gain_bounds(points, offers.select(F.col("k").cast("string").alias("id"), "v"), first).select(F.col("id").cast("long").alias("_k"), F.col("bound").alias("gain"))
    units = cut(offers.select("k", "v").mapInPandas(unit_bytes, "k long, v binary"))
    # no gain is above gain + off
    total = units.count()
    state = cut(offers.join(bounds, F.col("k") == F.col("_k")).select("k", "id", "gain", F.lit(0.0).alias("off"), F.lit(0).alias("asof")))
    able = lambda least: F.col("gain") + F.col("off") >= least - TIE * max(1.0, least)
    while len(steps) < budget:
        head = [state.orderBy(F.desc(F.col("gain") + F.col("off")), "k").limit(block).select("k")]
        # the greatest bounds may be those of near copies of the last choice
        head += [units.mapInArrow(guessed(chosen), "k long, guess double").orderBy(F.desc("guess"), "k").limit(block).select("k")] if total > block else []
        found = state.filter(F.col("k").isin([r["k"] for h in head for r in h.collect()])).select("k", "id").toPandas()
        if not len(found):
            break
        found = measured(found)
        state, least, later = told(state, found), float(found["gain"].max()), None
        stale = state.filter((F.col("asof") < len(chosen)) & able(least)).select("k", "asof")
        if many := stale.count():
            state = scored(state, stale, many, True)
            least = max(least, state.filter(F.col("asof") == len(chosen)).agg(F.max(F.col("gain") - F.col("off"))).first()[0])
            near = state.filter((F.col("asof") == len(chosen)) & (F.col("off") > 0) & able(least))  # not in `found`
            more = near.select("k", "id").limit(MORE + 1).toPandas()
            if 0 < len(more) <= MORE:
                more = measured(more)
                state, found = told(state, more), pd.concat([found, more], ignore_index=True)
            elif len(more):
                state = scored(state, near.select("k", F.lit(0).alias("asof")), near.count(), False)
                fresh = state.filter((F.col("asof") == len(chosen)) & (F.col("off") == 0))
                most = fresh.agg(F.max("gain")).first()[0]
                later = fresh.filter(F.col("gain") >= most - TIE * max(1.0, most)).orderBy("id").limit(1).join(units, "k").first()
        if later is None:
            most = found["gain"].max()
            later = found[~(found["gain"] < most - TIE * max(1.0, most))].sort_values("id").iloc[0]
        chosen = np.vstack([chosen, np.frombuffer(later["v"])])
        steps.append((len(steps) + 1, later["id"], float(later["gain"])))
        state = cut(state.filter(F.col("id") != later["id"]))
    return spark.createDataFrame(steps, "step int, id string, gain double")
