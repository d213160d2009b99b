"""Hard negatives by norm-bucketed search: rows of another label whose inner product with an anchor lies in a window set by a positive.

Vectors are scaled and floored to whole numbers. The candidates are dealt by hash to shards,
sorted there by falling norm and packed into buckets of `BUCKET` rows, which are written
once with their largest norm. Anchors are packed likewise, `SCORED` at a time, in blocks of
about `BLOCK`. A task holds one block and takes one shard's buckets in their order. By
Cauchy-Schwarz no row of a bucket scores more than the anchor's norm times the bucket's, so
a bucket is left out for an anchor once that bound is below the lower limit of each of its
windows or below the k-th score the window has so far; the norms fall, so it is then done
with the shard. A first pass finds the positives (one window without limits), a second one
the negatives; the best rows of the shards are merged anchor by anchor. A task holds a
block, one bucket and its best rows, however many rows there are and however alike.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component
take no part; a shorter vector counts as filled up with zeros; scaled components beyond
`limit(dims)` count as that (2^24.5 for 64 components), so that scores and their multiples
by a hundred are exact longs; rows of the anchor's id are neither its positives nor its
negatives; rows that repeat are rows of their own, as anchors too; ties go to the smaller
id; a positive without negatives, and an empty table, give no rows. Columns other than the
three are not read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm.common import shuffle_width, table, written

#: Rows of a bucket, anchors that are scored at once, anchors of a block, rows of a shard from which on there is another one.
BUCKET, SCORED, BLOCK, SHARD = 512, 256, 8192, 8192
FAR = np.iinfo(np.int64).max >> 1
PACKED = "shard int, place int, norm double, ids binary, labels binary, vectors binary"
FOUND = "block int, place int, anchor binary, win binary, score binary, other binary"


def limit(dims: int) -> int:
    """Largest scaled component: a hundred times a score of that many components stays a long."""
    return min(math.isqrt((1 << 55) // max(dims, 1)), (1 << 31) - 1)


def taking_part(rows: DataFrame, id_: str, label: str, vector: str, anchor: Column, scale: int, dims: int) -> DataFrame:
    """Rows (id, label, anchor, v, norm) that take part; v is floor(scale * x), each x as a double."""
    v, top = F.col(vector).cast("array<double>"), float(limit(dims))
    fine = F.col(id_).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(top)), F.lit(-top))).cast("int"))
    out = rows.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def packed(rows: DataFrame, shards: int, size: int, dims: int) -> DataFrame:
    """Rows (id, label, v, norm) dealt by their ids to shards, sorted there by falling norm, `size` of them in a bucket."""
    dealt = rows.select("id", "label", "v", "norm", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("norm"), "id")

    def bucket(held, place):
        shard, norm = held[0]["shard"], held[0]["norm"]
        grid = np.zeros((len(held), dims), np.int32)
        for k, row in enumerate(held):
            grid[k, : len(row["v"])] = row["v"]
        ids, labels = (np.array([r[n] for r in held], np.int64).tobytes() for n in ("id", "label"))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (place, pa.int32()), (norm, pa.float64()), (ids, pa.binary()), (labels, pa.binary()), (grid.tobytes(), pa.binary()))], PACKED.replace(",", "").split()[::2])

    def bucketed(batches):
        held, place = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["shard"] != row["shard"] or len(held) == size):
                    yield bucket(held, place)
                    place = place + 1 if held[0]["shard"] == row["shard"] else 0
                    held = []
                held.append(row)
        if held:
            yield bucket(held, place)

    return dealt.mapInArrow(bucketed, PACKED)


@dataclass
class Rows:
    """A bucket's rows."""

    ids: np.ndarray
    labels: np.ndarray
    grid: np.ndarray
    most: int

    @classmethod
    def read(cls, row: dict, dims: int) -> Rows:
        ids = np.frombuffer(row["ids"], np.int64)
        grid = np.frombuffer(row["vectors"], np.int32).reshape(len(ids), dims)
        return cls(ids, np.frombuffer(row["labels"], np.int64), grid, int(np.abs(grid.astype(np.int64)).max(initial=0)))

    def scores(self, which: np.ndarray, other: Rows) -> np.ndarray:
        """Inner products of some rows with all of the other bucket, as exact whole numbers."""
        if self.most * other.most * self.grid.shape[1] < 1 << 53:
            return (self.grid[which].astype(np.float64) @ other.grid.T.astype(np.float64)).astype(np.int64)
        return self.grid[which].astype(np.int64) @ other.grid.T.astype(np.int64)


@dataclass
class Search:
    """Anchors with windows (low, high) of scores, and the best `k` rows of each window so far."""

    rows: Rows
    low: np.ndarray
    high: np.ndarray
    k: int
    alike: bool
    norms: np.ndarray = field(init=False)
    best: np.ndarray = field(init=False)

    def __post_init__(self):
        self.norms = np.sqrt((self.rows.grid.astype(np.float64) ** 2).sum(1))
        self.low = self.low.copy()
        self.best = np.zeros((4, 0), np.int64)  # anchor, window, score, id

    def take(self, bucket: Rows, norm: float) -> bool:
        """Looks at a bucket; False if it cannot hold anything for any anchor, nor can buckets of smaller norm."""
        open_ = self.low <= self.high
        least = np.where(open_, self.low, FAR).min(1, initial=FAR)
        alive = np.flatnonzero((self.norms * norm * (1 + 1e-9) + 1 >= least) & open_.any(1))
        if not len(alive):
            return False
        score = self.rows.scores(alive, bucket)
        most = np.where(open_, self.high, -FAR).max(1, initial=-FAR)[alive]
        same = self.rows.labels[alive][:, None] == bucket.labels
        fits = (same == self.alike) & (self.rows.ids[alive][:, None] != bucket.ids) & (score >= least[alive][:, None]) & (score <= most[:, None])
        i, j = np.nonzero(fits)
        value, i = score[i, j], alive[i]
        new = []
        for w in range(self.low.shape[1]):
            into = (value >= self.low[i, w]) & (value <= self.high[i, w])
            new.append(np.stack((i[into], np.full(into.sum(), w), value[into], bucket.ids[j[into]])))
        self.add(np.concatenate(new, 1))
        return True

    def add(self, new: np.ndarray) -> None:
        """Keeps the best k of each window; a full window's lower limit rises to its last score."""
        if not new.shape[1]:
            return
        every = np.concatenate((self.best, new), 1)
        every = every[:, np.lexsort((every[3], -every[2], every[1], every[0]))]
        slot = every[0] * self.low.shape[1] + every[1]
        starts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        last = every[:, place == self.k - 1]
        self.low[last[0], last[1]] = np.maximum(self.low[last[0], last[1]], last[2])
        self.best = every[:, place < self.k]


def best_of_shards(anchors: DataFrame, candidates: DataFrame, shards: int, blocks: int, dims: int, k: int, alike: bool) -> DataFrame:
    """For each packed row of anchors (with their windows) its best k rows a window: one pass over the candidates, then a merge of the shards."""
    spark = anchors.sparkSession
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(F.lit(0).alias("kind"), F.col("shard").alias("block"), every(shards).alias("shard"), "place", "norm", "ids", "labels", "vectors", "low", "high")
    right = candidates.select(F.lit(1).alias("kind"), every(blocks).alias("block"), "shard", "place", "norm", "ids", "labels", "vectors")
    tasks = min(shards * blocks, 4 * shuffle_width(spark) + shards)
    met = left.unionByName(right, allowMissingColumns=True).repartitionById(tasks, F.pmod(F.col("block") * shards + F.col("shard"), F.lit(tasks)).cast("int"))

    def made(key, held):
        for place, s in held.items():
            if s.best.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key[0], pa.int32()), (place, pa.int32()), *((row.tobytes(), pa.binary()) for row in s.best))], FOUND.replace(",", "").split()[::2])

    def run(batches):
        key, held, going = None, {}, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if (row["block"], row["shard"]) != key:
                    yield from made(key, held)
                    key, held, going = (row["block"], row["shard"]), {}, []
                if row["kind"] == 0:
                    rows = Rows.read(row, dims)
                    held[row["place"]] = s = Search(rows, *(np.frombuffer(row[n], np.int64).reshape(len(rows.ids), -1) for n in ("low", "high")), k, alike)
                    going.append(s)
                elif going:
                    bucket = Rows.read(row, dims)
                    going = [s for s in going if s.take(bucket, row["norm"])]
        yield from made(key, held)

    def merged(batches):
        key, best = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["place"]) != key:
                    if key is not None:
                        yield from made(key, {key[1]: best})
                    key, best = (row["block"], row["place"]), _Merge(k)
                best.add(np.stack([np.frombuffer(row[n], np.int64) for n in ("anchor", "win", "score", "other")]))
        if key is not None:
            yield from made(key, {key[1]: best})

    found = met.sortWithinPartitions("block", "shard", "kind", "place").mapInArrow(run, FOUND)
    return found.repartition(shuffle_width(spark), "block", "place").sortWithinPartitions("block", "place").mapInArrow(merged, FOUND)


class _Merge:
    """The best k of each (anchor, window) of what shards have found."""

    def __init__(self, k: int):
        self.k, self.best = k, np.zeros((4, 0), np.int64)

    def add(self, new: np.ndarray) -> None:
        every = np.concatenate((self.best, new), 1)
        every = every[:, np.lexsort((every[3], -every[2], every[1], every[0]))]
        starts = np.flatnonzero(np.concatenate(([True], (every[:2, 1:] != every[:2, :-1]).any(0))))
        place = np.arange(every.shape[1]) - np.repeat(starts, np.diff(np.append(starts, every.shape[1])))
        self.best = every[:, place < self.k]


def mine(
    rows: DataFrame, anchor: Column, id_: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each anchor's positives are its `positives` other rows of the same label of highest
    score; each positive's negatives are the first `negatives` rows of other labels whose
    score is from `low` to `high` hundredths of the positive's.
    """
    spark = rows.sparkSession
    dims = rows.agg(F.max(F.size(vector))).first()[0]
    part = taking_part(rows, id_, label, vector, anchor, scale, dims := max(dims or 0, 0))
    n, anchors = part.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    shards, blocks = max(1, min(shuffle_width(spark), -(-n // SHARD))), max(1, -(-anchors // BLOCK))
    candidates = written(packed(part, shards, BUCKET, dims))
    asked = packed(part.filter("anchor"), blocks, SCORED, dims)

    def all_open(batches):
        for batch in batches:
            size = [len(x) // 8 for x in batch["ids"].to_pylist()]
            bounds = [pa.array([np.full(m, v, np.int64).tobytes() for m in size], pa.binary()) for v in (-FAR, FAR)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *bounds], [*batch.schema.names, "low", "high"])

    asked = written(asked.mapInArrow(all_open, f"{PACKED}, low binary, high binary"))
    near = best_of_shards(asked, candidates, shards, blocks, dims, positives, True).withColumnRenamed("block", "shard")

    def windows(batches):
        for batch in batches:
            lows, highs, scores, others = [], [], [], []
            for row in batch.to_pylist():
                m = len(row["ids"]) // 8
                lo, hi, score, other = np.full((m, positives), FAR), np.full((m, positives), -FAR), np.zeros((m, positives), np.int64), np.zeros((m, positives), np.int64)
                a, s, o = (np.frombuffer(row[x], np.int64) for x in ("anchor", "score", "other"))  # by anchor and falling score
                starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
                lo[a, place], hi[a, place], score[a, place], other[a, place] = -((-low * s) // 100), (high * s) // 100, s, o
                for out, x in ((lows, lo), (highs, hi), (scores, score), (others, other)):
                    out.append(x.tobytes())
            names = [n for n in batch.schema.names if n not in ("low", "high", "anchor", "win", "score", "other")]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *(pa.array(x, pa.binary()) for x in (lows, highs, scores, others))], [*names, "low", "high", "scores", "others"])

    around = written(asked.join(near, ["shard", "place"]).select(*asked.columns, "anchor", "win", "score", "other").mapInArrow(windows, f"{PACKED}, low binary, high binary, scores binary, others binary"))
    far = best_of_shards(around, candidates, shards, blocks, dims, negatives, False).withColumnRenamed("block", "shard")

    def listed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, w, s, o = (np.frombuffer(row[x], np.int64) for x in ("anchor", "win", "score", "other"))
                ids = np.frombuffer(row["ids"], np.int64)
                scores, others = (np.frombuffer(row[x], np.int64).reshape(len(ids), positives) for x in ("scores", "others"))
                starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (w[1:] != w[:-1]))))
                rank = np.arange(1, len(a) + 1) - np.repeat(starts, np.diff(np.append(starts, len(a))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(others[a, w]), pa.array(rank, pa.int32()), pa.array(o), pa.array(scores[a, w]), pa.array(s)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return around.join(far, ["shard", "place"]).select("ids", "scores", "others", "anchor", "win", "score", "other").mapInArrow(listed, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def negatives_sql() -> str:
    return """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r a JOIN r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE alike) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10
"""
