"""SimHash near-duplicates through an inverted index of positional bytes with count filtering.

A 64-bit fingerprint has eight positional bytes. At most four differing bits touch
at most four bytes, so linked fingerprints share at least four of the eight: the
guaranteed minimum of the count filter. Lists of single positional bytes would hold
1/256 of the corpus each, so the index intersects them first: `TRIPLES` are 20 sets
of three positions of which every four positions hold one, and a fingerprint is
posted under its bytes there. Pairs that meet in a list tally their shared positional
bytes; those with four or more are verified bit by bit. Equal fingerprints are merged
before they are posted, so copies, however many, are one posting.

Long lists are split, with nothing lost: the members of a list of more than `HOT`
are posted again, under each fourth byte that a pair with a tally of four must share
too; lists that are still longer than `LONG` are cut into blocks whose pairs are
dealt over all tasks.

A list sends on only a spanning forest of its links, never all its pairs: blocks of
a list that are already in one component are skipped. Components then come from
alternating stars (`graph.components`).

Defined cases: null, empty and blank texts have fingerprint zero and are linked like
any other; fewer words than a shingle make one shingle; ties and repeated rows stay
rows of their own, in one component; null doc_ids count last in the choice of the
component's least id (null if it has no other); empty tables give no rows; columns of
the input may have any names and types.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotaforge.llm.common import cut, meet, shuffle_width, table
from quotaforge.llm.graph import components

BITS, LEAST = 4, 4
SEED = 42
BLOCK = 1024
#: Members of a list that is posted again under a fourth byte, and of one whose blocks are dealt to tasks.
HOT, LONG = 4096, 16_384
#: Of three groups of positions: all of a group, and two of one with one of the next.
PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = [
    t
    for t in combinations(range(8), 3)
    if sorted(len(set(t) & set(p)) for p in PARTS) == [0, 0, 3] or any(len(set(t) & set(PARTS[k])) == 2 and set(t) & set(PARTS[(k + 1) % 3]) for k in range(3))
]


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint over XXH64 of word shingles; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` and fp: the fingerprint as a signed long."""
    frame = docs.select(*columns, "text")

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(fp.view(np.int64))], [*columns, "fp"])

    kinds = dict(frame.dtypes)
    return frame.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "fp long"]))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the links (a, b) connect, at most one per node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether pairs pass the count filter, with four or more equal positional bytes, and differ in at most `bits` bits."""
    x = a ^ b
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    tally = 8 - np.bitwise_count(y & np.uint64(0x0101010101010101))
    return (tally >= LEAST) & (np.bitwise_count(x) <= bits)


class Joined:
    """Union of the members 0 .. n-1 by links that arrive in parts."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        p, q = self.root[p], self.root[q]
        apart = p != q
        if apart.any():
            child, top = _forest(p[apart], q[apart])
            to = np.arange(len(self.root))
            to[child] = top
            self.root = to[self.root]

    def links(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(fp)))
        return fp[child], fp[self.root[child]]


def _long_list(fp: np.ndarray, bits: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one long list, block by block; blocks whose members are joined already are skipped.

    With `start`, only links between the members before that place and those from it on, and what these imply.
    """
    joined = Joined(len(fp))
    for i in range(0, start or len(fp), BLOCK):
        x = slice(i, min(i + BLOCK, start or len(fp)))
        for j in range(max(i, start), len(fp), BLOCK):
            y, root = slice(j, j + BLOCK), joined.root
            if root[x].min() == root[x].max() == root[y].min() == root[y].max():
                continue
            p, q = np.nonzero(_near(fp[x, None], fp[None, y], bits))
            joined.add(p + i, q + j)
    return joined.links(fp)


def _verified(edge: np.ndarray, size: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the lists that start at `edge`."""
    a, b = [], []
    for k in np.flatnonzero(size > 64):
        links = _long_list(fp[edge[k] : edge[k] + size[k]], bits)
        a.append(links[0])
        b.append(links[1])
    rest = np.repeat(np.where(size <= 64, size, 0), size)
    place = np.arange(len(fp)) - np.repeat(edge, size)
    for gap in range(1, int(rest.max(initial=0))):
        at = np.flatnonzero(place + gap < rest)
        at = at[_near(fp[at], fp[at + gap], bits)]
        a.append(fp[at])
        b.append(fp[at + gap])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    return _forest(a, b)


def _mask(positions: tuple[int, ...]) -> int:
    return sum(255 << (8 * k) for k in positions)


def _lists(batches):
    """Whole lists (list number, key, fp), some at a time: rows come sorted by list, which may go on in the next batch."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty(batch.num_rows, [("n", np.int32), ("key", np.int64), ("fp", np.uint64)])
        for name in ("n", "key"):
            rows[name] = batch[name].to_numpy()
        rows["fp"] = batch["fp"].to_numpy().view(np.uint64)
        last = np.flatnonzero((rows["n"] != rows["n"][-1]) | (rows["key"] != rows["key"][-1]))
        begins = last[-1] + 1 if len(last) else 0
        if begins or (held and (held[0]["n"][0], held[0]["key"][0]) != (rows["n"][0], rows["key"][0])):
            whole = np.concatenate([*held, rows[:begins]])
            if len(whole):
                yield whole
            held = []
        held.append(rows[begins:])
    if held:
        yield np.concatenate(held)


FOUND = "kind int, n int, key long, a long, b long, block binary"


def _rows(kind: int, n=None, key=None, a=None, b=None, block=None) -> pa.RecordBatch:
    size = len(next(x for x in (a, block) if x is not None))
    fill = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x, t)
    columns = [pa.array(np.full(size, kind, np.int32)), fill(n, pa.int32()), fill(key, pa.int64()), fill(a, pa.int64()), fill(b, pa.int64()), fill(block, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "n", "key", "a", "b", "block"])


def _indexed(posted: DataFrame, bits: int, hot: int, split) -> DataFrame:
    """Links (kind 0) of the lists of `posted` (n, key, fp), and for each list longer than `hot` what `split` makes of it."""
    lists = posted.repartition(shuffle_width(posted.sparkSession), "n", "key").sortWithinPartitions("n", "key", "fp")

    def run(batches):
        for rows in _lists(batches):
            edge = np.flatnonzero(np.concatenate(([True], (rows["n"][1:] != rows["n"][:-1]) | (rows["key"][1:] != rows["key"][:-1]))))
            size, fp = np.diff(np.concatenate((edge, [len(rows)]))), rows["fp"]
            for k in np.flatnonzero(size > hot):
                yield from split(int(rows["n"][edge[k]]), fp[edge[k] : edge[k] + size[k]])
            small = np.repeat(size <= hot, size)
            size = size[size <= hot]
            a, b = _verified(np.cumsum(size) - size, size, fp[small], bits)
            yield _rows(0, a=a, b=b)

    return lists.mapInArrow(run, FOUND)


def links(distinct: DataFrame, bits: int = BITS, hot: int = HOT, long: int = LONG) -> DataFrame:
    """Spanning links (a, b) of the fingerprints in column fp that differ in at most `bits` bits."""
    if bits > 8 - LEAST:
        raise ValueError("four shared bytes are guaranteed for at most 4 differing bits")
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    masks = [_mask(t) for t in TRIPLES]
    fours = [tuple(sorted({*t, k})) for t in TRIPLES for k in range(8) if k not in t]
    number = {f: n for n, f in enumerate(dict.fromkeys(fours))}

    def by_fourth(n, fp):
        for k in range(8):
            if k not in TRIPLES[n]:
                four = tuple(sorted({*TRIPLES[n], k}))
                yield _rows(1, n=np.full(len(fp), number[four], np.int32), key=fp & np.uint64(_mask(four)), a=fp)

    def by_blocks(_, fp):
        # what a pass along the sorted list joins already needs no pairs of blocks
        joined = Joined(len(fp))
        for gap in (1, 2, 3):
            at = np.flatnonzero(_near(fp[:-gap], fp[gap:], bits))
            joined.add(at, at + gap)
        yield _rows(0, **dict(zip("ab", joined.links(fp), strict=True)))
        order = np.argsort(joined.root, kind="stable")
        fp, root = fp[order], joined.root[order]
        half = long // 2
        for i in range(0, len(fp), half):
            for j in range(i, len(fp), half):
                if root[i] != root[min(j + half, len(fp)) - 1]:  # else one component holds both
                    part = np.concatenate((fp[i : i + half], fp[j : j + half])) if j > i else fp[i : i + half]
                    yield _rows(2, n=[half if j > i else 0], block=[part.tobytes()])

    def in_blocks(batches):
        for batch in batches:
            for start, block in zip(batch["n"].to_pylist(), batch["block"], strict=True):
                a, b = _long_list(np.frombuffer(block.as_buffer(), np.uint64), bits, start)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    width = shuffle_width(distinct.sparkSession)
    posted = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(signed(m)) for m in masks])).alias("n", "key"))
    first = cut(_indexed(posted, bits, hot, by_fourth))
    # a list of four bytes can be reached from several triples
    again = first.filter("kind = 1").select("n", "key", F.col("a").alias("fp")).distinct()
    second = cut(_indexed(again, bits, long, by_blocks))
    dealt = second.filter("kind = 2").select("n", "block").repartition(width, F.xxhash64("block"))
    pairs = lambda frame: frame.filter("kind = 0").select("a", "b")
    return pairs(first).union(pairs(second)).union(dealt.mapInArrow(in_blocks, "a long, b long"))


def classes(docs: DataFrame, bits: int = BITS, width: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of its component) for each row of `docs`."""
    prints = cut(fingerprints(docs, width))
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("_rows")))
    roots = components(links(least.select("fp"), bits))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.col("_rows").alias("_copies"), F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    top = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_rows"))
    found = meet(named, cut(top), "root").select("fp", "component_id", F.col("_copies").alias("_rows"))
    return meet(prints, cut(found), "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, bits: int = BITS, width: int = 4) -> DataFrame:
    """One row of `docs` per component, all columns as they were: the one with the least doc_id (nulls last).

    Of rows that share that doc_id, the text with the least hash stays, then the row whose
    JSON form hashes least. Only ids and hashes are grouped; texts meet them by (doc_id, hash).
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    prints = cut(fingerprints(docs.select(key.alias("key"), F.col("text").cast("string").alias("text")), width, ("key",)))
    roots = components(links(cut(prints.select("fp").distinct()), bits))
    least = prints.groupBy("fp").agg(F.min("key").alias("least"))
    kept = least.join(roots, least["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("key"))
    copies = prints.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    turn = Window.partitionBy("key").orderBy(F.xxhash64(F.to_json("row")))
    first = meet(rows, cut(copies.join(kept.select("key"), "key")), "key").withColumn("turn", F.row_number().over(turn)).filter("turn = 1")
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
