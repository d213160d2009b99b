"""Removal of repeated byte strings by a range-partitioned sparse suffix array.

Every string of `length` bytes (a window) that also starts earlier is to be removed.
Suffixes are taken at anchors only: the place of the least-hashed `GRAM`-byte token
run in each window (leftmost on ties). Equal windows have equal anchors at equal
offsets, so comparing anchored suffixes with their left context finds every repeat,
with about one suffix in 40 bytes.

1. Splitters are sampled: a bounded sample of documents gives leading tokens, whose
   quantiles cut the order of suffixes into buckets. Leading tokens that fill more
   than one bucket own a run of equal splitters and are dealt over those buckets.
2. Workers cut documents into anchored pieces, range-partition them by their leading
   tokens and send each bucket one compressed block per batch.
3. A bucket drops tokens it holds once, sorts the other suffixes by multikey quicksort
   (8-byte characters, all runs of equal prefixes refined together), their reversed left
   contexts likewise, and finds the classes of equal windows from the common prefixes.
   The first window of each class stays, later ones are removed.
4. Windows of tokens that own several buckets, or that a bucket holds more than `STEP`
   times and takes in parts, are compared across these boundaries: each bucket or part
   sends the first place of each of their classes, the least place is taken by key, and
   windows after it are removed.
5. Removed windows meet their documents again by key, and the rest is cut out.

Memory: a bucket's pieces (a few times its share of the text, so the number of buckets
follows the shuffle width) and tables for `STEP` suffixes; the splitters are at most
`SPLITTERS` numbers. In a run of equal bytes every place is an anchor; their pieces
overlap, and shared bytes are sent and held once.

Defined cases: null and empty texts have no bytes; texts shorter than `length` stay;
the order is doc_id (null last), then a hash of the text, then the start, so rows that
repeat both id and text count as one document and get the same result; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm.common import shuffle_width, table, written

LENGTH, GRAM = 100, 16
#: Bounds of the splitters: documents in the sample, anchors taken of each, buckets.
SAMPLE, PER_DOC, SPLITTERS = 4000, 50, 100_000
#: Suffixes that a bucket compares at once.
STEP = 100_000
LAST = np.iinfo(np.int64).max
#: Bytes of text that a worker cuts at once.
CHUNK = 16_000_000
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of all `GRAM`-byte strings of the bytes `x`: 8-byte characters mixed."""
    n = len(x) - GRAM + 1
    word = np.zeros(len(x) - 7, np.uint64)
    for k in range(8):
        word |= x[k : len(x) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return chars_hash([word[8 * k : 8 * k + n] for k in range(GRAM // 8)])


def chars_hash(chars: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(chars[0]), np.uint64)
    for k, c in enumerate(chars):
        h = mixed(h + c * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return h


def hashes_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`gram_hashes` at the places `at` only."""
    rows = x[at[:, None] + np.arange(GRAM)]
    return chars_hash(list(rows.view(">u8").astype(np.uint64).T))


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each run of `width` values, the leftmost on ties."""
    low, at = h.copy(), np.arange(len(h), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        n = len(low) - step
        later = low[step:] < low[:n]
        at = np.where(later, at[step:], at[:n])
        low = np.where(later, low[step:], low[:n])
        span += step
    return at


@dataclass
class Pieces:
    """Anchored pieces: bytes `flat[start : start + size]`, the anchor `left` bytes in, of windows `first` to `last` (offsets before the anchor)."""

    anchor: np.ndarray  # place of the anchor in its text
    low: np.ndarray  # least offset of a window's start before the anchor
    high: np.ndarray  # largest
    lead: np.ndarray  # order of the suffix: leading tokens, then their hash


def pieces(x: np.ndarray, length: int = LENGTH) -> Pieces | None:
    """All anchored pieces of one text's bytes."""
    if len(x) < length:
        return None
    h = gram_hashes(x)
    at = window_argmin(h, length - GRAM + 1)
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    stop = np.concatenate((edge[1:], [len(at)])) - 1
    anchor = at[edge].astype(np.int64)
    return Pieces(anchor, anchor - stop, anchor - edge, leads(x, anchor, h[anchor]))


def leads(x: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order of the suffixes at the places `at`: four bytes, then 32 bits of the token run's hash."""
    lead = h >> np.uint64(32)
    for k in range(4):
        lead |= x[at + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return lead


def multikey_order(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of `chars` (8-byte characters as columns) and the common 8-byte characters of neighbours.

    Multikey quicksort: rows are partitioned by one character, then each run of equal
    rows by the next; the runs of one depth are refined together.
    """
    n, depth = chars.shape
    order = np.arange(n)
    run = np.zeros(n, np.int64)
    common = np.zeros(max(n - 1, 0), np.int64)
    open_ = np.arange(n)  # places that still lie in a run of two or more
    for k in range(depth):
        if not len(open_):
            break
        key = chars[order[open_], k]
        sort = np.lexsort((key, run[open_]))
        order[open_], key = order[open_][sort], key[sort]
        own = run[open_]
        same = (own[1:] == own[:-1]) & (key[1:] == key[:-1]) & (open_[1:] == open_[:-1] + 1)
        common[open_[1:][same] - 1] = k + 1
        head = np.concatenate(([True], ~same))
        run[open_] = open_[np.flatnonzero(head)][np.cumsum(head) - 1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        open_ = open_[keep]
    return order, common


def ranks_by_prefix(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each byte row in sorted order, and the bytes that neighbours in that order share."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    order, common = multikey_order(padded.view(">u8"))
    shared = np.minimum(common * 8, width)
    part = np.flatnonzero(shared < width)
    if len(part):
        a, b = order[part], order[part + 1]
        at = shared[part]
        going = np.ones(len(part), bool)
        for k in range(8):
            place = np.minimum(at + k, width - 1)
            going &= (at + k < width) & (rows[a, place] == rows[b, place])
            shared[part] += going
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, shared


HEAD = np.dtype([("doc", "<i8"), ("hash", "<i4"), ("anchor", "<i8"), ("lead", "<u8"), ("low", "u1"), ("high", "u1"), ("lap", "u1")])
#: What is sent of it: the lead is made again from the bytes.
SENT = ("doc", "hash", "anchor", "low", "high", "lap")
LEVEL = 3


def pack(rows: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """One bucket's pieces as a compressed block; bytes that a piece shares with the one before it (`lap`) are sent once."""
    import zstandard

    stops = starts + sizes
    rows["lap"][1:] = (starts[1:] >= starts[:-1]) & (starts[1:] < stops[:-1])
    rows["lap"][:1] = 0
    begin = np.where(rows["lap"] > 0, np.concatenate((starts[:1], stops[:-1])), starts)
    more = stops - begin
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(more)[:-1])), more) + np.arange(more.sum())
    # bytes of one weight together, numbers as differences, compress better
    plain = [rows["doc"], rows["hash"], rows["anchor"]]
    split = [np.diff(c, prepend=c.dtype.type(0)).view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in plain]
    columns = [*split, *(rows[c].tobytes() for c in ("low", "high", "lap"))]
    raw = len(rows).to_bytes(8, "little") + b"".join(columns) + flat[at].tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def unpack(block: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their bytes, and how many of these each row adds: its piece ends where the sum of these stands."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at = int.from_bytes(raw[:8], "little"), 8
    rows = np.empty(n, HEAD)
    for c in SENT:
        kind = HEAD[c]
        part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        rows[c] = part if kind.itemsize == 1 else np.cumsum(np.ascontiguousarray(part.reshape(-1, n).T).view(kind).ravel(), dtype=kind)
        at += n * kind.itemsize
    more = rows["high"].astype(np.int64) - rows["low"] + length
    stop = rows["anchor"] - rows["low"] + length
    lap = rows["lap"][1:] > 0
    more[1:][lap] = np.diff(stop)[lap]
    return rows, np.frombuffer(raw, np.uint8, offset=at), more


def deal(lead: np.ndarray, spread: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Bucket of each suffix; one whose lead equals a run of splitters goes to one of that run's buckets."""
    left, right = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
    wide = right - left > 1
    return np.where(wide, left + 1 + (spread % np.maximum(right - left - 1, 1).astype(np.uint64)).astype(np.int64), right)


def shared_leads(splitters: np.ndarray) -> np.ndarray:
    """Leads that own more than one bucket."""
    return np.unique(splitters[2:][(splitters[2:] == splitters[1:-1]) & (splitters[1:-1] == splitters[:-2])]) if len(splitters) > 2 else splitters[:0]


def sampled_splitters(docs: DataFrame, buckets: int, length: int = LENGTH) -> np.ndarray:
    """Quantiles of the leads of a bounded sample of documents, `buckets` - 1 of them."""

    def run(batches):
        for batch in batches:
            leads = []
            for text in batch["text"]:
                p = pieces(np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8), length)
                if p is not None:
                    step = max(1, len(p.lead) // PER_DOC)
                    leads.append(p.lead[::step][:PER_DOC])
            leads = np.concatenate(leads) if leads else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(leads.view(np.int64))], ["lead"])

    total = docs.count()
    part = docs
    if total > SAMPLE:
        part = docs.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / total))
    leads = np.array([r[0] for r in part.select("text").mapInArrow(run, "lead long").collect()], np.int64).view(np.uint64)
    buckets = min(buckets, SPLITTERS)
    if not len(leads) or buckets < 2:
        return np.zeros(0, np.uint64)
    leads.sort()
    return leads[(np.arange(1, buckets) * len(leads)) // buckets]


def text_hash():
    """32 bits that tell the texts of one doc_id apart."""
    return F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def dealt(docs: DataFrame, splitters: np.ndarray, length: int = LENGTH) -> DataFrame:
    """(bucket, block): the pieces of all documents."""

    def run(batches):
        for batch in batches:
            held: list = []
            size = 0
            for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"], strict=True):
                held.append((LAST if doc is None else doc, key, (text.as_py() or "").encode("utf-8", "replace")))
                size += len(held[-1][2])
                if size >= CHUNK:
                    yield from sent(held)
                    held, size = [], 0
            yield from sent(held)

    def sent(held):
        flat = np.frombuffer(b"".join(t for *_, t in held), np.uint8)
        rows, starts, sizes, base = [], [], [], 0
        for doc, key, text in held:
            p = pieces(flat[base : base + len(text)], length)
            if p is not None:
                own = np.empty(len(p.anchor), HEAD)
                own["doc"], own["hash"], own["anchor"], own["lead"], own["low"], own["high"] = doc, key, p.anchor, p.lead, p.low, p.high
                rows.append(own)
                starts.append(base + p.anchor - p.high)
                sizes.append(p.high - p.low + length)
            base += len(text)
        if not rows:
            return
        rows, starts, sizes = np.concatenate(rows), np.concatenate(starts), np.concatenate(sizes)
        spread = mixed(rows["doc"].astype(np.uint64) + mixed(rows["hash"].astype(np.uint64) + rows["anchor"].astype(np.uint64)))
        bucket = deal(rows["lead"], spread, splitters)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0)))
        numbers, blocks = [], []
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            own = order[a:b]
            numbers.append(int(bucket[own[0]]))
            blocks.append(pack(rows[own], flat, starts[own], sizes[own]))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    slim = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "bucket int, block binary")


def first_places(rows: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each row the least place rank among the rows of its group."""
    order = np.lexsort((rank, group))
    head = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    least = rank[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    out = np.empty(len(rows), rank.dtype)
    out[order] = least
    return out


def contexts(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Right contexts (from the anchor) and reversed left contexts, zero-filled to equal widths."""
    high, low = rows["high"].astype(np.int64), rows["low"].astype(np.int64)
    anchor = ends - (length - low)
    span, back = np.arange(length), np.arange(1, length - GRAM + 1)
    right, left = np.zeros((len(rows), length), np.uint8), np.zeros((len(rows), len(back)), np.uint8)
    for a in range(0, len(rows), 4096):  # the places take eight times the room of the bytes
        own = slice(a, a + 4096)
        at = anchor[own, None]
        right[own] = np.where(span < (length - low)[own, None], flat[np.minimum(at + span, len(flat) - 1)], 0)
        left[own] = np.where(back <= high[own, None], flat[np.maximum(at - back, 0)], 0)
    return right, left


def compared(blocks: list[bytes], wide: np.ndarray, length: int = LENGTH, step: int = STEP):
    """Of one bucket: (doc, hash, start, end) of removed runs of windows, and the windows to compare across boundaries.

    The latter are (key, doc, hash, start), one for each window that is first here of the
    leads that other buckets hold too, or that hold more than `step` suffixes and are cut.
    """
    parts = [unpack(b, length) for b in blocks]
    rows, flat, ends = (np.concatenate([p[k] for p in parts]) for k in range(3))
    ends = np.cumsum(ends)
    del parts
    for a in range(0, len(rows), step):
        at = (ends - length + rows["low"])[a : a + step]
        rows["lead"][a : a + step] = leads(flat, at, hashes_at(flat, at))
    # tokens held once are no repeats, unless other buckets hold them too
    _, at, many = np.unique(rows["lead"], return_inverse=True, return_counts=True)
    keep = (many[at] > 1) | np.isin(rows["lead"], wide)
    rows, ends = rows[keep], ends[keep]
    out, across = [], []
    order = np.argsort(rows["lead"], kind="stable")
    rows, ends = rows[order], ends[order]
    head = np.flatnonzero(np.concatenate(([True], rows["lead"][1:] != rows["lead"][:-1]))) if len(rows) else np.zeros(0, np.int64)
    # `step` suffixes at a time bound the context tables: whole leads, but a lead of more is cut, and its parts are compared like buckets
    at = 0
    while at < len(rows):
        stop, own = min(at + step, len(rows)), wide
        if stop < len(rows) and rows["lead"][stop] == rows["lead"][stop - 1]:
            first = int(head[np.searchsorted(head, stop, "right") - 1])
            if first > at:
                stop = first
            else:
                own = np.append(own, rows["lead"][at])
        if at and rows["lead"][at] == rows["lead"][at - 1]:
            own = np.append(own, rows["lead"][at])
        found, shared = _classes(rows[at:stop], flat, ends[at:stop], own, length)
        out.append(found)
        across.append(shared)
        at = stop
    return (np.concatenate(out) if out else np.zeros(0, RUN)), (np.concatenate(across) if across else np.zeros(0, ACROSS))


RUN = np.dtype([("doc", "<i8"), ("hash", "<i4"), ("start", "<i8"), ("end", "<i8")])
ACROSS = np.dtype([("key", "<i8"), ("key2", "<i8"), ("doc", "<i8"), ("hash", "<i4"), ("start", "<i8")])


def _classes(rows: np.ndarray, flat: np.ndarray, ends: np.ndarray, wide: np.ndarray, length: int):
    right, left = contexts(flat, ends, rows, length)
    right_rank, right_shared = ranks_by_prefix(right)
    left_rank, left_shared = ranks_by_prefix(left)
    low, high = rows["low"].astype(np.int64), rows["high"].astype(np.int64)
    # place in the order of documents, by anchor: windows of one offset keep that order
    by_place = np.lexsort((rows["anchor"], rows["hash"], rows["doc"]))
    sorted_ = rows[by_place]
    new = np.concatenate(([True], (sorted_["doc"][1:] != sorted_["doc"][:-1]) | (sorted_["hash"][1:] != sorted_["hash"][:-1]) | (sorted_["anchor"][1:] != sorted_["anchor"][:-1])))
    place = np.empty(len(rows), np.int64)
    place[by_place] = np.cumsum(new)
    spread = np.isin(rows["lead"], wide)
    found, across = [], []
    for offset in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= offset) & (offset <= high))
        if not len(own):
            continue
        # classes: equal first `length - offset` bytes to the right and `offset` bytes to the left
        a = np.concatenate(([0], np.cumsum(right_shared < length - offset)))[right_rank[own]]
        b = np.concatenate(([0], np.cumsum(left_shared < offset)))[left_rank[own]] if offset else np.zeros(len(own), np.int64)
        group = a * (len(rows) + 1) + b
        least = first_places(own, group, place[own])
        later = place[own] > least
        found.append(np.stack((own[later], np.full(later.sum(), offset)), axis=1))
        first = own[~later & spread[own]]
        if len(first):
            made = np.empty(len(first), ACROSS)
            n = 8 * (length // 8)
            text = np.concatenate((left[first, :offset][:, ::-1], right[first, : length - offset]), axis=1)
            chars = np.ascontiguousarray(text[:, :n]).view(">u8").astype(np.uint64)
            rest = np.zeros((len(first), 8), np.uint8)
            rest[:, : length - n] = text[:, n:]
            chars = np.concatenate((chars, rest.view(">u8").astype(np.uint64)), axis=1)
            for name, seed in (("key", 1), ("key2", 2)):
                h = np.full(len(first), seed, np.uint64)
                for k in range(chars.shape[1]):
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + chars[:, k] + np.uint64(k + seed))
                made[name] = h.view(np.int64)
            made["doc"], made["hash"], made["start"] = rows["doc"][first], rows["hash"][first], rows["anchor"][first] - offset
            across.append(made)
    runs = np.zeros(0, RUN)
    if found:
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort((-pairs[:, 1], pairs[:, 0]))]
        # neighbouring offsets of one piece are one run of windows
        cut_ = np.concatenate(([True], (pairs[1:, 0] != pairs[:-1, 0]) | (pairs[1:, 1] != pairs[:-1, 1] - 1))) if len(pairs) else np.zeros(0, bool)
        head = np.flatnonzero(cut_)
        tail = np.concatenate((head[1:], [len(pairs)])) - 1 if len(head) else head
        runs = np.empty(len(head), RUN)
        of = pairs[head, 0]
        runs["doc"], runs["hash"] = rows["doc"][of], rows["hash"][of]
        runs["start"] = rows["anchor"][of] - pairs[head, 1]
        runs["end"] = rows["anchor"][of] - pairs[tail, 1] + length
    return runs, np.concatenate(across) if across else np.zeros(0, ACROSS)


def _columns(made: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(made[c])) for c in made.dtype.names]


def repeats(docs: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(doc, hash, start, end): byte runs to remove; they may touch or overlap. A null doc_id is the largest long."""
    if length != LENGTH and length < GRAM + 1:
        raise ValueError(f"length must exceed {GRAM}")
    spark = docs.sparkSession
    width = shuffle_width(spark)
    splitters = sampled_splitters(docs, width, length)
    wide = shared_leads(splitters)

    def run(batches):
        blocks, bucket = [], None
        for batch in batches:
            for number, block in zip(batch["bucket"].to_pylist(), batch["block"], strict=True):
                if bucket is not None and number != bucket:
                    yield from done(blocks)
                    blocks = []
                bucket = number
                blocks.append(block.as_py())
        if blocks:
            yield from done(blocks)

    def done(blocks):
        found, across = compared(blocks, wide, length, step)
        none = lambda n, kind: pa.nulls(n, kind)
        if len(found):
            yield pa.RecordBatch.from_arrays([none(len(found), pa.int64())] * 2 + _columns(found), ["key", "key2", "doc", "hash", "start", "end"])
        if len(across):
            yield pa.RecordBatch.from_arrays([*_columns(across), none(len(across), pa.int64())], ["key", "key2", "doc", "hash", "start", "end"])

    buckets = dealt(docs, splitters, length).repartitionById(len(splitters) + 1, F.col("bucket")).sortWithinPartitions("bucket")
    found = buckets.mapInArrow(run, "key long, key2 long, doc long, hash int, start long, `end` long")
    found = written(found)
    across = found.filter("key is not null")
    if across.isEmpty():
        return found.select("doc", "hash", "start", "end")
    place = F.struct("doc", "hash", "start")
    least = across.groupBy("key", "key2").agg(F.min(place).alias("first"))
    later = across.join(least, ["key", "key2"]).filter(place > F.col("first"))
    return found.filter("key is null").select("doc", "hash", "start", "end").union(later.select("doc", "hash", "start", (F.col("start") + length).alias("end")))


def removed_runs(docs: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(doc, hash, runs): the maximal removed byte runs of each document that has any, sorted."""
    listed = repeats(docs, length, step).groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_runs"))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for every in batch["_runs"]:
                flat = every.values.flatten()
                start, end = (c.to_numpy() for c in flat)
                reach = np.maximum.accumulate(end)
                head = np.concatenate(([True], start[1:] > reach[:-1]))
                at = np.flatnonzero(head)
                tail = np.concatenate((at[1:], [len(start)])) - 1
                out.append([{"start": int(a), "end": int(b)} for a, b in zip(start[at], reach[tail], strict=True)])
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["hash"], pa.array(out, kind)], ["doc", "hash", "runs"])

    return listed.mapInArrow(run, "doc long, hash int, runs array<struct<start:long,end:long>>")


def dedup(docs: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """doc_id, n_bytes, `kept` (the remaining bytes) and `runs` (what was removed) for each row of `docs`."""
    slim = docs.select(F.col("doc_id").cast("long"), text_hash().alias("_hash"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("_bytes"))
    runs = removed_runs(docs, length, step)
    both = slim.join(runs, (F.coalesce("doc_id", F.lit(int(LAST))) == F.col("doc")) & (F.col("_hash") == F.col("hash")), "left")

    def run(batches):
        for batch in batches:
            kept, sizes = [], []
            for raw, every in zip(batch["_bytes"], batch["runs"], strict=True):
                raw, at, parts = raw.as_py(), 0, []
                for r in every.as_py() or ():
                    parts.append(raw[at : r["start"]])
                    at = r["end"]
                kept.append(b"".join([*parts, raw[at:]]))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), batch["runs"]], ["doc_id", "n_bytes", "kept", "runs"])

    return both.select("doc_id", "_bytes", "runs").mapInArrow(run, "doc_id long, n_bytes long, kept binary, runs array<struct<start:long,end:long>>")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes",
        F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.when(F.col("runs").isNotNull(), F.size("runs")), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
