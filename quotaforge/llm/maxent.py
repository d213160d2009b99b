"""Language-model scoring with a hashed, class-factored maximum-entropy model.

P(token | context) = P(class | context) * P(slot | class, context) * P(word | slot).
Class and slot are softmaxes over hashed features of the context: a bias, the unit
before, the two units before as a bigram, and the unit before last as a skip feature
(each joined with the class for the slot). A unit is a (class, slot) pair. The `HEAD`
most frequent words of all training documents have a unit each; every other word
shares one of `GROUPS` units with the words of equal ending (a hash of its last two
bytes), in which it has its smoothed share of the group's training tokens. So each
token's probability depends on its context, at a cost of two small softmaxes.

The work, in Spark jobs:

1. One pass over the texts makes chunks: per chunk the distinct words, as 64-bit hashes,
   and the tokens as numbers of them. A chunk sends each of its words once, with its
   training count, to a bucket of hashes; so no word is hot, however frequent.
2. Buckets sum the counts of all training documents exactly and send them back to the
   chunks. The most frequent words are read off a histogram of counts and fill the head.
3. Chunks become rows of units, with sums for each document.
4. Rounds of synchronous gradient updates: tasks sum, at broadcast weights,
   observed and expected features over a fixed block of training documents (by
   hash; the last round takes all of them); shards of the tables add the tasks' sums and
   take a step, the gradient scaled by the sum of both counts. Sums are of whole numbers,
   so weights and scores do not depend on how rows are dealt to tasks, but for rounding.
5. Scoring in sparse numpy batches: equal contexts of a batch are computed once.

What is gathered grows with the corpus (words, counts, units), and the hashed features
follow the number of distinct words, up to a bound that keeps the model a few MB.

Defined cases: null texts are empty and hold the end token only; without training
documents all counts are 0 and the base score of a token is log10(1 / 1); rows that
repeat are counted each and scored alike; null doc_ids stay null and hash like any
other key; very long texts are read in whole; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm.common import shuffle_width, table, written
from quotaforge.llm.language import in_fold
from quotaforge.llm.suffixes import mixed

CLASSES, SLOTS = 32, 32
UNITS, HEAD = CLASSES * SLOTS, 24 * SLOTS
GROUPS = UNITS - HEAD
#: Hashed features of each softmax: a power of two, at least 1/`WORDS` of the distinct training words, between the bounds.
WORDS, FEATURES = 32, (1 << 12, 1 << 15)
#: Training documents fall into so many blocks by hash; each round learns from the blocks [from, to).
BLOCKS = 16
ROUNDS = ((0, 2), (0, 4), (0, 8), (0, 16), (0, 16))
#: Penalty on squared weights.
DECAY = 2.0
SHARDS = 64
#: Bytes of text in a piece that is cut into tokens at once, and in a chunk; tokens of a batch.
PIECE, CHUNK, BATCH = 1_000_000, 8_000_000, 1 << 20
#: Bytes of a body, and tokens, in one row: rows of a few hundred kB spare the JVM large arrays.
SLICE, ROW = 1 << 18, 1 << 17
#: Contexts whose softmaxes are computed at once.
STRIP = 1 << 15
#: Expected counts are summed as multiples of 2^-18.
UNIT = 1 << 18
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
END = np.uint64(0x0E5D0E5D0E5D0E5D)
GOLD = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of the hash's base and of its inverse modulo 2^64."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                grown = np.full(n, np.uint64(base))
                grown[0] = 1
                setattr(self, name, np.multiply.accumulate(grown))


POWERS = Powers()


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the blank-separated words of the bytes `flat`, A-Z lowered, their starts, and the group of their last two bytes."""
    POWERS.reach(len(flat) + 1)
    word = ~BLANK[flat]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    low = flat + ((flat >= 0x41) & (flat <= 0x5A)) * np.uint8(32)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(flat)], dtype=np.uint64)))
    h = (run[stop] - run[start]) * POWERS.down[start]
    before = np.where(stop - start > 1, low[np.maximum(stop - 2, 0)], 0) if len(start) else np.zeros(0, np.uint8)
    ending = mixed(low[stop - 1].astype(np.uint64) + before.astype(np.uint64) * np.uint64(257))
    return mixed(h + (stop - start).astype(np.uint64) * GOLD), start, (ending % np.uint64(GROUPS)).astype(np.uint8)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a few texts, the end token after each; the tokens' groups; the number of tokens of each text."""
    flat = np.frombuffer(b" ".join(texts), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    words, start, ending = word_hashes(flat) if len(flat) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    n = np.bincount(np.searchsorted(begins, start, "right") - 1, minlength=len(texts)) + 1
    is_end = np.zeros(int(n.sum()), bool)
    is_end[np.cumsum(n) - 1] = True
    h, group = np.full(len(is_end), END), np.zeros(len(is_end), np.uint8)
    h[~is_end], group[~is_end] = words, ending
    return h, group, n


def pressed(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def opened(block, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """Arrays of the given types and lengths from a compressed block."""
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(block.as_buffer()), 0, []
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def chunks(batches):
    """(doc_id, is null, held out, block) and texts, in pieces of a few MB of a chunk; None ends a chunk."""
    held, size, whole = [], 0, 0
    for batch in batches:
        columns = zip(*(batch[c].to_pylist() for c in ("doc_id", "held_out", "block")), batch["text"], strict=True)
        for doc, out, block, text in columns:
            raw = (text.as_py() or "").encode("utf-8", "replace")
            held.append(((doc or 0, doc is None, out, block), raw))
            size += len(raw)
            if size >= PIECE:
                yield held
                whole += size
                held, size = [], 0
            if whole >= CHUNK:
                yield None
                whole = 0
    if held:
        yield held
    if held or whole:
        yield None


def chunked(docs: DataFrame, held_out) -> DataFrame:
    """Rows (kind, chunk, bucket, n, m, d, block): a body for each chunk, in slices numbered up to -1, and its words for each bucket of hashes."""
    from pyspark import TaskContext

    width = shuffle_width(docs.sparkSession)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(BLOCKS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("block", F.when(F.col("held_out"), -1).otherwise(key))

    def run(batches):
        about, pieces, k = [], [], 0
        for held in chunks(batches):
            if held is not None:
                h, group, n = tokens_of([t for _, t in held])
                words, first, ids = np.unique(h, return_index=True, return_inverse=True)
                training = np.repeat([not a[2] for a, _ in held], n)
                pieces.append((words, group[first], ids.astype(np.uint32), np.bincount(ids[training], minlength=len(words))))
                about.append((np.array([a for a, _ in held], np.int64), n))
                continue
            chunk = (TaskContext.get().partitionId() << 32) + k
            words, first, same = np.unique(np.concatenate([p[0] for p in pieces]), return_index=True, return_inverse=True)
            groups = np.concatenate([p[1] for p in pieces])[first]
            count = np.bincount(same, np.concatenate([p[3] for p in pieces]), len(words)).astype(np.int64)
            place = np.split(same.astype(np.uint32), np.cumsum([len(p[0]) for p in pieces])[:-1])
            ids = np.concatenate([at[p[2]] for at, p in zip(place, pieces, strict=True)])
            docs_ = np.concatenate([a for a, _ in about])
            n = np.concatenate([n for _, n in about])
            body = pressed(words, groups, docs_, n, ids)
            slices = [body[a : a + SLICE] for a in range(0, len(body), SLICE)]
            rows = [("body", at - len(slices), len(words), len(ids), len(n), x) for at, x in enumerate(slices)]
            bucket = ((words >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)
            edge = np.searchsorted(bucket, np.arange(width + 1))
            for b in np.flatnonzero(np.diff(edge)):
                x, y = edge[b], edge[b + 1]
                rows.append(("words", int(b), int(y - x), 0, 0, pressed(words[x:y], count[x:y], groups[x:y])))
            kind, number, *sizes, blocks = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array([chunk] * len(rows), pa.int64()), pa.array(number, pa.int32()), *(pa.array(s, pa.int64()) for s in sizes), pa.array(blocks, pa.binary())],
                ["kind", "chunk", "bucket", "n", "m", "d", "block"],
            )
            about, pieces, k = [], [], k + 1

    return rows.mapInArrow(run, "kind string, chunk long, bucket int, n long, m long, d long, block binary")


def octave(c: np.ndarray) -> np.ndarray:
    """Bins of counts, eight for each doubling."""
    return np.floor(8 * np.log2(c)).astype(np.int64)


def counted(words: DataFrame) -> DataFrame:
    """Buckets of words, summed.

    kind `counts`: to each chunk the training counts of the words it sent; `bin`: number of words by octave of
    their count; `group`: distinct training words and training tokens of each group; `top`: the most frequent words.
    """
    names = ["kind", "chunk", "bucket", "key", "n", "total", "block"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        chunk, number, sizes, parts = [], None, [], []
        for batch in batches:
            for c, b, n, block in zip(batch["chunk"].to_pylist(), batch["bucket"].to_pylist(), batch["n"].to_pylist(), batch["block"], strict=True):
                if number is not None and b != number:
                    yield summed(number, chunk, sizes, parts)
                    chunk, sizes, parts = [], [], []
                number = b
                chunk.append(c)
                sizes.append(n)
                parts.append(opened(block, (np.uint64, n), (np.int64, n), (np.uint8, n)))
        if number is not None:
            yield summed(number, chunk, sizes, parts)

    def summed(number, chunk, sizes, parts):
        h, first, same = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        total = np.zeros(len(h), np.int64)
        np.add.at(total, same, np.concatenate([p[1] for p in parts]))
        group = np.concatenate([p[2] for p in parts])[first]
        rows = [("counts", c, number, None, int(n), None, pressed(x)) for c, n, x in zip(chunk, sizes, np.split(total[same], np.cumsum(sizes)[:-1]), strict=True)]
        seen = np.flatnonzero(total)
        for b, n in zip(*np.unique(octave(total[seen]), return_counts=True), strict=True):
            rows.append(("bin", None, number, int(b), int(n), None, None))
        distinct, tokens = np.bincount(group[seen], minlength=GROUPS), np.zeros(GROUPS, np.int64)
        np.add.at(tokens, group[seen], total[seen])
        rows += [("group", None, number, int(g), int(distinct[g]), int(tokens[g]), None) for g in np.flatnonzero(distinct)]
        top = seen[np.lexsort((h[seen], -total[seen]))]
        for k in np.concatenate((top[:HEAD], top[HEAD:][h[top[HEAD:]] == END])):
            rows.append(("top", None, number, int(h[k].astype(np.int64)), int(group[k]), int(total[k]), None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # a partition may hold several buckets, one after the other
    dealt = words.repartitionById(shuffle_width(words.sparkSession), F.col("bucket")).sortWithinPartitions("bucket", "chunk")
    return dealt.select("chunk", "bucket", "n", "block").mapInArrow(run, "kind string, chunk long, bucket int, key long, n long, total long, block binary")


class Vocabulary:
    """Units of words: 0 is the end, then the head's words by falling count, then the groups; with exact training counts.

    `norm` is log10 of the tokens that a group's shares are taken of; `start` the counts of all units.
    """

    def __init__(self, top: list[tuple[int, int, int]], groups: list[tuple[int, int, int]]):
        """`top`: (hash, group, count), the end first, then by falling count; `groups`: (group, distinct words, tokens) over all training words."""
        distinct, tokens = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        for g, n, t in groups:
            distinct[g], tokens[g] = n, t
        self.total, self.distinct = int(tokens.sum()), int(distinct.sum())
        words = top if top and top[0][0] == int(END) else [(int(END), 0, 0), *top[: HEAD - 1]]
        for _, g, t in words:
            distinct[g] -= t > 0
            tokens[g] -= t
        hashes = np.array([t[0] for t in words], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.unit = hashes[order], order.astype(np.uint16)
        self.norm = np.log10(tokens + distinct + 1.0)
        self.start = np.zeros(UNITS, np.int64)
        self.start[: len(hashes)] = [t[2] for t in words]
        self.start[HEAD:] = tokens

    def __call__(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.unit[at], group.astype(np.uint16) + np.uint16(HEAD))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head: words above a threshold of the histogram of counts, then the most frequent of them."""
    bins = sorted(counts.filter("kind = 'bin'").groupBy("key").agg(F.sum("n").alias("n")).collect(), reverse=True)
    least, held = 0, 0
    for least, n in bins:
        held += n
        if held >= HEAD:
            break
    is_end = F.col("key") == int(END)
    top = counts.filter("kind = 'top'").filter((F.floor(F.log2("total") * 8 + 1e-6) >= least) | is_end)
    top = [tuple(r) for r in top.orderBy(is_end.desc(), F.desc("total"), "key").limit(HEAD).select("key", "n", "total").collect()]
    groups = [tuple(r) for r in counts.filter("kind = 'group'").groupBy("key").agg(F.sum("n"), F.sum("total")).collect()]
    return Vocabulary(top, groups)


def with_units(bodies: DataFrame, counts: DataFrame, words) -> DataFrame:
    """Rows (docs, tokens, about, units) of some documents of a chunk: for each document its id and sums, for each token its unit."""

    def run(batches):
        number, body, sizes, held = None, [], None, []
        for batch in batches:
            columns = zip(*(batch[c].to_pylist() for c in ("chunk", "kind")), zip(*(batch[c].to_pylist() for c in ("n", "m", "d")), strict=True), batch["block"], strict=True)
            for chunk, kind, size, block in columns:
                if chunk != number:
                    if body:
                        yield from done(body, sizes, held)
                    number, body, sizes, held = chunk, [], size, []
                if kind == "body":  # sorted before the counts
                    body.append(block.as_py())
                else:
                    held.append(opened(block, (np.int64, size[0]))[0])
        if body:
            yield from done(body, sizes, held)

    def done(body, sizes, held):
        n, m, d = sizes
        h, group, about, n, ids = opened(pa.scalar(b"".join(body)), (np.uint64, n), (np.uint8, n), (np.int64, 4 * d), (np.int64, d), (np.uint32, m))
        c, unit, v = np.concatenate(held), words.value(h, group), words.value
        logs = np.log10(c + 1.0)
        share = np.where(unit >= HEAD, logs - v.norm[np.maximum(unit, HEAD) - HEAD], 0.0)
        last, about = np.cumsum(n), about.reshape(-1, 4)
        add = lambda x: np.add.reduceat(x[ids], last - n)
        known, logs, share = add((c > 0).astype(np.int64)), add(logs), add(share)
        a = 0
        while a < d:
            begin = int(last[a] - n[a])
            b = max(a + 1, int(np.searchsorted(last, begin + ROW, "right")))
            part, end = slice(a, b), int(last[b - 1])
            made = pressed(about[part], n[part], known[part], logs[part], share[part])
            units = pressed(n[part], about[part, 3], unit[ids[begin:end]])
            yield pa.RecordBatch.from_arrays([pa.array([b - a], pa.int64()), pa.array([end - begin], pa.int64()), pa.array([made], pa.binary()), pa.array([units], pa.binary())], ["docs", "tokens", "about", "units"])
            a = b

    none = F.lit(None).cast("long")
    back = counts.filter("kind = 'counts'").select("kind", "chunk", "bucket", "n", none.alias("m"), none.alias("d"), "block")
    both = bodies.select("kind", "chunk", "bucket", "n", "m", "d", "block").union(back)
    both = both.repartition(shuffle_width(bodies.sparkSession), "chunk").sortWithinPartitions("chunk", "bucket")
    return both.mapInArrow(run, "docs long, tokens long, about binary, units binary")


def trigrams(units: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per token (the unit before last, the unit before, its own unit) as one number; the end stands before a text."""
    one, two = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    one[1:], two[2:] = units[:-1], units[:-2]
    # the end of the text before, unit 0, is what stands before a text already
    two[np.cumsum(n) - n] = 0
    return (two * UNITS + one) * UNITS + units


def features(context: np.ndarray, size: int, kind: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows of the bias, the unit before, the bigram and the skip feature; with `kind`, those of the softmax inside the class."""
    one, two = (context % UNITS).astype(np.uint64), (context // UNITS).astype(np.uint64)
    first, own = (1, np.uint64(0)) if kind is None else (CLASSES, (kind.astype(np.uint64) + np.uint64(1)) << np.uint64(24))
    bias = np.zeros(len(one), np.int64) if kind is None else kind
    row = lambda h: first + ((mixed(h) >> np.uint64(32)) * np.uint64(size - first) >> np.uint64(32)).astype(np.int64)
    return [bias, row(own + one + np.uint64(1 << 32)), row(own + one + (two << np.uint64(10)) + np.uint64(2 << 32)), row(own + two + np.uint64(3 << 32))]


def log_softmax(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """(outcome, context) log probabilities; `weights` are (outcome, feature)."""
    z = weights.take(rows[0], axis=1)
    for at in rows[1:]:
        z += weights.take(at, axis=1)
    z -= z.max(axis=0)
    z -= np.log(np.exp(z).sum(axis=0))
    return z


def distinct_runs(sorted_: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)


def factored(keys: np.ndarray, size: int):
    """For each factor of sorted distinct trigrams: starts of its distinct contexts, their feature rows, and the targets."""
    unit = keys % UNITS
    for factor, (of, target) in enumerate(((keys // UNITS, unit // SLOTS), (keys // SLOTS, unit % SLOTS))):
        at = distinct_runs(of)
        context = of[at]
        yield factor, at, features(context, size) if factor == 0 else features(context // CLASSES, size, context % CLASSES), target


class Sums:
    """Observed and expected features of both softmaxes at given weights, as whole numbers (the expected ones in units of 2^-18)."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.seen, self.due = weights, np.zeros(weights.shape), np.zeros(weights.shape)

    def add(self, keys: np.ndarray) -> None:
        keys, size = np.sort(keys), self.weights.shape[2]
        at = distinct_runs(keys)
        keys, n = keys[at], np.diff(np.concatenate((at, [len(keys)])))
        for factor, at, rows, target in factored(keys, size):
            times = np.add.reduceat(n, at).astype(np.float64)
            each = np.diff(np.concatenate((at, [len(keys)])))
            for row in rows:
                flat = np.repeat(row, each)
                flat += target * size
                self.seen[factor] += np.bincount(flat, n, self.seen[factor].size).reshape(self.seen[factor].shape)
            for a in range(0, len(times), STRIP):
                part = [row[a : a + STRIP] for row in rows]
                due = np.rint(np.exp(log_softmax(self.weights[factor], part)) * np.float32(UNIT))
                part = np.concatenate(part)
                for outcome, of in enumerate(due):
                    self.due[factor, outcome] += np.bincount(part, np.tile(of * times[a : a + STRIP], len(rows)), size)


def stepped(weights: np.ndarray, seen: np.ndarray, due: np.ndarray, decay: np.ndarray) -> np.ndarray:
    """Weights after one step along the gradient of the penalised log likelihood, scaled by a bound of its curvature."""
    slope = seen - due - decay * weights
    return (weights + slope / (seen + due + np.maximum(decay, 0.5))).astype(np.float32)


def first_weights(words: Vocabulary) -> np.ndarray:
    """(factor, outcome, feature) weights: biases from the units' counts, 0 elsewhere."""
    start, size = words.start, FEATURES[0]
    while size < FEATURES[1] and size * WORDS < words.distinct:
        size *= 2
    count = (start + 0.5).reshape(CLASSES, SLOTS)
    weights = np.zeros((2, max(CLASSES, SLOTS), size), np.float32)
    weights[0, :, 0] = np.log(count.sum(axis=1) / count.sum())
    weights[1, :, :CLASSES] = np.log(count / count.sum(axis=1, keepdims=True)).T
    return weights


def decays(size: int, places: np.ndarray) -> np.ndarray:
    """The penalty of the weights at flat `places`; biases have none."""
    factor, feature = places // (max(CLASSES, SLOTS) * size), places % size
    return np.where(feature < np.where(factor == 0, 1, CLASSES), 0.0, DECAY)


def packed(weights: np.ndarray) -> bytes:
    """Weights as they are broadcast: those of features that were never seen are 0 and take no space."""
    return pressed(weights)


def unpacked(block: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.float32).reshape(2, max(CLASSES, SLOTS), -1)


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bytes of whole numbers, least significant ones first: the planes of small numbers are mostly 0 and compress."""
    return numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T.copy()


def from_planes(raw: np.ndarray) -> np.ndarray:
    return raw.reshape(8, -1).T.copy().view(np.int64)[:, 0].astype(np.float64)


def train(chunks_: DataFrame, weights: np.ndarray, rounds=ROUNDS) -> np.ndarray:
    """Weights after the rounds of synchronous updates; `chunks_` has docs, tokens and units."""
    spark = chunks_.sparkSession
    schema = "shard int, part binary"
    for low, high in rounds:
        given = spark.sparkContext.broadcast(packed(weights))

        def summed(batches, given=given, low=low, high=high):
            sums, held, size = Sums(unpacked(given.value)), [], 0
            for batch in batches:
                for d, m, block in zip(batch["docs"].to_pylist(), batch["tokens"].to_pylist(), batch["units"], strict=True):
                    n, of, units = opened(block, (np.int64, d), (np.int64, d), (np.uint16, m))
                    chosen = np.repeat((of >= low) & (of < high), n)
                    keys = trigrams(units, n)[chosen]
                    for a in range(0, len(keys), BATCH):
                        held.append(keys[a : a + BATCH])
                        size += len(held[-1])
                        if size >= BATCH:
                            sums.add(np.concatenate(held))
                            held, size = [], 0
            if size:
                sums.add(np.concatenate(held))
            if sums.seen.any():
                parts = zip(sums.seen.reshape(SHARDS, -1), sums.due.reshape(SHARDS, -1), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array([pressed(*map(planes, p)) for p in parts], pa.binary())], ["shard", "part"])

        def taken(batches, given=given):
            held: dict[int, list[np.ndarray]] = {}
            weights = unpacked(given.value)
            features_, old = weights.shape[2], weights.reshape(SHARDS, -1)
            size = old.shape[1]
            for batch in batches:
                for shard, block in zip(batch["shard"].to_pylist(), batch["part"], strict=True):
                    parts = [from_planes(x) for x in opened(block, (np.uint8, 8 * size), (np.uint8, 8 * size))]
                    if shard in held:
                        for total, part in zip(held[shard], parts, strict=True):
                            total += part
                    else:
                        held[shard] = parts
            for shard, (seen, due) in held.items():
                new = stepped(old[shard], seen, due / UNIT, decays(features_, np.arange(shard * size, (shard + 1) * size)))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([new.tobytes()], pa.binary())], ["shard", "part"])

        # a task sends sums of a fixed size, so there are no more tasks than keep all cores busy
        rows = chunks_.select("docs", "tokens", "units").coalesce(2 * spark.sparkContext.defaultParallelism)
        made = rows.mapInArrow(summed, schema).repartition(SHARDS, "shard").mapInArrow(taken, schema).collect()
        weights = weights.copy()
        for shard, part in made:
            weights.reshape(SHARDS, -1)[shard] = np.frombuffer(part, np.float32)
        given.destroy()
    return weights


def log10_units(weights: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """log10 P of each token's unit in its context; equal trigrams are computed once."""
    packed = np.sort((keys << 32) | np.arange(len(keys)))
    order, sorted_ = packed & 0xFFFFFFFF, packed >> 32
    at = distinct_runs(sorted_)
    keys = sorted_[at]
    out = np.zeros(len(keys))
    for factor, first, rows, target in factored(keys, weights.shape[2]):
        each = np.diff(np.concatenate((first, [len(keys)])))
        for a in range(0, len(first), STRIP):
            part = slice(first[a], first[a] + int(each[a : a + STRIP].sum()))
            of = np.repeat(np.arange(len(each[a : a + STRIP])), each[a : a + STRIP])
            out[part] += log_softmax(weights[factor], [row[a : a + STRIP] for row in rows])[target[part], of]
    each = np.empty(len(packed))
    each[order] = np.repeat(out, np.diff(np.concatenate((at, [len(packed)]))))
    return each / np.log(10)


def score(docs: DataFrame, held_out) -> DataFrame:
    """One row per row of `docs`: counts, base score and the model's log10 probability; `held_out` marks rows not learned from."""
    spark = docs.sparkSession
    dealt = written(chunked(docs, held_out))
    counts = written(counted(dealt.filter("kind = 'words'")))
    words = vocabulary(counts)
    shared = spark.sparkContext.broadcast(words)
    made = written(with_units(dealt.filter("kind = 'body'"), counts, shared))
    given = spark.sparkContext.broadcast(packed(train(made, first_weights(words))))
    norm, total = float(np.log10(words.total + words.distinct + 1)), words.total

    def scored(batches):
        weights, held, size = unpacked(given.value), [], 0
        for batch in batches:
            for d, m, about, block in zip(batch["docs"].to_pylist(), batch["tokens"].to_pylist(), batch["about"], batch["units"], strict=True):
                ids, n, *sums = opened(about, (np.int64, 4 * d), (np.int64, d), (np.int64, d), (np.float64, d), (np.float64, d))
                held.append((ids.reshape(-1, 4), n, *sums, trigrams(opened(block, (np.int64, d), (np.int64, d), (np.uint16, m))[2], n)))
                size += m
                if size >= BATCH:
                    yield done(weights, held)
                    held, size = [], 0
        if held:
            yield done(weights, held)

    def done(weights, held):
        ids, n, known, logs, share, keys = map(np.concatenate, zip(*held, strict=True))
        model = np.concatenate([log10_units(weights, keys[a : a + BATCH]) for a in range(0, len(keys), BATCH)])
        model = np.add.reduceat(model, np.cumsum(n) - n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:, 0], pa.int64(), mask=ids[:, 1] > 0), pa.array(ids[:, 2] > 0), pa.array(n), pa.array(known),
                pa.array([total] * len(n), pa.int64()), pa.array(logs - n * norm), pa.array(model + share),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return made.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 7, 2))
