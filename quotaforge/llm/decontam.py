"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are lower-cased (A-Z) and cut into words; each run of 13 words (a
shorter item: all of its words) becomes one pattern of the automaton. A document
is normalised the same way into blank-separated words, scanned once, and every
match is mapped back through the word positions to byte offsets of the original.

The automaton is built in the workers from broadcast patterns. A benchmark is dealt
into shards of at most `SHARD_BYTES` of text. Up to `ROUND_SHARDS` of them are broadcast
at a time: a task holds a part of its texts and takes one automaton after the other over
it. That is one scan for most benchmarks; for a larger one the texts get row numbers and
are written once, each round adds a table of hits alone, and its broadcasts are removed.

Defined cases: null or wordless texts have no words and are never contaminated;
null or wordless items have no windows; windows that several items share count
for each; items with one id count once; rows that repeat stay rows; an empty
benchmark hits nothing. Input columns other than id and text are not read by
`scan`, and `clean` keeps all input columns whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm.common import cut, table

WINDOW = 13
#: Bytes of benchmark text in one automaton, shards that are broadcast at a time, and bytes of texts that a task holds.
SHARD_BYTES, ROUND_SHARDS, HELD_BYTES = 4_000_000, 8, 64_000_000
#: Lower case and blanks: what is no word byte (words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z were lowered) is a blank.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def fold_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def item_windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    words = fold_words(text)
    return [b" " + b" ".join(words[k : k + width]) + b" " for k in range(max(1, len(words) - width + 1))] if words else []


class Scanner:
    """The automaton over (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        import ahocorasick

        found: dict[bytes, set[str]] = {}
        for item, text in items:
            for window in item_windows(text, width):
                found.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, ids in found.items():
            self.automaton.add_word(window.decode("latin-1"), (window.count(b" ") - 1, tuple(ids)))
        self.some = bool(found)
        if self.some:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, maximal runs of hit words (start, end), ids of the items with occurring windows."""
        words = fold_words(text)
        if not words or not self.some:
            return len(words), [], set()
        flat = b" " + b" ".join(words) + b" "
        matches = list(self.automaton.iter(flat.decode("latin-1")))
        if not matches:
            return len(words), [], set()
        blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        last = np.searchsorted(blanks, [end for end, _ in matches])
        edges = np.zeros(len(words) + 1, np.int64)
        ids: set[str] = set()
        for end, (_, (width, which)) in zip(last, matches, strict=True):
            edges[end - width] += 1
            edges[end] -= 1
            ids.update(which)
        return len(words), runs(np.cumsum(edges)[:-1] > 0), ids


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def byte_spans(text: str, hit: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as byte spans of the original text (folding keeps every byte's place)."""
    if not hit:
        return []
    word = np.frombuffer(text.encode("utf-8", "replace").translate(FOLD), np.uint8) != 32
    where = runs(word)
    return [(where[a][0], where[b - 1][1]) for a, b in hit]


def rounds(items: DataFrame, shard_bytes: int = SHARD_BYTES, round_shards: int = ROUND_SHARDS):
    """Broadcasts of lists of shards, each a list of (item id, text): the items, dealt by hash, of one round after the other."""
    slim = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // shard_bytes) or 1
    slim = slim.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for low in range(0, n, round_shards):
        held: list[list[tuple[str, str]]] = [[] for _ in range(min(round_shards, n - low))]
        for r in slim.filter((F.col("shard") >= low) & (F.col("shard") < low + round_shards)).toLocalIterator():
            held[r["shard"] - low].append((r["item_id"], r["text"]))
        yield items.sparkSession.sparkContext.broadcast(held), n <= round_shards


@lru_cache(maxsize=1)
def _only_scanner(key: int, items: tuple) -> Scanner:
    return Scanner(items[0])


class _Once(tuple):
    """A round's shards as a cache argument: equal if they are the same broadcast."""

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return True


def scanned(given, number: int, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text the number of words, the hit runs and the items, over all shards of the broadcast with that number."""
    shards = given.value
    if len(shards) == 1:
        return list(map(_only_scanner(number, _Once(shards)), texts))
    found = [(0, [], set())] * len(texts)
    for items in shards:
        find = Scanner(items)
        for k, text in enumerate(texts):
            n, hit, ids = find(text)
            found[k] = (n, joined(n, found[k][1], hit), found[k][2] | ids)
    return found


def joined(n: int, a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of two lists of runs among `n` words."""
    if not a or not b:
        return a or b
    mask = np.zeros(n, bool)
    for x, y in [*a, *b]:
        mask[x:y] = True
    return runs(mask)


def parts(batches, text: str = "text"):
    """(batches, their texts), as many together as hold about `HELD_BYTES` of text."""
    held, texts, size = [], [], 0
    for batch in batches:
        held.append(batch)
        texts += batch[text].to_pylist()
        size += batch[text].nbytes
        if size >= HELD_BYTES:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
HITS = "array<struct<start:int,end:int>>"


def _spans(every) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in runs_] for runs_ in every], SPAN)


def _hits_by_round(rows: DataFrame, items: DataFrame, shard_bytes: int, round_shards: int, first) -> DataFrame:
    """(row, hits, items): what all rounds find in `rows` (row, text), for rows with hits."""
    tables, given = [], first
    more = rounds(items, shard_bytes, round_shards)
    next(more)[0].destroy()
    while given is not None:
        number = int(given._jbroadcast.id())

        def run(batches, given=given, number=number):
            for held, texts in parts(batches):
                found = scanned(given, number, texts)
                at = [k for k, x in enumerate(found) if x[1]]
                row = pa.concat_arrays([b["row"] for b in held]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([row, _spans(found[k][1] for k in at), pa.array([sorted(found[k][2]) for k in at], pa.list_(pa.string()))], ["row", "hits", "items"])

        tables.append(cut(rows.select("row", "text").mapInArrow(run, f"row long, hits {HITS}, items array<string>")))
        given.destroy()
        given = next(more, (None, None))[0]
    every = tables[0]
    for t in tables[1:]:
        every = every.union(t)
    # a row has at most one entry a round
    return every.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def scan(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES, spans: bool = True, round_shards: int = ROUND_SHARDS) -> DataFrame:
    """doc_id, n_words, `hits` (word runs), `items` (ids) and, by choice, `spans` (byte spans in the original text)."""
    given, alone = next(rounds(items, shard_bytes, round_shards))
    number = int(given._jbroadcast.id())
    schema = f"doc_id long, n_words long, hits {HITS}, items array<string>, spans {HITS}"
    names = ["doc_id", "n_words", "hits", "items", "spans"]
    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def answer(ids, texts, found):
        where = [byte_spans(t, x[1]) if spans else [] for t, x in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([x[0] for x in found], pa.int64()), _spans(x[1] for x in found), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())), _spans(where)], names
        )

    if alone:

        def run(batches):
            for held, texts in parts(batches):
                yield answer(pa.concat_arrays([b["doc_id"] for b in held]), texts, scanned(given, number, texts))

        return frame.mapInArrow(run, schema)

    rows = cut(frame.withColumn("row", F.monotonically_increasing_id()))
    found = _hits_by_round(rows, items, shard_bytes, round_shards, given)

    def merged(batches):
        for batch in batches:
            texts, out = batch["text"].to_pylist(), []
            for text, hits, ids in zip(texts, batch["hits"].to_pylist(), batch["items"].to_pylist(), strict=True):
                n = len(fold_words(text))
                every = [(h["start"], h["end"]) for h in hits or []]
                out.append((n, joined(n, every[:1], every), set(ids or [])))
            yield answer(batch["doc_id"], texts, out)

    return rows.join(found, "row", "left").select("doc_id", "text", "hits", "items").mapInArrow(merged, schema)


def judged(found: DataFrame) -> DataFrame:
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES, round_shards: int = ROUND_SHARDS) -> DataFrame:
    """The rows of `docs` that are not contaminated, all columns as they were."""
    given, alone = next(rounds(items, shard_bytes, round_shards))
    number = int(given._jbroadcast.id())
    good = lambda n, hit: not hit or 20 * sum(b - a for a, b in hit) < n
    if alone:

        def kept(batches):
            for held, texts in parts(batches):
                keep = [good(n, hit) for n, hit, _ in scanned(given, number, texts)]
                for batch in held:
                    yield batch.filter(pa.array(keep[: batch.num_rows], pa.bool_()))
                    keep = keep[batch.num_rows :]

        return docs.mapInArrow(kept, docs.schema)

    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    texts = rows.select("row", F.col("doc.text").cast("string").alias("text"))
    found = _hits_by_round(texts, items, shard_bytes, round_shards, given)

    def bad(batches):
        for batch in batches:
            at = []
            for k, (text, hits) in enumerate(zip(batch["text"].to_pylist(), batch["hits"].to_pylist(), strict=True)):
                n, every = len(fold_words(text)), [(h["start"], h["end"]) for h in hits]
                if not good(n, joined(n, every[:1], every)):
                    at.append(k)
            yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(at, pa.int64()))], ["row"])

    drop = texts.join(found, "row").select("row", "text", "hits").mapInArrow(bad, "row long")
    return rows.join(drop, "row", "left_anti").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


def decontamination_sql(documents: str = "documents", columns: str = "doc_id") -> str:
    fold = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, {columns}, {fold} AS w FROM {documents}),
i AS (SELECT item_id::VARCHAR AS item_id, {fold} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
x AS (SELECT k, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
      FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
m AS (SELECT DISTINCT x.k, x.s, x.n, v.item_id FROM x JOIN v ON x.n = v.n AND x.win = v.win),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM m) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT k, item_id FROM m) GROUP BY k)
SELECT {columns}, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""
