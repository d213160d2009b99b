"""Byte-level BPE: texts to token ids and back, by an index of pair occurrences.

A task takes its texts in chunks of about `CHARS` characters. The distinct words of a chunk
(cut by the vocabulary's pattern) lie end to end as a linked list of symbols; every pair of
neighbours with a merge is listed under the rank of that merge. The active ranks are applied
in ascending order: all occurrences of a rank are merged at once, those that run into one
another from the left, and the pairs that come into being at both sides are listed under
their ranks. A merge of a good vocabulary uses only tokens of earlier merges (checked on
loading), so no new pair ranks before the one that made it and the order is that of merging
each word by itself. Only the chunk's words and ids are held.

The vocabulary is a file in the format of the tokenizers library, read by the driver and
broadcast, so its size is that of the file.

Defined cases: a null text encodes as no ids, as an empty one does; null ids decode to a
null text; null or unknown ids inside a list are left out; strings of added tokens in a text
become those tokens; bytes that are no UTF-8 become U+FFFD; rows that repeat stay rows; a
column named like the result is replaced, and all others are kept as they are.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaforge.llm.common import table

#: Characters of texts that are encoded together, and of a text from which on its words are taken one by one.
CHARS, LONG = 12_000_000, 4_000_000
#: The fixed pattern of byte-level vocabularies: it cuts texts into words before any merge.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: printable Latin-1 for itself, the others from U+0100 on in their order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    moved = {b: 256 + k for k, b in enumerate(rest)}
    return [chr(moved.get(b, b)) for b in range(256)]


class Vocabulary:
    """Merges by rank, bytes by id, and the added tokens of a vocabulary file."""

    def __init__(self, content: str):
        file = json.loads(content)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or file.get("normalizer"):
            raise ValueError("a byte-level BPE without prefix space and normaliser is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take blanks or word bounds are not read")
        ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.first = np.array([ids[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True))
        rank = np.arange(len(pairs))
        latest = np.full(max(ids.values()) + 1, -1, np.int64)
        np.maximum.at(latest, self.made, rank)
        if (np.maximum(latest[self.left], latest[self.right]) >= rank).any():
            raise ValueError("a merge uses a token of a later merge")
        key = self.left << 32 | self.right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        byte = {c: k for k, c in enumerate(letters)}
        self.bytes: dict[int, bytes] = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 for those without a merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def words(self, text: str, number: defaultdict[str | int, int]) -> np.ndarray:
        """The numbers of a text's words, new words being numbered by `number` itself; an added token counts as a word that is its id."""
        codes: list[np.ndarray] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                codes.append(np.array([number[self.added[part]]]))
            elif part:
                found = PATTERN.findall(part) if len(part) < LONG else (m.group() for m in PATTERN.finditer(part))
                codes.append(np.fromiter(map(number.__getitem__, found), np.int64))
        return np.concatenate(codes) if codes else np.zeros(0, np.int64)


def from_the_left(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of occurrences of a pair of equal symbols, in their order: every second one of those that run into one another."""
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != after[:-1])))
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return place % 2 == 0


class PairIndex:
    """Words as linked symbols, with the positions of every pair that has a merge, by rank."""

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        self.v, self.lengths = vocabulary, np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        self.symbol = vocabulary.first[flat]
        ends = np.cumsum(self.lengths)
        self.next, self.prior = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        self.next[ends - 1] = -1
        self.prior[ends - self.lengths] = -1
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.listed(np.flatnonzero(self.next >= 0))

    def listed(self, at: np.ndarray) -> None:
        """The pairs that begin at these positions are listed under their ranks."""
        rank = self.v.ranks(self.symbol[at], self.symbol[self.next[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(at)]
        for k, r in enumerate(rank[bounds[:-1]].tolist()):
            if r not in self.lists:
                self.lists[r] = []
                heapq.heappush(self.active, r)
            self.lists[r].append(at[bounds[k] : bounds[k + 1]])

    def merge(self, rank: int) -> None:
        """All occurrences of the pair of that rank become one symbol."""
        left, right = self.v.left[rank], self.v.right[rank]
        at = np.unique(np.concatenate(self.lists.pop(rank)))
        after = self.next[at]
        good = (self.symbol[at] == left) & (after >= 0) & (self.symbol[after] == right)
        at, after = at[good], after[good]
        if left == right and len(at) > 1:
            keep = from_the_left(at, after)
            at, after = at[keep], after[keep]
        if not len(at):
            return
        self.symbol[at], self.symbol[after] = self.v.made[rank], -1
        beyond = self.next[after]
        self.next[at] = beyond
        some = beyond >= 0
        self.prior[beyond[some]] = at[some]
        before = self.prior[at]
        self.listed(np.concatenate((before[before >= 0], at[some])))

    def encoded(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of each word's ids."""
        while self.active:
            self.merge(heapq.heappop(self.active))
        alive = self.symbol >= 0
        ends = np.cumsum(self.lengths)
        upto = np.concatenate(([0], np.cumsum(alive)))
        return self.symbol[alive], upto[ends] - upto[ends - self.lengths]


def encoded_texts(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's ids begin (with the end of the last)."""
    number: defaultdict[str | int, int] = defaultdict(itertools.count().__next__)
    codes = [vocabulary.words(t, number) for t in texts]
    words = [w for w in number if isinstance(w, str)]
    ids, length = PairIndex([w.encode() for w in words], vocabulary).encoded() if words else (np.zeros(0, np.int64),) * 2
    fixed = [w for w in number if not isinstance(w, str)]
    place = np.fromiter((number[w] for w in [*words, *fixed]), np.int64, len(number))
    length = np.concatenate((length, np.ones(len(fixed), np.int64)))
    ids = np.concatenate((ids, np.array(fixed, np.int64))).astype(np.int32)
    start, many = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    start[place], many[place] = np.cumsum(length) - length, length
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    n = many[code]
    ends = np.cumsum(n)
    at = np.repeat(start[code] - (ends - n), n) + np.arange(n.sum())
    upto = np.concatenate(([0], ends))
    return ids[at], upto[np.concatenate(([0], np.cumsum([len(c) for c in codes], dtype=np.int64)))]


@lru_cache(maxsize=2)
def _read(content: str) -> Vocabulary:
    return Vocabulary(content)


def given(spark: SparkSession, path: str):
    """The vocabulary file, broadcast; the driver checks that it can be used."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    _read(content)
    return spark.sparkContext.broadcast(content)


def _chunks(batches, name: str):
    """Record batches with their texts, `CHARS` characters at a time at least."""
    held, size = [], 0
    for batch in batches:
        texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]
        low = 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size >= CHARS or k == len(texts):
                held.append((batch.slice(low, k - low), texts[low:k]))
                low = k
                if size >= CHARS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of `docs` with the column `ids`: the token ids of the text by the vocabulary file at `path`."""
    content = given(docs.sparkSession, path)
    rows = docs.drop(ids).withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        vocabulary = _read(content.value)
        for held in _chunks(batches, text):
            values, cuts = encoded_texts([t for _, texts in held for t in texts], vocabulary)
            low = 0
            for batch, texts in held:
                own = cuts[low : low + len(texts) + 1]
                low += len(texts)
                column = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(values[own[0] : own[-1]], pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return rows.mapInArrow(run, schema)


def decoded_text(ids: pa.Array, known: dict[int, bytes]) -> str:
    """The text of `ids`; they pass through numpy, since Arrow makes an object of each value on its way to a list."""
    return b"".join([known.get(i, b"") for i in ids.drop_null().to_numpy().tolist()]).decode("utf-8", "replace")


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the column `text` in place of `ids`: the bytes of the tokens end to end, added tokens included."""
    content = given(rows.sparkSession, path)
    kept = [f for f in rows.schema.fields if f.name not in (ids, text)]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])
    given_rows = rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col(ids).cast("array<int>").alias(ids))

    def run(batches):
        known = _read(content.value).bytes
        for batch in batches:
            texts = []
            column = batch.column(batch.num_columns - 1)
            for k in range(batch.num_rows):
                own = column[k].values
                if own is None:
                    texts.append(None)
                    continue
                texts.append(decoded_text(own, known))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], text])

    return given_rows.mapInArrow(run, schema)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    found = decode(coded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)}), path)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
