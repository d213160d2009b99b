"""Importance resampling of documents towards a target corpus, over hashed runs of one and two words.

Each corpus becomes postings: a chunk of documents is cut into words, the CRC-32 of every
word and word pair is taken in numpy (a pair's from those of its words), and the counts of
each (bucket, document) are packed by ranges of buckets. The postings are shuffled by
(range of buckets, part of the chunks), where they meet the bucket totals of both corpora;
there the gains are computed, and each range sends one sum a document, so a document is
reduced from at most `RANGES` numbers. A hot bucket is cut by the parts, whose number
follows the width of the shuffle. Documents are then drawn without replacement by
Gumbel-perturbed weights: a histogram of the integer scores gives the least score that can
be drawn, and only the documents from there on are sorted, by ranges.

The documents are read twice (totals, postings), so they must come in one order each time,
as scans of files do; a chunk whose sums do not add up to its features is an error.

Defined cases: a null or wordless text has no words, no features and weight 0; a null id
counts as the empty string in the draw and comes last among ties; rows that repeat are
rows of their own; an empty corpus has 0 features, and its totals are 0; texts of any
length are cut at blanks into pieces, the pair across the cut included. Columns other than
id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaforge.llm.common import shuffle_width, table, written
from quotaforge.operators.order import global_rank

#: Hash buckets of features.
BUCKETS = 10_000
#: Ranges of buckets that travel together, documents of a chunk (at most 2^16), words counted at once, bytes of a piece of text.
RANGES, CHUNK, WORDS, PIECE = 64, 4096, 1_000_000, 4_000_000
#: Lower case A-Z; bytes that are neither letters, digits nor part of a longer UTF-8 sequence become blanks.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _one_byte() -> np.ndarray:
    """What a zero byte after it makes of a CRC, as 4 tables of 256 values: CRCs are linear over their bits."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> np.uint32(1)) ^ np.uint32(0xEDB88320), byte >> np.uint32(1)).astype(np.uint32)
    value = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    return byte[value & 255] ^ (value >> np.uint32(8))


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[..., 0, :][crc & 255] ^ tables[..., 1, :][(crc >> 8) & 255] ^ tables[..., 2, :][(crc >> 16) & 255] ^ tables[..., 3, :][crc >> 24]


class Shift:
    """Tables that move a CRC over n zero bytes, made by doubling and kept by n."""

    def __init__(self):
        self.powers, self.known = [_one_byte()], {}

    def __call__(self, n: int) -> np.ndarray:
        if n not in self.known:
            while len(self.powers) <= n.bit_length():
                self.powers.append(_applied(self.powers[-1], self.powers[-1]))
            out = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
            for bit in range(n.bit_length()):
                if n >> bit & 1:
                    out = _applied(self.powers[bit], out)
            if len(self.known) < 4096:
                self.known[n] = out
            return out
        return self.known[n]


def word_pieces(text: bytes | None, size: int = PIECE):
    """Lists of the words of a text, a piece of about `size` bytes at a time, cut at blanks."""
    flat = (text or b"").translate(FOLD)
    at = 0
    while at < len(flat):
        end = len(flat) if len(flat) - at <= size else flat.find(b" ", at + size)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


class Features:
    """Buckets of the features of documents, in batches of words; a pair that spans two batches of one document counts."""

    def __init__(self, buckets: int):
        self.buckets, self.shift = buckets, Shift()
        self.words: list[bytes] = []
        self.docs: list[tuple[int, int]] = []
        self.lead: tuple[int, bytes] | None = None

    def add(self, doc: int, words: list[bytes]) -> None:
        self.words += words
        self.docs.append((doc, len(words)))

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, bucket) of each feature of what was added."""
        if not self.words:
            self.docs = []
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = [self.lead[1], *self.words] if self.lead else self.words
        doc = np.repeat([d for d, _ in self.docs], [n for _, n in self.docs]).astype(np.int64)
        skip = int(self.lead is not None)
        if skip:
            doc = np.concatenate(([self.lead[0]], doc))
        number: dict[bytes, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        crc = np.fromiter(map(zlib.crc32, number), np.uint32, len(number))
        blank = np.fromiter((zlib.crc32(b" ", int(c)) for c in crc), np.uint32, len(number))
        lengths, which = np.unique(np.fromiter(map(len, number), np.int64, len(number)), return_inverse=True)
        tables = np.stack([self.shift(int(n)) for n in lengths])
        first = np.flatnonzero(doc[1:] == doc[:-1])
        a, b = code[first], code[first + 1]
        head, size = blank[a], which[b]
        pair = tables[size, 0, head & 255] ^ tables[size, 1, (head >> 8) & 255] ^ tables[size, 2, (head >> 16) & 255] ^ tables[size, 3, head >> 24] ^ crc[b]
        out = np.concatenate((doc[skip:], doc[first])), np.concatenate((crc[code[skip:]], pair)).astype(np.int64) % self.buckets
        self.lead = int(doc[-1]), words[-1]
        self.words, self.docs = [], []
        return out


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def totals(corpus: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): the features of the corpus in each bucket; each task sends one row a bucket."""

    def counted(batches):
        made, n = Features(buckets), np.zeros(buckets, np.int64)
        doc = 0
        for batch in batches:
            for value in _bytes(batch.column(0)):
                doc += 1
                for words in word_pieces(value):
                    made.add(doc, words)
                    if len(made.words) > WORDS:
                        n += np.bincount(made.taken()[1], minlength=buckets)
        n += np.bincount(made.taken()[1], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    rows = corpus.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, gain) from the totals of both corpora: floor(1000 ln of the target's smoothed share over the corpus's)."""
    both = corpus.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1))).unionByName(corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("side")))
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).cast("double")
    per = both.groupBy("bucket").agg(side(0).alias("s"), side(1).alias("t"))
    whole = both.agg(side(0).alias("all_s"), side(1).alias("all_t"))  # one row
    value = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return per.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(value)).cast("long").alias("gain"))


def _schema(id_type: T.DataType) -> T.StructType:
    fields = [("range", T.IntegerType()), ("part", T.IntegerType()), ("kind", T.IntegerType()), ("chunk", T.LongType())]
    fields += [(n, T.BinaryType()) for n in ("sizes", "docs", "counts", "heavy")]
    fields += [("ids", T.ArrayType(id_type)), ("words", T.ArrayType(T.LongType())), ("features", T.ArrayType(T.LongType()))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _packed(at: np.ndarray, many: np.ndarray, buckets: int, chunk: int, part: int):
    """A row per range of buckets: postings a bucket, steps between their documents as two planes, counts in a byte and the heavy ones apart."""
    width = -(-buckets // RANGES)
    cuts = np.searchsorted(at, np.arange(RANGES + 1, dtype=np.int64) * width << 16)
    for k in range(RANGES):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        sizes = np.bincount((at[a:b] >> 16) - k * width, minlength=width).astype(np.int32)
        step = np.diff((at[a:b] & 0xFFFF).astype(np.uint16), prepend=np.uint16(0))
        over = np.flatnonzero(many[a:b] > 255)
        yield {
            "range": k, "part": part, "kind": 1, "chunk": chunk, "sizes": sizes.tobytes(),
            "docs": (step & 255).astype(np.uint8).tobytes() + (step >> 8).astype(np.uint8).tobytes(),
            "counts": np.minimum(many[a:b], 255).astype(np.uint8).tobytes(), "heavy": np.stack((over, many[a:b][over])).astype(np.int64).tobytes(),
        }


def postings(docs: DataFrame, id_: str, text: str, parts: int, buckets: int = BUCKETS) -> DataFrame:
    """Packed postings of chunks of documents (kind 1), and a row per chunk with its ids and lengths (kind 2)."""
    slim = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    schema = _schema(slim.schema["id"].dataType)

    def packed(batches):
        task, arrow = TaskContext.get().partitionId(), None
        number = 0

        def finished(ids, words, made, keys, counts):
            nonlocal number
            chunk = task << 32 | number
            part = zlib.crc32(b"%d" % chunk) % parts
            number += 1
            at, many = _summed(keys, counts)
            length = np.array(words, np.int64)
            yield from _packed(at, many, buckets, chunk, part)
            yield {"range": RANGES, "part": part, "kind": 2, "chunk": chunk, "ids": ids, "words": length, "features": length + np.maximum(length - 1, 0)}

        def rows():
            ids, words, made, keys, counts = [], [], Features(buckets), [], []

            def flush():
                doc, bucket = made.taken()
                at, many = np.unique(bucket << 16 | doc, return_counts=True)
                keys.append(at)
                counts.append(many)

            for batch in batches:
                for one, value in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                    if len(ids) == CHUNK:
                        flush()
                        yield from finished(ids, words, made, keys, counts)
                        ids, words, made, keys, counts = [], [], Features(buckets), [], []
                    n = 0
                    for found in word_pieces(value):
                        made.add(len(ids), found)
                        n += len(found)
                        if len(made.words) > WORDS:
                            flush()
                    ids.append(one)
                    words.append(n)
            if ids:
                flush()
                yield from finished(ids, words, made, keys, counts)

        for row in rows():
            arrow = arrow or to_arrow(schema)
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in arrow], schema=arrow)

    return slim.mapInArrow(packed, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    at, which = np.unique(np.concatenate(keys), return_inverse=True)
    return at, np.bincount(which, weights=np.concatenate(counts), minlength=len(at)).astype(np.int64)


def contributions(batches):
    """Of each range of buckets: first its gains (kind 0), then its postings, which become one sum a document of their chunk."""
    gain, place = None, None
    for batch in batches:
        out = {"chunk": [], "kind": [], "sums": [], "n": [], "ids": [], "words": [], "features": []}
        for k in range(batch.num_rows):
            value = lambda name: batch.column(batch.schema.get_field_index(name))[k].as_py()  # noqa: B023, E731
            kind, here = value("kind"), (value("range"), value("part"))
            if kind == 0:
                gain, place = np.frombuffer(value("sizes"), np.int64), here
                continue
            row = dict.fromkeys(out)
            row |= {"chunk": value("chunk"), "kind": kind}
            if kind == 2:
                row |= {n: batch.column(batch.schema.get_field_index(n))[k] for n in ("ids", "words", "features")}
            else:
                if place != here:
                    raise ValueError(f"postings of range {here} came without gains")
                sizes, plane = np.frombuffer(value("sizes"), np.int32), np.frombuffer(value("docs"), np.uint8).reshape(2, -1)
                doc = np.cumsum(plane[0].astype(np.uint16) + (plane[1].astype(np.uint16) << np.uint16(8)), dtype=np.uint16)
                many = np.frombuffer(value("counts"), np.uint8).astype(np.int64)
                over = np.frombuffer(value("heavy"), np.int64).reshape(2, -1)
                many[over[0]] = over[1]
                sums = np.bincount(doc, weights=np.repeat(gain, sizes) * many.astype(np.float64))  # whole numbers below 2^53
                row |= {"sums": sums.astype(np.int64).tobytes(), "n": int(many.sum())}
            for name, one in row.items():
                out[name].append(one)
        if out["chunk"]:
            typed = {n: batch.schema.field(n).type for n in ("ids", "words", "features")} | {"chunk": pa.int64(), "kind": pa.int32(), "sums": pa.binary(), "n": pa.int64()}
            arrays = [pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in v], typed[n]) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays(arrays, list(out))


def reduced(batches):
    """The sums of each chunk, then its documents (kind 2): id, n_words, n_features, weight."""
    chunk, total, n = None, None, 0
    for batch in batches:
        for k in range(batch.num_rows):
            value = lambda name: batch.column(batch.schema.get_field_index(name))[k]  # noqa: B023, E731
            if (here := value("chunk").as_py()) != chunk:
                chunk, total, n = here, np.zeros(CHUNK, np.int64), 0
            if value("kind").as_py() == 1:
                sums = np.frombuffer(value("sums").as_py(), np.int64)
                total[: len(sums)] += sums
                n += value("n").as_py()
                continue
            features = np.array(value("features").as_py(), np.int64)
            if n != features.sum():
                raise ValueError("the documents came in another order in a second reading; write them first")
            weight = np.floor_divide(total[: len(features)], np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([value("ids").values, value("words").values, pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, target: DataFrame, id_: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Rows (id, n_words, n_features, weight), one per document: the floored mean gain of its features."""
    if not 1 <= buckets <= 1 << 31:
        raise ValueError("between 1 and 2^31 buckets")
    spark = docs.sparkSession
    width, parts = -(-buckets // RANGES), -(-shuffle_width(spark) // RANGES)
    posted = postings(docs, id_, text, parts, buckets)
    gain = gains(totals(docs, text, buckets), totals(target, target_text, buckets), buckets)

    def dense(batches):
        for batch in batches:
            made = []
            for places, values in zip(batch["places"].to_pylist(), batch["values"].to_pylist(), strict=True):
                row = np.zeros(width, np.int64)
                row[np.array(places, np.int64)] = values
                made.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch["range"], pa.array(made, pa.binary())], ["range", "sizes"])

    order = F.sort_array(F.collect_list(F.struct((F.col("bucket") % width).alias("place"), "gain")))  # `width` entries at most
    ranges = gain.groupBy((F.col("bucket") / width).cast("int").alias("range")).agg(order.alias("g")).select("range", F.col("g.place").alias("places"), F.col("g.gain").alias("values")).mapInArrow(dense, "range int, sizes binary")
    ranges = ranges.select("range", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "sizes")
    met = posted.unionByName(ranges, allowMissingColumns=True)
    met = met.repartitionById((RANGES + 1) * parts, (F.col("range") * parts + F.col("part")).cast("int")).sortWithinPartitions("range", "part", "kind")
    schema = posted.schema
    given = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("sums", T.BinaryType()), T.StructField("n", T.LongType()), schema["ids"], schema["words"], schema["features"]])
    sums = met.mapInArrow(contributions, given).repartition(shuffle_width(spark), "chunk").sortWithinPartitions("chunk", "kind")
    out = T.StructType([T.StructField("id", schema["ids"].dataType.elementType), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])
    return sums.mapInArrow(reduced, out)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_: str = "doc_id", text: str = "text",
    target_text: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """Every document's (id, n_words, n_features, weight, score, rank): `percent` of those with `least_words` words or more are drawn.

    score adds Gumbel noise of a seeded hash of the id to the weight, so the highest scores
    are a draw without replacement in proportion to exp(weight / 1000); rank is their order,
    null for the others. Ties go to the smaller id, then to the row's place.
    """
    noise = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    scored = weights(docs, target, id_, text, target_text, buckets).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(noise))).cast("long"))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    histogram = scored.filter(F.col("n_words") >= least_words).groupBy("score").count().collect()  # scores are whole thousandths of a logarithm: some 10^5 values at most
    wanted = percent * sum(r["count"] for r in histogram) // 100
    least, above = None, 0
    for r in sorted(histogram, key=lambda r: -r["score"]):
        if above < wanted:
            least, above = r["score"], above + r["count"]
    none = F.lit(None).cast("long").alias("rank")
    names = ["id", "n_words", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*names, none)
    can = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    ranked = global_rank(scored.filter(can), [F.desc("score"), F.col("id").asc_nulls_last(), F.col("row").asc()])
    ranked = ranked.select(*names, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    return scored.filter(~can).select(*names, none).unionByName(ranked)


def drawn(docs: DataFrame, target: DataFrame, id_: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose ids are drawn, all columns as they were; rows that share a drawn id all stay."""
    ids = resample(docs, target, id_=id_, **options).filter("rank is not null").select(F.col("id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(id_).eqNullSafe(F.col("_drawn")), "left_semi")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def importance_sql() -> str:
    fold = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT 0 AS side, row_number() OVER () AS k, doc_id, {fold} AS w FROM documents),
b AS (SELECT 1 AS side, row_number() OVER () AS k, NULL AS doc_id, {fold} AS w FROM benchmark),
a AS MATERIALIZED (SELECT side, k, doc_id, len(w) AS n_words, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM (SELECT * FROM d UNION ALL SELECT * FROM b)),
u AS MATERIALIZED (SELECT side, k, f, count(*) AS n FROM (SELECT side, k, unnest(f) AS f FROM a) GROUP BY side, k, f),
h AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::INT, 2))::BIGINT)),
                            lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM u), crc),
p AS (SELECT side, k, bucket, sum(n)::BIGINT AS n FROM u JOIN h USING (f) GROUP BY side, k, bucket),
z AS (SELECT coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS all_s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS all_t FROM p),
g AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (side = 1), 0) + 1)::DOUBLE * (any_value(all_s) + 10000)
                                     / ((coalesce(sum(n) FILTER (side = 0), 0) + 1)::DOUBLE * (any_value(all_t) + 10000))))::BIGINT AS gain FROM p, z GROUP BY bucket),
m AS (SELECT k, sum(n * gain)::BIGINT AS total FROM p JOIN g USING (bucket) WHERE side = 0 GROUP BY k),
v AS (SELECT k, doc_id, n_words, len(f)::BIGINT AS n_features, CASE WHEN len(f) = 0 THEN 0 ELSE floor(total::DOUBLE / len(f))::BIGINT END AS weight,
             ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
      FROM a LEFT JOIN m USING (k) WHERE side = 0),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM v),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, k) AS place, count(*) OVER () AS eligible FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * eligible // 100 THEN place END::BIGINT AS rank FROM s LEFT JOIN r USING (k)
"""
