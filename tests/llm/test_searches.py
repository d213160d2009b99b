"""Importance resampling, BPE and hard negatives against loops and the tokenizers library, with the defined cases."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quotaforge.llm import bpe, importance, negatives

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
VECTORS = "vec_id long, label int, embedding array<float>, block int"


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def resampled(docs, target, share=25, least=20, buckets=10_000):
    """The rows that the contract names, by loops."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for corpus, sums in ((docs, s), (target, t)):
        for _, text in corpus:
            for f in features(text)[1]:
                sums[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out, long_ = {}, []
    for i, text in docs:
        n, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= least:
            long_.append(i)
    for rank, i in enumerate(sorted(long_, key=lambda i: (-out[i][2], i))[: share * len(long_) // 100], 1):
        out[i][3] = rank
    return out


def tables(spark, folder, docs, target):
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(target, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_importance_against_loops(spark, tmp_path):
    r = random.Random(11)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "été", "x1", "42", "naïve", "日本", "the", "of"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "  ", ", ", "\n", "-"]) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 5, 19, 20, 21, 60]))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "...  --"), (203, docs[5][1]), (204, text(30_000))]
    target = [(str(i), text(9)) for i in range(12)] + [("n", None)]
    tables(spark, tmp_path, docs, target)
    found = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in importance.op11_importance(spark, str(tmp_path)).collect()}
    assert found == resampled(docs, target)


def test_importance_of_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    assert importance.op11_importance(spark, str(tmp_path)).count() == 0
    tables(spark, tmp_path / "b", docs := [(1, "a b c"), (2, None)], [])
    found = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in importance.op11_importance(spark, str(tmp_path / "b")).collect()}
    assert found == resampled(docs, [])


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(str(path))
    own.no_truncation()
    own.no_padding()
    return path, own


def test_bpe_against_the_library(spark, vocabulary):
    path, own = vocabulary
    r = random.Random(12)
    pieces = ["the ", "don't", "  ", "\n\n", "\t", "1234567", "é", "日本語", "🙂", "é", " ", "aaaaaaaaaaaa", "ababababab", "_", "'S", "x" * 50, "​", "A", " and", "\r\n", "\u0085", "…"]
    texts = [None, "", " ", "a", "\n", "a" * 5000, "ab" * 3000, "<|endoftext|>", "x<|endoftext|>y <|endoftext|>"]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x370, 0x20FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(100)]
    texts += texts[20:25]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("ids", F.lit("clash"))
    coded = bpe.encode(rows, path)
    found = {r["k"]: (r["ids"], r["decoded"]) for r in bpe.decode(coded.withColumn("kept", F.col("ids")), path).select("k", F.col("kept").alias("ids"), "decoded").collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        want = own.encode(text or "", add_special_tokens=False).ids
        assert found[k] == (want, own.decode(want, skip_special_tokens=False)), repr(text)


def test_bpe_of_long_and_no_texts(spark, vocabulary):
    path, own = vocabulary
    r = random.Random(13)
    long_ = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(150_000))
    ids = bpe.encode(spark.createDataFrame([(long_,)], "text string"), path).first()["ids"]
    assert ids == own.encode(long_, add_special_tokens=False).ids
    empty = bpe.encode(spark.createDataFrame([], "text string"), path)
    assert empty.count() == 0 and bpe.decode(empty, path).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([10**7, None, ids[0]],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, path).collect()] == [None, "", own.decode(ids[:1])]


def mined(rows, anchors, positives=5, k=10):
    """The rows that the contract names, by loops over whole numbers."""
    part = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, label, v, _ in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in part:
        if a % anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in part if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [(n, i) for n, i, alike in scored if not alike and 30 * -s <= 100 * -n <= 90 * -s][:k]
            out += [(a, p, place, i, -s, -n) for place, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def vectors(r, n, dims=6, alike=1.0):
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = []
    for i in range(n):
        label = r.randrange(4)
        size = r.choice([0.1, 1.0, 1.0, 3.0])
        out.append((i, label, [float(F32(size * (c + alike * r.gauss(0, 1)))) for c in centre[label]], 1))
    return out


def F32(x):
    import numpy as np

    return np.float32(x)


@pytest.mark.parametrize("bucket,shard", [(512, 8192), (7, 40)])
def test_negatives_against_loops(spark, monkeypatch, bucket, shard):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives, "SCORED", 3)
    monkeypatch.setattr(negatives, "BLOCK", 8)
    r = random.Random(bucket)
    rows = vectors(r, 260)
    rows += [(300 + k, k % 4, rows[20][2], 1) for k in range(40)]  # ties
    rows += [(400, None, rows[0][2], 1), (401, 1, None, 1), (410, 1, [1.0, None, 0, 0, 0, 0], 1), (420, 1, [float("nan")] * 6, 1), (430, 1, [float("inf"), 0, 0, 0, 0, 0], 1), (440, 2, [0.0] * 6, 1), (450, 3, [-x for x in rows[0][2]], 1)]
    rows = [(i, label, v and [None if x is None else float(x) for x in v], b) for i, label, v, b in rows]
    found = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == mined(rows, 10)


def test_negatives_of_one_label_and_none(spark):
    rows = [(i, 1, v, b) for i, _, v, b in vectors(random.Random(3), 30)]
    assert negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).count() == 0


def test_buckets_are_pruned_and_none_that_counts():
    """A search ends at the first bucket whose bound lies below every window and every k-th score."""
    import numpy as np

    rows = negatives.Rows(np.array([0]), np.array([1]), np.array([[3, 4]], np.int32), 4)
    far = np.full((1, 1), -negatives.FAR), np.full((1, 1), negatives.FAR)
    search = negatives.Search(rows, *far, 2, True)
    bucket = lambda ids, grid: negatives.Rows(np.array(ids), np.ones(len(ids), np.int64), np.array(grid, np.int32), 99)
    assert search.take(bucket([1, 2, 3], [[30, 40], [20, 20], [0, 1]]), 50.0)
    assert search.best[2:].tolist() == [[250, 140], [1, 2]]
    assert search.take(bucket([4], [[17, 23]]), 28.6)  # 5 * 28.6 = 143
    assert search.best[3].tolist() == [1, 4]
    assert not search.take(bucket([5], [[1, 1]]), 20.0)


def test_bpe_decodes_without_an_object_a_value():
    import time

    import pyarrow as pa

    from quotaforge.llm.bpe import decoded_text

    known = {k: bytes([97 + k]) for k in range(20)} | {20: "é".encode()[:1], 21: "é".encode()[1:]}
    assert decoded_text(pa.array([0, None, 99, 20, 21, 20, 3], pa.int32()), known) == "aé\ufffdd" and decoded_text(pa.array([], pa.int32()), known) == ""
    ids = pa.array(list(range(20)) * 20_000, pa.int32())

    def took(f):
        began = time.process_time()
        assert len(f()) == len(ids)
        return time.process_time() - began

    plain = min(took(lambda: b"".join([known.get(i, b"") for i in ids.to_pylist()])) for _ in range(3))
    assert min(took(lambda: decoded_text(ids, known)) for _ in range(3)) < 0.7 * plain
