"""The maximum-entropy model against plain loops, and its independence of how rows are dealt."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotaforge.llm import language, maxent


def corpus(n=120, rare=200):
    r = random.Random(3)
    words = ["the", "of", "and", "to", *(f"Rare{k}" for k in range(rare))]
    texts = [(k, " ".join(r.choice(words[:4] if r.random() < 0.5 else words) for _ in range(r.randint(0, 60)))) for k in range(n)]
    return [*texts, (n, None), (n + 1, ""), (None, "the of\tand"), (n + 2, "the rare1 " * 15_000)]


def brute(rows, rounds):
    """Scores by loops over tokens; only the hashes of words, groups and features are the module's own."""
    out_of = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    texts = [(k, *maxent.tokens_of([(t or "").encode()])[:2]) for k, t in rows]
    count, group = Counter(), {}
    for k, h, g in texts:
        group |= dict(zip(h.tolist(), g.tolist(), strict=True))
        if not out_of(k):
            count.update(h.tolist())
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    end = int(maxent.END)
    head = [end, *sorted((w for w in count if w != end), key=lambda w: (-count[w], signed(w)))][: maxent.HEAD]
    unit = lambda w: head.index(w) if w in head else maxent.HEAD + group[w]
    tokens, kinds = Counter(), Counter()
    for w, c in count.items():
        if w not in head:
            tokens[group[w]] += c
            kinds[group[w]] += 1
    start = np.array([count[head[u]] if u < len(head) else 0 for u in range(maxent.HEAD)] + [tokens[g] for g in range(maxent.GROUPS)])
    words = maxent.Vocabulary([], [])
    words.start, words.distinct = start, len(count)
    weights = maxent.first_weights(words).astype(np.float64)
    decay = maxent.decays(weights.shape[2], np.arange(weights.size)).reshape(weights.shape)
    events = {}
    for n, (_, h, _) in enumerate(texts):
        u = [0, 0, *map(unit, h.tolist())]
        events[n] = list(zip(u, u[1:], u[2:], strict=False))

    def rows_of(two, one, factor, kind):
        return [int(x[0]) for x in maxent.features(np.array([two * maxent.UNITS + one]), weights.shape[2], None if factor == 0 else np.array([kind]))]

    def softmax(at, factor):
        z = weights[factor][:, at].sum(axis=1)
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    for _ in range(rounds):
        seen, due = np.zeros_like(weights), np.zeros_like(weights)
        for n, (k, _, _) in enumerate(texts):
            for two, one, u in [] if out_of(k) else events[n]:
                kind, slot = divmod(u, maxent.SLOTS)
                for factor, target in ((0, kind), (1, slot)):
                    at = rows_of(two, one, factor, kind)
                    p = softmax(at, factor)
                    for row in at:
                        seen[factor, target, row] += 1
                        due[factor, :, row] += p
        weights = weights + (seen - due - decay * weights) / (seen + due + np.maximum(decay, 0.5))
    score = []
    for n, (_, h, _) in enumerate(texts):
        total = 0.0
        for (two, one, u), w in zip(events[n], h.tolist(), strict=True):
            kind, slot = divmod(u, maxent.SLOTS)
            total += math.log10(softmax(rows_of(two, one, 0, kind), 0)[kind]) + math.log10(softmax(rows_of(two, one, 1, kind), 1)[slot])
            if u >= maxent.HEAD:
                g = u - maxent.HEAD
                total += math.log10((count[w] + 1) / (tokens[g] + kinds[g] + 1))
        score.append(total)
    return score, count


def test_score_against_loops(spark):
    rows = corpus(130, 3000)[:-1]
    want, count = brute(rows, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = language.in_fold(F.col("doc_id"), 7, 2)
    dealt = maxent.written(maxent.chunked(docs, held))
    counts = maxent.counted(dealt.filter("kind = 'words'")).cache()
    words = maxent.vocabulary(counts)
    assert words.total == sum(count.values()) and words.distinct == len(count) > maxent.HEAD
    shared = spark.sparkContext.broadcast(words)
    made = maxent.with_units(dealt.filter("kind = 'body'"), counts, shared).cache()
    weights = maxent.train(made, maxent.first_weights(words), ((0, maxent.BLOCKS),) * 2)
    got = {}
    for r in made.collect():
        d, m = r["docs"], r["tokens"]
        ids, n, _, _, share = maxent.opened(maxent.pa.scalar(bytes(r["about"])), (np.int64, 4 * d), (np.int64, d), (np.int64, d), (np.float64, d), (np.float64, d))
        units = maxent.opened(maxent.pa.scalar(bytes(r["units"])), (np.int64, d), (np.int64, d), (np.uint16, m))[2]
        model = np.add.reduceat(maxent.log10_units(weights, maxent.trigrams(units, n)), np.cumsum(n) - n) + share
        got |= {None if none else int(k): x for (k, none, _, _), x in zip(ids.reshape(-1, 4), model.tolist(), strict=True)}
    assert [got[k] for k, _ in rows] == pytest.approx(want, rel=1e-4)


def test_scores_do_not_depend_on_the_partitions(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    held = language.in_fold(F.col("doc_id"), 7, 2)
    by = lambda n: {r["doc_id"]: tuple(r) for r in maxent.score(docs.repartition(n), held).collect()}
    one = by(1)
    for n in (3, 24):
        many = by(n)
        assert all(many[k][:5] == one[k][:5] and many[k][5:] == pytest.approx(one[k][5:], rel=1e-6) for k in one)


def test_the_model_beats_the_base_on_held_out_texts_of_any_length(spark):
    r = random.Random(1)
    lists = [[f"{a}{k}" for k in range(40)] for a in ("ba", "cu", "do")]
    line = lambda n: " ".join(r.choice(r_list) for r_list in [r.choice(lists)] for _ in range(n))
    docs = spark.createDataFrame([(k, line(r.choice([5, 50, 4000]))) for k in range(150)], "doc_id long, text string")
    rows = [x for x in maxent.score(docs, language.in_fold(F.col("doc_id"), 7, 2)).collect() if x["held_out"]]
    assert sum(x["score"] for x in rows) > 0.85 * sum(x["base_score"] for x in rows)


def test_maxent_all_held_out_and_one_long_text(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    rows = maxent.score(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in rows)
    long = spark.createDataFrame([(1, "w x " * 40_000)], "doc_id long, text string")
    row = maxent.score(long, F.lit(False)).first()
    assert row["n_tokens"] == 80_001 and row["n_known"] == 80_001 and row["score"] > row["base_score"]
