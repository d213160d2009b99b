"""Hot lists, keys and groups: results stay whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotaforge.llm import mixing, simhash
from tests.llm.test_llm import brute_components


def classes_of(spark, prints, **kinds):
    distinct = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in sorted(set(prints))], "fp long")
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(distinct, **kinds)).collect()}
    out: dict = {}
    for p in set(prints):
        out.setdefault(root.get(p, p), set()).add(p)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("kinds", [{}, {"hot": 40, "long": 30}])
def test_hot_lists_against_brute_force(spark, kinds):
    r = random.Random(8)
    prints = [r.getrandbits(64) for _ in range(100)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for p in prints[:60]]
    hub = r.getrandbits(64)
    prints += [(hub & ~(0xFFFFFFFFFF << 20)) | (r.getrandbits(40) << 20) for _ in range(250)]  # 24 equal bits
    prints += [(hub & ~(0xFFFFFFFF << 32)) | (r.getrandbits(32) << 32) for _ in range(250)]  # 32 equal bits
    prints += [hub ^ sum(1 << b for b in r.sample(range(30, 40), 3)) for _ in range(150)]
    root = brute_components(prints)
    want: dict = {}
    for p, k in zip(prints, root, strict=True):
        want.setdefault(k, set()).add(p)
    assert classes_of(spark, prints, **kinds) == sorted(map(sorted, want.values()))


def test_a_long_list_of_unlinked_members_stays_cheap():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 40, 50_000, np.uint64) | np.uint64(0x123456 << 40)
    a, b = simhash._long_list(np.unique(fp), 4)
    near = [int(x) ^ int(y) for x, y in zip(a, b, strict=True)]
    assert all(bin(x).count("1") > 0 for x in near)


def test_one_fingerprint_holds_most_rows(spark):
    rows = [(k, "the same words in every one of these rows" if k % 2 else f"text {k} has {k * 7} words of {k * 13}") for k in range(3000)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 3000 and {got[k] for k in range(1, 3000, 2)} == {1}


def test_first_of_each_keeps_clashing_columns_maps_and_repeats(spark):
    rows = [(1, "a b c d e f", 7, {"x": 1}, "p"), (1, "a b c d e f", 7, {"x": 1}, "p"), (None, "a b c d e f", 8, None, "q"), (None, "other words stand here now", 9, {"y": 2}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept_row int, key map<string,int>, `row.x` string")
    kept = simhash.first_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] or 0, r["_kept_row"], r["row.x"]) for r in kept.collect()) == [(0, 9, None), (1, 7, "p")]


def test_mixing_repeated_ids_and_rows_come_near_the_target(spark):
    rows = [(None, "w " * (1 + k % 5), "a" if k < 200 else "b") for k in range(400)] + [(7, "the same row", "c")] * 300
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) >= 2 and all(abs(r["taken"] - r["target"]) <= 5 for r in got)
