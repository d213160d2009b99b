"""Secrets and personal data: the same spans as the plain patterns, in linear time, and costs against all segmentations."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quotaforge.llm import pii, secrets


def all_segmentations(value, rank):
    """Least cost by trying every way to cut `value`."""
    each = secrets._alphabet(value)
    by_start: dict = {}
    for a, b, cost, _ in secrets.segments(value, rank):
        by_start.setdefault(a, []).append((b, cost))

    def least(i):
        return 0.0 if i == len(value) else min(c + least(b) for b, c in [(i + 1, each), *by_start.get(i, [])])

    return least(0)


def test_guess_cost_against_all_segmentations():
    r = random.Random(4)
    rank = secrets.RANK | {"abcab": 700, "bca": 900}
    parts = ["password", "abc", "qwe", "1999", "2024-05-17", "aaaa", "x", "Z", "9", "!", "bca", "é", "İ"]
    for _ in range(150):
        value = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))[:14]
        want = all_segmentations(value, rank)
        assert secrets.guess_cost(value, rank) == pytest.approx(want)
        for enough in (1.0, 4.0, 10.0):
            assert (secrets.guess_cost(value, rank, enough) >= enough) == (want >= enough - 1e-12)


def plain_emails(text):
    return [m.span() for m in pii.EMAIL.finditer(text)]


def plain_ips(text):
    return [m.span() for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_linear_scans_find_what_the_patterns_find():
    r = random.Random(6)
    for _ in range(4000):
        text = "".join(r.choice(["a", "b.", ".", "@", "@x.y", "-", " ", "1", "25", "255", "256", ".1", ".2.", "é", "+"]) for _ in range(r.randint(0, 30)))
        assert list(pii.emails(text)) == plain_emails(text), text
        assert [(a, b) for k, a, b in pii.base_spans(text) if k == 1] == plain_ips(text), text


@pytest.mark.parametrize("unit", ["a", "1", ".", "@", "a@", "1.", "a@b.c", "1.2.3.4 ", "+1 ", "token=", "secret ", "password: x9$Lq2!vTz ", "pin:", "AKIA", "0a", "key=aB3$", "login=((", "(at) "])
def test_a_megabyte_of_anything_takes_seconds(unit):
    text = unit * (1_000_000 // len(unit))
    model = pii.fit()
    began = time.time()
    secrets.spans(text)
    middle = time.time()
    pii.find([text], model)
    # patterns with bounded repeats may cost a few hundred steps a character, but never more for a longer text
    assert middle - began < 20 and time.time() - middle < 60


def brute_secrets(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in sorted(out, key=lambda s: (s[0], s[2])))


def test_secrets_query_against_plain_patterns(spark):
    where = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    rows = secrets.op5_secrets(spark, where).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def brute_personal(text):
    luhn = lambda d: sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda t: re.sub(r"[^0-9]", "", t)
    out = [("email", *s) for s in plain_emails(text)] + [("ip", *s) for s in plain_ips(text)]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_personal_data_query_against_plain_patterns(spark):
    where = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii.op6_pii(spark, where).collect():
        want = brute_personal(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_dictionary_ranks_the_words_of_all_texts(spark):
    docs = spark.createDataFrame([(1, "zebra Zebra zebra apple apple kiwi2 xx"), (2, None), (3, "apple zebra pear")], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in secrets.corpus_words(docs).collect()} == {"zebra": 4, "apple": 3, "kiwi": 1, "pear": 1}
    rank = secrets.dictionary(docs, 3)
    assert (rank["zebra"], rank["apple"], rank["kiwi"]) == (1, 2, 3) and "pear" not in rank and rank["password"] == 1
    assert secrets.dictionary(docs.limit(0)) == secrets.RANK
    assert secrets.guess_cost("zebraapple", rank) < 1 < secrets.guess_cost("zebraapple")
    rows = secrets.scan(docs.withColumn("spans", F.lit(1)), rank={}).collect()
    assert len(rows) == 3 and math.isinf(secrets.guess_cost("a", {}, math.inf)) is False
