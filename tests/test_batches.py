"""Token-budget batches against a sequential fold."""

import random

import pytest

from quotaforge.operators import batches


def folded(lengths, most_rows, most_tokens):
    """Batches by one row after the other."""
    out, held = [], []
    for i in sorted(lengths, key=lambda i: (max(1, lengths[i] or 1), str(i))):
        size = max(1, lengths[i] or 1)
        if held and (len(held) == most_rows or size * (len(held) + 1) > most_tokens):
            out.append(held)
            held = []
        held.append(i)
    return [*out, held] if held else out


def test_plan_against_the_fold():
    r = random.Random(1)
    for _ in range(400):
        most_rows, most_tokens = r.randint(1, 9), r.randint(1, 60)
        lengths = {i: r.randint(1, r.choice([3, 20, 90])) for i in range(r.randint(0, 60))}
        bars = {}
        for size in lengths.values():
            bars[min(size, most_tokens + 1)] = bars.get(min(size, most_tokens + 1), 0) + 1
        table = {bar: rest for bar, *rest in batches.plan(sorted(bars.items()), most_rows, most_tokens)}
        found: dict = {}
        for rank, i in enumerate(sorted(lengths, key=lambda i: (lengths[i], str(i)))):
            before, batch, open_, full = table[min(lengths[i], most_tokens + 1)]
            found.setdefault(batch + (open_ + rank - before) // full, []).append(i)
        assert [found[b] for b in sorted(found)] == folded(lengths, most_rows, most_tokens)
        assert sorted(found) == list(range(len(found)))


def test_token_batches_on_spark(spark):
    r = random.Random(2)
    lengths = {i: r.choice([None, 0, 7, 7, 7, r.randint(1, 90), 400]) for i in range(700)}
    rows = spark.createDataFrame(list(lengths.items()), "id long, n int")
    found: dict = {}
    for row in batches.token_batches(rows, "n", "id", 8, 200).collect():
        found.setdefault(row["batch"], {})[row["place"]] = row["id"]
    want = folded(lengths, 8, 200)
    assert [[found[b][p] for p in sorted(found[b])] for b in sorted(found)] == want
    one, two = ({x["turn"]: x["batch"] for x in batches.epoch_order(batches.token_batches(rows, "n", "id", 8, 200), 3, e).collect()} for e in (0, 1))
    assert sorted(one) == sorted(two) == list(range(1, len(want) + 1)) and one != two and set(one.values()) == set(range(len(want)))


def test_token_batches_of_nothing_and_bad_bounds(spark):
    rows = spark.createDataFrame([], "id long, n int")
    assert batches.token_batches(rows, "n", "id", 8, 200).count() == 0
    for bad in ((0, 5), (5, 0)):
        with pytest.raises(ValueError, match="at least one"):
            batches.token_batches(rows, "n", "id", *bad)
