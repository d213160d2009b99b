"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's letters are lower-cased; its byte n-grams (2 to 4, blanks between words
included) are hashed into buckets whose embeddings are averaged and mapped to class
logits. Embeddings and weights are fitted by stochastic gradient descent in numpy on
a bounded sample of labelled rows (`SAMPLE` rows of at most `MOST_BYTES` each, the
ones with the least hashes); every text is then classified whole. Averaging and the
linear map commute, so a worker holds one table of bucket logits.

A held-back part of the sample calibrates the scores: a temperature that minimises
the log loss, and a rejection threshold below all but a small share of the right
answers. Rows without letters are `und` with score 0.

Defined cases: null or letterless texts are `und`; ties go to the class first in
code-point order; without labelled rows everything is `und`; null doc_ids hash like
the empty text; rows that repeat are classified each; very long texts are read in
blocks; further columns are ignored by `classify` and kept by `keep_known`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm.common import least_hashed, table

BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (2, 3, 4)
#: The fit's bound: labelled rows, and bytes of a row that may be among them.
SAMPLE, MOST_BYTES = 3000, 20_000
EPOCHS, RATE = 4, 0.3
#: Share of right calibration answers that may be rejected.
REJECT = 0.002
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
BLOCK = 1 << 20
#: Bytes of words stay (A-Z lowered, all above ASCII), others become blanks.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def grams(text: str):
    """Arrays of bucket numbers of all n-grams of `text`, block by block."""
    flat = b" " + b" ".join(text.encode("utf-8", "replace").translate(FOLD).split()) + b" "
    every = np.frombuffer(flat, np.uint8)
    for at in range(0, len(every), BLOCK):
        x = every[at : at + BLOCK + max(GRAMS) - 1].astype(np.uint32)
        h = x
        for n in range(2, max(GRAMS) + 1):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in GRAMS:
                yield ((h[:BLOCK] * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of `text` and their shares."""
    n = np.zeros(BUCKETS, np.float32)
    for at in grams(text):
        n += np.bincount(at, minlength=BUCKETS)
    ids = np.flatnonzero(n)
    return ids, n[ids] / max(n.sum(), 1)


class Model:
    """Logits of the buckets, classes, temperature and rejection threshold."""

    def __init__(self, logits, bias, classes, temperature, threshold):
        self.logits, self.bias, self.classes, self.temperature, self.threshold = logits, bias, classes, temperature, threshold

    def raw(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.classes)), 0
        for at in grams(text):
            total += self.logits[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        return total / max(n, 1) + self.bias

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.raw(text) / self.temperature)
        k = int(np.argmax(p))
        return self.classes[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """The model of (text, label) rows; every fifth row calibrates it."""
    rows = [(t, y) for t, y in rows if t and y is not None and LETTER.search(t)]
    classes = sorted({y for _, y in rows})
    if not classes:
        return Model(np.zeros((BUCKETS, 0), np.float32), np.zeros(0), [], 1.0, 1.0)
    rng = np.random.default_rng(seed)
    number = {y: k for k, y in enumerate(classes)}
    held = [k % 5 == 4 for k in range(len(rows))] if len(rows) >= 25 else [False] * len(rows)
    made = [(*counts(t), number[y]) for t, y in rows]
    table_ = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)
    train = [x for x, out in zip(made, held, strict=True) if not out]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) * 10
        for k in rng.permutation(len(train)):
            ids, share, y = train[k]
            mean = share @ table_[ids]
            g = softmax(mean @ weights + bias)
            g[y] -= 1
            back = weights @ g
            weights -= np.float32(0.1 * step) * np.outer(mean, g)
            bias -= np.float32(0.01 * step) * g
            table_[ids] -= np.float32(step) * share[:, None] * back[None, :]
    logits = (table_ @ weights).astype(np.float32)
    aside = [x for x, out in zip(made, held, strict=True) if out] or train
    z = np.array([share @ logits[ids] + bias for ids, share, _ in aside], np.float64)
    y = np.array([c for *_, c in aside])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        loss = -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        best = min(best, (loss, float(t)))
    p = softmax(z / best[1])
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    threshold = min(0.5, float(np.quantile(right, REJECT))) if len(right) else 0.5
    return Model(logits, bias.astype(np.float64), classes, best[1], threshold)


def train(docs: DataFrame, sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> Model:
    """Fits on the `sample` rows of least hash among the labelled ones of at most `most_bytes` bytes."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
    usable = usable.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    rows = least_hashed(usable, sample, "doc_id", "text").orderBy("_least_hash", "text", "lang").limit(sample).collect()
    return fit([(r["text"], r["lang"]) for r in rows])


def in_fold(doc_id, folds: int, fold: int):
    """Whether crc32 of the id as text leaves `fold` modulo `folds`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def classify(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns`, lang_pred, score and rejected for each row; the model (2 MB for 16 classes) is broadcast."""
    frame = docs.select(*columns, "text")
    kinds = dict(frame.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in columns),
                    pa.array([x for x, _ in found], pa.string()),
                    pa.array([p for _, p in found], pa.float64()),
                    pa.array([x == UNKNOWN or p < shared.value.threshold for x, p in found], pa.bool_()),
                ],
                [*columns, "lang_pred", "score", "rejected"],
            )

    return frame.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "lang_pred string, score double, rejected boolean"]))


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose language is not rejected, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value(t.as_py()) for t in batch["text"]]
            yield batch.filter(pa.array([x != UNKNOWN and p >= shared.value.threshold for x, p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = in_fold(F.col("doc_id"), 3, 1)
    model = train(docs.filter(~held).select("doc_id", "text", "lang"))
    found = classify(docs.select("doc_id", held.alias("held_out"), "text"), model, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
