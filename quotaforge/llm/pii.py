"""Personal data: high-recall candidates, boosted trees and calibrated thresholds.

Generators propose overlapping spans of four kinds (addresses, also spelled out ones;
dotted numbers; long digit groups; telephone-like groups). Each gets format features
(lengths, digit groups, separators, check digits, domain shape) and context features
(announcing words before it, neighbouring characters). Gradient-boosted regression
trees over binned features, fitted in numpy on a seeded set of made-up sentences,
score them; a held-back part of that set maps scores to probabilities and picks a
threshold per kind for a set precision. Of overlapping candidates the most probable
one is redacted. Spans of the fixed base formats always stay.

Offsets are code points, end exclusive. Defined cases: null texts have no spans; ties
go to the earlier, then longer span, then the kind first listed; very long texts are
scanned whole; rows that repeat are scanned each; further columns are ignored by
`scan` and kept by `redact`.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the query's contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches in linear time: what follows the @ of an address, and what stands before it; numbers from their first digit only.
DOMAIN, LOCAL = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
WHOLE_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates: each format and looser ones.
MORE = (
    (0, "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}[A-Za-z0-9]")),
    (0, " ", re.compile(r"(?<![\w.])[a-z0-9][a-z0-9._-]{0,63}\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]{1,63}(?:\s?(?:[\[(]\s?dot\s?[\])]|\.)\s?[a-z0-9-]{1,63})+", re.I | re.A)),
    (1, ".", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")),
    (2, "", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}(?![0-9])")),
    (2, "", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    (3, "", re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{1,5}\)?){1,5}(?![0-9A-Za-z])")),
)
DIGIT = re.compile(r"[0-9]")
AT = re.compile(r"[\[(]\s?at\s?[\])]", re.IGNORECASE)
CUES = (
    ("mail", "email", "contact", "write", "reach", "correo", "courriel"),
    ("ip", "host", "server", "address", "addr", "gateway", "ping"),
    ("card", "visa", "credit", "debit", "payment", "carte", "karte", "tarjeta"),
    ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "telefono", "whatsapp"),
)
AGAINST = ("order", "version", "invoice", "isbn", "serial", "section", "item", "ref", "total", "date", "page", "score", "id")
PRECISION = 0.98
ROUNDS, DEPTH, BINS, RATE = 60, 3, 32, 0.2


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """(start, end) of the matches of `EMAIL`, leftmost and non-overlapping, in linear time.

    A match holds all of the run of characters before its @ (less what an earlier match took), so each @ is tried once.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        low, start = at, at
        while start == low and low > done:
            low = max(done, low - 64)
            start = low + len(text[low:start].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, by kind and start."""
    out = [(0, start, end) for start, end in emails(text)]
    if DIGIT.search(text):
        small = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or 0) <= 255
        out += [(1, m.start(), m.end()) for m in WHOLE_IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return out


class Cover:
    """Disjoint spans in order; spans that overlap are merged."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return bool(k) and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        """Adds a span that meets none."""
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all proposals; they may overlap."""
    out = []
    digits = DIGIT.search(text) is not None
    for kind, need, pattern in MORE:
        if (kind == 0 and (need in text if need == "@" else AT.search(text))) or (kind and digits):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return [c for c in out if c[0] != 3 or 7 <= len(DIGIT.findall(text[c[1] : c[2]])) <= 15]


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = "".join(DIGIT.findall(span))
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    before = re.findall(r"[a-z]+", text[max(0, start - 32) : start].lower())[-4:]
    domain = span.rpartition("@")[2]
    parts = domain.split(".")
    octets = [int(g) for g in re.findall(r"[0-9]+", span)[:8]]
    return [
        *(float(kind == k) for k in range(4)),
        len(span), len(digits), len(digits) / max(len(span), 1), len(groups), max(groups, default=0), min(groups, default=0),
        float(span.startswith("+")), float(span.startswith("00")), float("(" in span), span.count(" "), span.count("-"), span.count("."), span.count("/"),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(len(octets) == 4 and max(octets, default=999) <= 255), float(digits[:2] in ("19", "20")),
        float("@" in span), len(parts[-1]) if "@" in span else 0, len(parts) if "@" in span else 0, float(parts[-1].isalpha()), float(bool(AT.search(span))),
        *(float(any(w in CUES[k] for w in before)) for k in range(4)), float(any(w in AGAINST for w in before)),
        float(any(w in CUES[kind] for w in before)),
        float(start > 0 and text[start - 1].isalnum()), float(end < len(text) and text[end].isalnum()), float(start > 0 and text[start - 1] in "#$€v/="),
    ]


class Boosted:
    """Boosted trees of the logistic loss over binned features, as arrays (feature, bin, value) of complete trees."""

    def __init__(self, edges, trees, start):
        self.edges, self.trees, self.start = edges, trees, start

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.start)
        for split, cut, leaf in self.trees:
            at = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, split[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Boosted:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, [], float(np.log(p / (1 - p))))
    b, z = model.binned(x), np.full(len(y), model.start)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-z))
        g, h = prob - y, prob * (1 - prob) + 1e-6
        split, cut, leaf = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64), np.zeros(2**DEPTH)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                best = 1e-6
                for k in range(x.shape[1] if len(rows) else 0):
                    gs, hs = (np.cumsum(np.bincount(b[rows, k], v[rows], BINS + 1)) for v in (g, h))
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    if gain.max() > best:
                        best, split[node], cut[node] = gain.max(), k, int(gain.argmax())
            at = 2 * at + 1 + (b[np.arange(len(y)), split[at]] > cut[at])
        for k in range(2**DEPTH):
            rows = at == k + 2**DEPTH - 1
            leaf[k] = -RATE * g[rows].sum() / (h[rows].sum() + 1)
        model.trees.append((split, cut, leaf))
        z += leaf[at - (2**DEPTH - 1)]
    return model


def made_up(seed: int, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with their personal data (kind, start, end), from formats and look-alikes."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(3, 9)))

    def card():
        body = r.choice("3456") + num(14)
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-"])
        return sep.join(whole[k : k + 4] for k in range(0, 16, 4))

    good = (
        (lambda: f"{word()}.{word()}@{word()}.{r.choice(['com', 'org', 'de', 'fr'])}", lambda: f"{word()}@mail.{word()}.net", lambda: f"{word()} (at) {word()}.com", lambda: f"{word()}[at]{word()}[dot]org"),
        (lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),),
        (card,),
        (lambda: f"+{r.randint(1, 99)} {num(3)} {num(7)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"0{num(3)} {num(6)}", lambda: f"00{r.randint(30, 49)} {num(3)} {num(4)} {num(3)}", lambda: f"{num(3)}-{num(3)}-{num(4)}"),
    )
    bad = (
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{num(4)} {num(4)} {num(4)}", lambda: f"{r.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}",
        lambda: f"{num(3)}-{num(2)}-{num(5)}-{num(2)}-{num(1)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)} {num(2)}", lambda: num(16), lambda: f"{num(2)}.{num(3)}.{num(3)}",
        lambda: f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", lambda: f"{word()}@{word()}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 400)}", lambda: f"{num(3)} {num(3)} {num(3)}",
    )
    out = []
    for _ in range(n):
        text, spans = word() + " " + word(), []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                kind = r.randrange(4)
                value = r.choice(good[kind])()
                text += " " + (r.choice(CUES[kind]) if r.random() < 0.75 else word()) + r.choice([" ", ": ", " is "])
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = r.choice(bad)()
                text += " " + (r.choice(AGAINST) if r.random() < 0.7 else word()) + r.choice([" ", ": ", " "])
            text += value + r.choice([" ", ", ", ". "]) + word()
        out.append((text, spans))
    return out


class Model:
    """Trees, the map from scores to probabilities, and a threshold for each kind."""

    def __init__(self, trees, scale, shift, thresholds):
        self.trees, self.scale, self.shift, self.thresholds = trees, scale, shift, thresholds

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.trees(x) + self.shift, -50, 50)))


@lru_cache(maxsize=2)
def fit(seed: int = 11, sentences: int = 4000, precision: float = PRECISION) -> Model:
    """Three quarters of the sentences train the trees, the rest calibrates them."""
    x, y, aside = [], [], []
    for n, (text, spans) in enumerate(made_up(seed, sentences)):
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(float(any(c[0] == s[0] and c[1] == s[1] and c[2] == s[2] for s in spans)))
            aside.append(n % 4 == 3)
    x, y, aside = np.array(x), np.array(y), np.array(aside)
    trees = boost(x[~aside], y[~aside])
    z, t = trees(x[aside]), y[aside]
    scale, shift = 1.0, 0.0
    for _ in range(50):  # logistic regression on the score, by Newton steps
        p = 1 / (1 + np.exp(-(scale * z + shift)))
        w = p * (1 - p) + 1e-6
        a, b, c = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum() + 1e-3
        g, h = ((p - t) * z).sum(), (p - t).sum()
        det = a * c - b * b
        scale, shift = scale - (c * g - b * h) / det, shift - (a * h - b * g) / det
    model = Model(trees, scale, shift, [1.0] * 4)
    p, kind = model.probability(x[aside]), x[aside][:, :4].argmax(axis=1)
    for k in range(4):
        own = np.sort(p[kind == k])[::-1]
        hits = t[kind == k][np.argsort(-p[kind == k], kind="stable")]
        good = np.flatnonzero(np.cumsum(hits) / np.arange(1, len(hits) + 1) >= precision)
        model.thresholds[k] = max(0.5, float(own[good[-1]])) if len(good) else 1.1
    return model


def find(texts: list[str | None], model: Model) -> list[list[tuple[int, int, int]]]:
    """Per text all (kind, start, end): base spans and accepted candidates, by kind and start."""
    base = [base_spans(t) if t else [] for t in texts]
    made = [(n, c) for n, t in enumerate(texts) if t for c in candidates(t)]
    covers = [Cover((s, e) for _, s, e in b) for b in base]
    open_ = [(n, c) for n, c in made if not covers[n].meets(c[1], c[2])]
    out = [list(b) for b in base]
    for at in range(0, len(open_), 4096):
        part = open_[at : at + 4096]
        p = model.probability(np.array([features(texts[n], *c) for n, c in part]))
        open_[at : at + 4096] = [(n, (*c, float(q))) for (n, c), q in zip(part, p, strict=True)]
    chosen: dict[int, list] = {}
    for n, (kind, start, end, p) in open_:
        if p >= model.thresholds[kind]:
            chosen.setdefault(n, []).append((-p, start, -end, kind))
    for n, every in chosen.items():
        taken = Cover()
        for _, start, end, kind in sorted(every):
            if not taken.meets(start, -end):
                taken.add(start, -end)
                out[n].append((kind, start, -end))
        out[n].sort()
    return out


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and `spans` (kind, start, end, base), sorted by kind as listed and start."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            texts = batch["text"].to_pylist()
            rows = []
            for text, spans in zip(texts, find(texts, shared.value), strict=True):
                base = set(base_spans(text)) if spans else ()
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": (k, s, e) in base} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` with personal data in `text` replaced by its kind in brackets; other columns and all rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch["text"].to_pylist()
            out = []
            for text, spans in zip(texts, find(texts, shared.value), strict=True):
                made, place = [], 0
                for start, end, kind in sorted((s, e, k) for k, s, e in spans):
                    if end > place:
                        made += [text[place : max(start, place)], f"[{KINDS[kind].upper()}]" if start >= place else ""]
                        place = end
                out.append("".join([*made, text[place:]]) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"),
    )
