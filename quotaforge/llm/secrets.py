"""Secret scans: fixed formats, and a guess-cost dynamic programme for values in credential context.

Formats (assignments, access keys, hexadecimal runs) are found by pattern. Values
that follow a wider set of credential words are scored like passwords: the least
log10 number of guesses over all segmentations into words, dates, repeats, runs of
the alphabet, keyboard walks and brute-force spans. A word costs its rank: in a short
list of parts that passwords are made of, or among the corpus's own words, counted
over all texts (`dictionary`; the `MOST_WORDS` most frequent ones are broadcast).
Values whose cost reaches the threshold are reported as kind `guess`, unless a format
span or an earlier value covers them already.

Offsets are code points, end exclusive. Defined cases: null texts have no spans;
very long values are segmented until no segmentation of the whole can stay below the
threshold (every segment kind has a bounded length or is a maximal run, so the
programme is linear in the value); of equally frequent words the first in byte order
ranks higher; rows that repeat are scanned each and counted each; further columns are
ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm.common import cut, table

KINDS = ("assign", "access", "hex", "guess")
#: Fixed by the query's contract.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that announce a credential, words that may stand between them and the value, and what parts these from each other.
NAMES = (
    r"(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_ -]?key|apikey|access[_ -]?key|private[_ -]?key|client[_ -]?secret"
    r"|credentials?|auth(?:orization)?|bearer|login|pin)(?![A-Za-z])"
)
BETWEEN = (
    r"(?:keys?|ids?|values?|strings?|codes?|hash|header|basic|digest|is|was|are|be|to|for|of|the|this|my|your|our|their|new|old|current|temporary|default"
    r"|user|account|admin|root|server|database|db|service|prod(?:uction)?|test|staging|set)(?![A-Za-z])"
)
CONTEXT = re.compile(rf"(?<![A-Za-z]){NAMES}", re.ASCII | re.IGNORECASE)
GAP = re.compile(r"""["'`)\]]*[\x20\t]*(?:(?:[:=]+>?|->)\s*)?["'`]?""", re.ASCII)
STEP_WORD = re.compile(rf"""[_-]?(?:{NAMES}|{BETWEEN})(?=["'`)\]]*[\x20\t:=]|[_-](?:{NAMES}|{BETWEEN}))""", re.ASCII | re.IGNORECASE)
VALUE = re.compile(r"""[^\x00-\x20"'<>,;`]+""")
#: Words of letters in lower case, in capitals or with a first capital, as "(username/password".
PROSE = re.compile(r"[\[({]*(?:[A-Z]?[^\W\d_A-Z]+|[A-Z]+)(?:[-\u2010-\u2015'\u2019/.:()]+(?:[A-Z]?[^\W\d_A-Z]+|[A-Z]+))*")
HINT = re.compile(r"pass|pwd|secret|token|key|credential|auth|bearer|login|pin", re.ASCII | re.IGNORECASE)
#: Least log10 guesses of a value that is reported.
THRESHOLD = 10.0

#: Common parts of chosen passwords, most frequent first (the rank is the number of guesses).
WORDS = (
    "password pass admin login welcome letmein qwerty dragon monkey master shadow sunshine princess football baseball "
    "iloveyou love hello secret test user root guest default changeme access super hunter trust summer winter spring autumn "
    "monday friday january march april june july august september october november december example sample demo temp "
    "token key api client server public private account name email home house star angel michael jordan thomas robert "
    "daniel charlie george andrew william james london paris berlin madrid the and that with this from have for you not "
    "are was but all can her one our out day get has him his how man new now old see two way who boy did its let put say she too use"
).split()
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
#: Words of the corpus that may have a rank: their letters, and how many are kept.
CORPUS_WORD, LONGEST, MOST_WORDS = re.compile(r"(?<![a-z])[a-z]{3,16}(?![a-z])"), 16, 50_000
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (x, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
LEET = str.maketrans("4@31!05$7", "aaeilosst")
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)?\d\d)"
)


CLASSES = (
    (10, re.compile(r"[0-9]")), (26, re.compile(r"[a-z]")), (26, re.compile(r"[A-Z]")), (33, re.compile(r"[\x00-/:-@\[-`{-\x7f]")), (100, re.compile(r"[^\x00-\x7f]")),
)


def _alphabet(value: str) -> float:
    """log10 of the size of the character classes in `value`."""
    return math.log10(max(sum(size for size, some in CLASSES if some.search(value)), 10))


def _next(kind: str, a: str, b: str) -> bool:
    if kind == "repeat":
        return a == b
    if kind in ("up", "down"):
        return a.isalnum() and b.isalnum() and ord(b) - ord(a) == (1 if kind == "up" else -1)
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def segments(value: str, rank: dict[str, int] = RANK):
    """(start, end, log10 guesses, kind) of the pattern segments of `value`, by start."""
    low = value.lower()
    if len(low) != len(value):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    leet = low.translate(LEET)
    n = len(value)
    done = dict.fromkeys(("repeat", "up", "down", "walk"), 0)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            at = rank.get(low[i:j])
            swapped = 0.0 if at else 0.7
            if at := at or rank.get(leet[i:j]):
                case = 0.0 if value[i:j] == low[i:j] else 0.3 if value[i + 1 : j] == low[i + 1 : j] or value[i:j].isupper() else 1.0
                yield i, j, math.log10(at) + swapped + case, "word"
        if (m := DATE.match(value, i)) and m.end() - i >= 4:
            yield i, m.end(), math.log10(120 * (365 if m.end() - i > 4 else 1)), "date"
            if m.end() - i > 4 and value[i : i + 2] in ("19", "20"):
                yield i, i + 4, math.log10(120), "date"
        for kind, end in done.items():
            if end <= i:  # a maximal run begins here
                end = i + 1
                while end < n and _next(kind, low[end - 1], low[end]):
                    end += 1
                done[kind] = end
                if end - i >= 3:
                    base = {"repeat": _alphabet(low[i]), "up": 1.6, "down": 1.9, "walk": 1.7}[kind]
                    turn = 0.5 * (end - i) if kind == "walk" else 0.0
                    yield i, end, base + math.log10(end - i) + turn, kind


def guess_cost(value: str, rank: dict[str, int] = RANK, enough: float = math.inf) -> float:
    """Least sum of log10 guesses over all segmentations of `value`; once none can cost less than `enough`, a lower bound of it."""
    n, each = len(value), _alphabet(value)
    best = {0: 0.0}
    ahead = [(0.0, 0)]  # costs of the places reached so far; every way to the end passes one that is not done
    found = segments(value, rank)
    at = next(found, None)
    for i in range(n):
        here = best.pop(i)
        while ahead[0][1] < i:
            heapq.heappop(ahead)
        if ahead[0][0] >= enough:
            return ahead[0][0]
        steps = [(i + 1, each)]
        while at and at[0] == i:
            steps.append((at[1], at[2]))
            at = next(found, None)
        for end, cost in steps:
            if here + cost < best.get(end, math.inf):
                best[end] = here + cost
                heapq.heappush(ahead, (here + cost, end))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed formats, by start and kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def values(text: str) -> dict[tuple[int, int], bool]:
    """Spans of the values after credential words, and whether a sign (such as : or =) announces them.

    Each credential word is followed on its own, over any number of further credential and connecting words.
    """
    out: dict[tuple[int, int], bool] = {}
    known: dict[int, tuple[tuple[int, int] | None, bool]] = {}  # by the end of a word: what follows it
    low = high = trimmed = len(text)  # the run of a value's characters that was read last, and its end without punctuation

    def end_of(begin: int) -> int:
        nonlocal low, high, trimmed
        if not low <= begin < high:
            v = VALUE.match(text, begin, low if begin < low else len(text))
            stop = v.end() if v else begin
            if not (begin < low == stop < high):  # else it runs on into the one read last
                high = trimmed = stop
                while trimmed > begin and text[trimmed - 1] in ".:!?)]}":
                    trimmed -= 1
            low = begin
        return max(begin, trimmed)

    for m in reversed(list(CONTEXT.finditer(text))):
        at, path = m.end(), []
        while at not in known:
            gap = GAP.match(text, at)
            path.append((at, any(c in ":=>" for c in gap[0])))
            step = STEP_WORD.match(text, gap.end())
            if not step:
                begin = gap.end()
                end = end_of(begin)
                known[at] = ((begin, end) if begin < end else None, path.pop()[1])
                break
            at = step.end()
        span, told = known[at]
        for k, sign in reversed(path):
            told = told or sign
            known[k] = span, told
        if span:
            out[span] = out.get(span, False) or told
    return out


def looks_secret(value: str, told: bool, threshold: float, rank: dict[str, int] = RANK) -> bool:
    """A value is reported for its cost alone, but one that no sign announces and that reads as a word of prose is none."""
    return (told or not PROSE.fullmatch(value)) and guess_cost(value, rank, threshold) >= threshold


def spans(text: str | None, threshold: float = THRESHOLD, rank: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """All spans by start and kind: the base ones, and costly values in credential context that no base span or earlier value covers whole."""
    if not text:
        return []
    out = base_spans(text)
    if HINT.search(text):
        starts, reach = [s for s, _, _ in out], list(accumulate((e for _, e, _ in out), max))
        last = 0
        for (start, end), told in sorted(values(text).items()):
            k = bisect_right(starts, start)
            if end > last and not (k and reach[k - 1] >= end) and looks_secret(text[start:end], told, threshold, rank):
                out.append((start, end, 3))
                last = end
    return sorted(out, key=lambda s: (s[0], s[2]))


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word of 3 to 16 letters a-z occurs in the column text, in lower case."""

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                count.update(CORPUS_WORD.findall((text or "").lower()))
                if len(count) >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["word", "n"])
                    count.clear()
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """Ranks of the `most` most frequent words of all texts, and of the fixed list (the better rank counts).

    A histogram of the counts tells how frequent a word must be, so that hardly more than `most` rows reach the driver.
    """
    words = cut(corpus_words(docs))
    octave = F.floor(8 * F.log2("n")).cast("long")
    least, held = 0, 0
    for least, n in sorted(words.groupBy(octave.alias("bin")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        held += n
        if held >= most:
            break
    top = words.filter(octave >= least).orderBy(F.desc("n"), "word").limit(most).select("word").collect()
    rank = {r[0]: k + 1 for k, r in enumerate(top)}
    return rank | {w: min(k, rank.get(w, k)) for w, k in RANK.items()}


SPANS = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame, threshold: float = THRESHOLD, rank: dict[str, int] | None = None) -> DataFrame:
    """doc_id and `spans` (start, end, kind), sorted by start and kind; words rank as in `rank`, or as in `docs` where it is not given."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs) if rank is None else rank)

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            found = [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in spans(t.as_py(), threshold, shared.value)] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """`text` with each maximal union of spans replaced by the first one's kind in brackets."""
    out, at, k = [], 0, 0
    while k < len(found):
        start, end, kind = found[k]
        while k < len(found) and found[k][0] < end:
            end = max(end, found[k][1])
            k += 1
        out += [text[at:start], f"[SECRET:{KINDS[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, threshold: float = THRESHOLD, rank: dict[str, int] | None = None) -> DataFrame:
    """`docs` with the secrets in `text` masked; other columns and all rows stay. `rank` as in `scan`."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs) if rank is None else rank)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for t in batch["text"]:
                t = t.as_py()
                found = spans(t, threshold, shared.value)
                texts.append(masked(t, found) if found else t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != KINDS[3])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
