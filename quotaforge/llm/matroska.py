"""Media columns in Matroska: EBML elements, clusters, laced blocks and cues.

`mux` stores bytes as an audio track of 8-bit samples (codec A_PCM/INT/LIT): an EBML
header and one segment of info, track, clusters of laced simple blocks, and cues.
`demux` reads any such file back: variable-length ids and sizes (unknown sizes too),
simple blocks and block groups, and all four kinds of lacing, into a packet table
with track, timestamp, cluster and byte range. `packets` makes that table from a
column of media. Every file is handled by itself, in memory that its size bounds.

Defined cases: null texts are stored like empty ones (64 zero bytes); null media
have no packets; where a file is cut short or damaged, the packets before that
place are returned and `whole` is false; rows that repeat are handled each, with
equal results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaforge.llm.common import table

#: Element ids, fixed by the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, MUXER, WRITER = 0x4282, 0x2AD7B1, 0x4D80, 0x5741
TRACK, NUMBER, UID, TYPE, LACES, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_PLACES}
#: Elements whose values are read, whatever their size; others (frames, titles, attachments) are only passed over.
READ = {DOC_TYPE, SCALE, NUMBER, CODEC, RATE, DEPTH, TIME, CUE_TIME, CUE_CLUSTER}
NONE, XIPH, FIXED, VARIED = 0, 1, 2, 3

UNIT, FRAME, LACE, BLOCKS = 64, 512, 8, 32
HERTZ = 8000
MS_PER_FRAME = 1000 * FRAME // HERTZ


def number(n: int, width: int | None = None) -> bytes:
    """A variable-length integer: a length marker bit, then the value."""
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def element(kind: int, *content) -> bytes:
    body = b"".join(x if isinstance(x, bytes) else x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big") for x in content)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + number(len(body)) + body


def block(track: int, at: int, frames: list[bytes], lacing: int | None = None) -> bytes:
    """Body of a simple block; the lacing defaults to the smallest that can hold the frames."""
    if lacing is None:
        lacing = NONE if len(frames) == 1 else FIXED if len({*map(len, frames)}) == 1 else VARIED
    head = number(track) + struct.pack(">hB", at, 0x80 | (lacing << 1))
    if lacing == NONE:
        return head + b"".join(frames)
    sizes = [len(f) for f in frames]
    lace = bytes([len(frames) - 1])
    if lacing == XIPH:
        lace += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == VARIED:
        lace += number(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << (7 * w - 1)) - 1)
            lace += number(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + lace + b"".join(frames)


HEADER = element(
    EBML, element(0x4286, 1), element(0x42F7, 1), element(0x42F2, 4), element(0x42F3, 8), element(DOC_TYPE, b"matroska"), element(0x4287, 4), element(0x4285, 2)
)
LEAD = element(INFO, element(SCALE, 1_000_000), element(MUXER, b"quotaforge"), element(WRITER, b"quotaforge")) + element(
    TRACKS,
    element(
        TRACK, element(NUMBER, 1), element(UID, 1), element(TYPE, 2), element(LACES, 1), element(CODEC, b"A_PCM/INT/LIT"),
        element(AUDIO, element(RATE, struct.pack(">f", HERTZ)), element(CHANNELS, 1), element(DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """The payload as one audio track: frames of 512 samples, 8 to a block, 32 blocks to a cluster, a cue for each cluster."""
    clusters, cues, place = [], [], len(LEAD)
    span = FRAME * LACE * BLOCKS
    for c in range(0, max(len(payload), 1), span):
        at = c // FRAME * MS_PER_FRAME
        laced = []
        for k, b in enumerate(range(c, min(c + span, len(payload)), FRAME * LACE)):
            part = payload[b : min(b + FRAME * LACE, c + span)]
            laced.append(element(SIMPLE, block(1, k * LACE * MS_PER_FRAME, [part[f : f + FRAME] for f in range(0, len(part), FRAME)])))
        clusters.append(element(CLUSTER, element(TIME, at), *laced))
        cues.append(element(CUE, element(CUE_TIME, at), element(CUE_PLACES, element(CUE_TRACK, 1), element(CUE_CLUSTER, place))))
        place += len(clusters[-1])
    return HEADER + element(SEGMENT, LEAD, *clusters, element(CUES, *cues))


@dataclass
class Media:
    """What `demux` finds; `rows` has (track, timestamp, cluster, offset, length) of each packet."""

    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict = field(default_factory=dict)
    rows: list = field(default_factory=list)
    blocks: int = 0
    clusters: int = 0
    cues: list = field(default_factory=list)
    segment: int = 0
    whole: bool = True


def _vint(buf: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """Value, next place and whether the size is unknown (all ones)."""
    first = buf[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(buf):
        raise ValueError("bad variable-length integer")
    raw = int.from_bytes(buf[at : at + width], "big")
    value = raw & ((1 << (7 * width)) - 1)
    return (raw if keep else value), at + width, value == (1 << (7 * width)) - 1


def _frames(buf: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Track, relative time and (offset, length) of the frames in a block's body."""
    track, at, _ = _vint(buf, at)
    time, flags = struct.unpack_from(">hB", buf, at)
    at += 3
    lacing = (flags >> 1) & 3
    if lacing == NONE:
        return track, time, [(at, end - at)]
    n = buf[at] + 1
    at += 1
    if lacing == FIXED:
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if lacing == XIPH:
                size = 0
                while buf[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + buf[at], at + 1
            else:
                start = at
                size, at, _ = _vint(buf, at)
                if k:
                    size += sizes[-1] - ((1 << (7 * (at - start) - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("bad lacing")
        out.append((at, size))
        at += size
    return track, time, out


def demux(buf: bytes | None, frame_ms: dict[int, int] | None = None) -> Media:
    """Tracks, packets and cues of a file; `frame_ms` overrides the time between the frames of one block by track."""
    out = Media()
    cluster_at = cluster_time = 0
    track: dict = {}
    cue: dict = {}
    stack = [(0, len(buf or b""), 0)]
    try:
        while stack:
            at, end, parent = stack.pop()
            while at < end:
                kind, body, _ = _vint(buf, at, keep=True)
                size, body, unknown = _vint(buf, body)
                stop = end if unknown else body + size
                if stop > end:
                    raise ValueError("element beyond its parent")
                value = buf[body:stop] if kind in READ else b""
                if kind == CLUSTER:
                    cluster_at, cluster_time, out.clusters = at, 0, out.clusters + 1
                elif kind == SEGMENT:
                    out.segment = body
                elif kind == TRACK:
                    track = {"codec": "", "rate": 0.0, "depth": 0}
                elif kind == CUE:
                    cue = {}
                if kind in PARENTS:
                    # a parent of unknown size goes on to the end of its own parent, as its siblings are parsed alike
                    stack.append((stop, end, parent))
                    at, end, parent = body, stop, kind
                    continue
                if kind == DOC_TYPE:
                    out.doc_type = value.decode("ascii", "replace")
                elif kind == EBML:
                    stack.append((stop, end, parent))
                    at, end, parent = body, stop, kind
                    continue
                elif kind == SCALE:
                    out.scale = int.from_bytes(value, "big")
                elif kind == NUMBER:
                    out.tracks[int.from_bytes(value, "big")] = track
                elif kind == CODEC:
                    track["codec"] = value.decode("ascii", "replace")
                elif kind == RATE:
                    track["rate"] = struct.unpack(">f" if size == 4 else ">d", value)[0] if size else 0.0
                elif kind == DEPTH:
                    track["depth"] = int.from_bytes(value, "big")
                elif kind == TIME:
                    cluster_time = int.from_bytes(value, "big")
                elif kind in (SIMPLE, BLOCK):
                    which, time, frames = _frames(buf, body, stop)
                    about = out.tracks.get(which, {})
                    rate, each = about.get("rate", 0), (frame_ms or {}).get(which)
                    done = 0
                    for offset, length in frames:
                        step = (each * 1e6 / out.scale if each else done / (rate * max(about.get("depth", 8) // 8, 1)) * 1e9 / out.scale if rate else 0) if done else 0
                        out.rows.append((which, cluster_time + time + round(step), cluster_at, offset, length))
                        done += length if not each else 1
                    out.blocks += 1
                elif kind == CUE_TIME:
                    cue["time"] = int.from_bytes(value, "big")
                elif kind == CUE_CLUSTER:
                    out.cues.append((cue.get("time", 0), out.segment + int.from_bytes(value, "big")))
                at = stop
    except (ValueError, IndexError, struct.error, KeyError):
        out.whole = False
    return out


def seek(media: Media, time: int) -> int:
    """Place of the cluster that the cues name for `time`."""
    before = [place for t, place in media.cues if t <= time]
    return before[-1] if before else media.segment


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and `media`: each text, padded to whole units, as a Matroska file."""

    def run(batches):
        for batch in batches:
            made = [payload_of(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packet table of the column `media`: one row per frame, and the file's `whole`."""
    kind = dict(media.dtypes)[key]

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, m in enumerate(batch["media"]):
                found = demux(m.as_py())
                for n, row in enumerate(found.rows):
                    keys.append(k)
                    rows.append((n, *row, found.tracks.get(row[0], {}).get("codec", ""), found.whole))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            names = ["packet", "track", "timestamp", "cluster", "offset", "length", "codec", "whole"]
            yield pa.RecordBatch.from_arrays(
                [batch[key].take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, *names]
            )

    return media.select(key, "media").mapInArrow(
        run, f"{key} {kind}, packet int, track long, timestamp long, cluster long, offset long, length long, codec string, whole boolean"
    )


def feature(found: Media, payload: bytes) -> str:
    """Packet counts and signal statistics of the samples, as one string."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / max(len(x), 1)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    last = max((r[1] for r in found.rows), default=0)
    signal = x.astype(np.int16) - 128
    crossings = int(((signal[1:] < 0) != (signal[:-1] < 0)).sum())
    return (
        f"clusters={found.clusters};blocks={found.blocks};packets={len(found.rows)};cues={len(found.cues)};last_ms={last}"
        f";mean={x.mean() if len(x) else 0:.3f};std={x.std() if len(x) else 0:.3f};entropy={entropy:.4f};crossings={crossings}"
    )


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored files hold: payload size and digests, and the features."""

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch["media"]:
                m = m.as_py() or b""
                found = demux(m)
                payload = b"".join([m[r[3] : r[3] + r[4]] for r in found.rows])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(found, payload)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names]
            )

    return stored.mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents")))
