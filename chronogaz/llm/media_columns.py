"""Media columns: Matroska bytes in a binary column, and their packet tables.

`mux` stores any payload losslessly as 8-bit PCM in a Matroska file; `packets` parses such files - variable-length
EBML elements, clusters, simple blocks and block groups, all four kinds of lacing, cues - into one row per packet with
track, timestamp, byte range and keyframe flag; `payloads` puts a track's bytes together again from those ranges.

Nulls: a null payload is muxed as an empty one, a null media value has no packets. A file that is cut off or damaged
gives the packets before the damage. Repeated rows stay apart; other columns pass through, and one that has the name of
a column of the packet table gives way to it. A payload and its media are held whole: a very long one must fit a task's
memory some six times, and batches of rows are cut to a bounded number of bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogaz.llm.common import batches, cut, give_back, text_bytes

#: Samples in a frame, frames in a laced block, blocks in a cluster, samples a second.
FRAME, LACE, BLOCKS, RATE = 192, 8, 32, 8000
#: Bytes of a column in a batch.
BATCH = 4 << 20

# Fixed values of the Matroska format: element ids.
EBML, EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1
SAMPLING, CHANNELS, DEPTH, FRAME_TIME = 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
UNKNOWN = -1
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP}


def vint(n: int, width: int = 0) -> bytes:
    """A data size as a variable-length integer."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, data: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _head(payload_len: int) -> tuple[bytes, bytes]:
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + uint(DOCTYPE_VERSION, 4) + uint(DOCTYPE_READ, 2))
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", payload_len * 1000 / RATE)) + element(MUXER, b"pcm8") + element(WRITER, b"pcm8"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + uint(LACING, 1) + uint(FRAME_TIME, FRAME * 10**9 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    return head, info + tracks


def mux_bytes(payload: bytes) -> bytes:
    """One PCM track: frames of FRAME samples, LACE of them in a block with fixed lacing, cues for every cluster."""
    head, body = _head(len(payload))
    parts, cues, at = [body], [], len(body)
    step, span = FRAME * LACE, FRAME * LACE * BLOCKS
    for start in range(0, len(payload), span):
        base, blocks = start * 1000 // RATE, []
        for lo in range(start, min(start + span, len(payload)), step):
            data = payload[lo : lo + step]
            frames = -(-len(data) // FRAME)
            rel = struct.pack(">h", lo * 1000 // RATE - base)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + rel + (b"\x84" + bytes([frames - 1]) if frames > 1 else b"\x80") + data))
        cluster = element(CLUSTER, uint(TIMESTAMP, base) + b"".join(blocks))
        cues.append(element(CUE, uint(CUE_TIME, base) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def _number(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """A variable-length integer and its width; UNKNOWN for the size that means unknown."""
    first = data[at]
    if not first:
        raise ValueError("an integer of more than 8 bytes")
    width = 9 - first.bit_length()
    n = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError("cut off")
    if keep_marker:
        return n, width
    n &= (1 << 7 * width) - 1
    return (UNKNOWN if n == (1 << 7 * width) - 1 else n), width


def elements(data: bytes, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of each element's data; masters that hold blocks are entered right after they are given."""
    stack = [(lo, len(data) if hi is None else hi)]
    while stack:
        at, end = stack.pop()
        while at < end:
            eid, w = _number(data, at, True)
            size, v = _number(data, at + w, False)
            start = at + w + v
            stop = end if size == UNKNOWN else start + size
            if stop > len(data) and eid not in MASTERS:
                raise ValueError("cut off")
            yield eid, start, min(stop, len(data))
            at = stop
            if eid in MASTERS:
                stack.append((at, end))
                at, end = start, min(stop, len(data))


def _lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames: no lacing, Xiph, fixed size or EBML lacing."""
    if not kind:
        return [(at, end)]
    count = data[at] + 1
    at += 1
    if kind == 2:
        size = (end - at) // count
        return [(at + i * size, at + (i + 1) * size) for i in range(count)]
    sizes = []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        n, w = _number(data, at, False)
        sizes.append(n)
        at += w
        for _ in range(count - 2):
            d, w = _number(data, at, False)
            sizes.append(sizes[-1] + d - ((1 << 7 * w - 1) - 1))
            at += w
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return [*out, (at, end)] if all(0 <= a <= b <= end for a, b in out) else []


def parse(data: bytes) -> list[tuple[int, int, int, int, int, bool]]:
    """Packets in file order: (track, timestamp in milliseconds, start, end, lace index, keyframe).

    A block's time counts in the file's scale; the frames of a lace follow each other by the track's default duration,
    and stand at their block's time where the track names none."""
    out, base, scale, frame_ns = [], 0, 10**6, {}
    try:
        for eid, lo, hi in elements(data):
            if eid == INFO:
                scale = next((int.from_bytes(data[a:b], "big") for e, a, b in elements(data, lo, hi) if e == SCALE), scale)
            elif eid == TRACKS:
                for entry, a, b in elements(data, lo, hi):
                    own = {e: int.from_bytes(data[c:d], "big") for e, c, d in elements(data, a, b) if e in (NUMBER, FRAME_TIME)} if entry == TRACK else {}
                    frame_ns[own.get(NUMBER)] = own.get(FRAME_TIME, 0)
            elif eid == TIMESTAMP:
                base = int.from_bytes(data[lo:hi], "big")
            elif eid in (SIMPLE_BLOCK, BLOCK):
                track, w = _number(data, lo, False)
                at = (base + struct.unpack_from(">h", data, lo + w)[0]) * scale
                flags, step = data[lo + w + 2], frame_ns.get(track, 0)
                for k, (a, b) in enumerate(_lace(data, lo + w + 3, hi, flags >> 1 & 3)):
                    out.append((track, (at + k * step) // 10**6, a, b, k, bool(flags & 128) and eid == SIMPLE_BLOCK))
    except (ValueError, IndexError, struct.error):
        pass  # a file that ends early gives what came before
    return out


def cue_points(data: bytes) -> list[tuple[int, int]]:
    """(time, cluster's place in the segment) of each cue."""
    out, segment = [], 0
    for eid, lo, hi in elements(data):
        segment = lo if eid == SEGMENT else segment
        if eid == CUES:
            for cue, a, b in elements(data, lo, hi):
                if cue == CUE:
                    got = {e: (x, y) for e, x, y in elements(data, a, b)}
                    where = {e: data[x:y] for e, x, y in elements(data, *got[CUE_POSITIONS])}
                    out.append((int.from_bytes(data[slice(*got[CUE_TIME])], "big"), int.from_bytes(where[CUE_CLUSTER], "big")))
    return out


def padded(data: bytes, unit: int = FRAME) -> bytes:
    return data + b" " * (-len(data) % unit or (0 if data else unit))


def mux(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Adds the Matroska form of a binary or string column, padded with spaces to whole frames."""
    rows = df.drop(media).withColumn(media, F.coalesce(F.col(payload).cast("binary"), F.lit(b"")))

    def run(it):
        for b in (s for x in it for s in batches([x], BATCH, media)):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([mux_bytes(padded(x)) for x in text_bytes(b, media)], pa.binary())], b.schema.names)
        give_back()

    return rows.mapInArrow(run, rows.schema)


PACKETS = "array<struct<track:int,timestamp_ms:long,byte_start:long,byte_end:long,lace:int,keyframe:boolean>>"


def packets(df: DataFrame, media: str = "media") -> DataFrame:
    """The packet table: a row for each packet, with the columns of df but the media."""

    names = ("track", "timestamp_ms", "byte_start", "byte_end", "lace", "keyframe")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())

    @F.arrow_udf(PACKETS)
    def parsed(a: pa.Array) -> pa.Array:
        found = [parse(x.as_py()) if x.is_valid else [] for x in a]
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        cols = list(zip(*(p for f in found for p in f))) or [()] * len(names)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names))

    own = {"packet_no", *names}
    kept = [c for c in df.columns if c != media and c not in own]
    found = df.select(F.struct(*kept, F.lit(0).alias("_")).alias("row"), F.posexplode(parsed(F.col(media))).alias("packet_no", "packet"))
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "packet_no", "packet.*")


def payloads(df: DataFrame, media: str = "media", payload: str = "payload", track: int = 1) -> DataFrame:
    """Adds a track's bytes, put together from its packets' byte ranges."""

    @F.arrow_udf("binary")
    def joined(a: pa.Array) -> pa.Array:
        whole = lambda x: b"".join(x[lo:hi] for t, _, lo, hi, _, _ in parse(x) if t == track)
        return pa.array([whole(x.as_py()) if x.is_valid else None for x in a], pa.binary())

    return df.withColumn(payload, joined(F.col(media)))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, duration_ms long"


def media_digest(df: DataFrame) -> DataFrame:
    """For each row (doc_id, text): the text is muxed into a media column of a table in the shared folder, the stored
    bytes are read back and parsed, and features are computed from the packets.

    feature: packets, clusters named by cues, mean and spread of the samples, zero crossings about 128. A function of
    the stored bytes alone, so equal texts get equal values.
    """

    def run(it):
        names, types = ([x.split()[k] for x in FEATURES.split(", ")] for k in (0, 1))
        for batch in (s for b in it for s in batches([b], BATCH, "media")):
            out = []
            for doc, size, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = parse(media)
                payload = b"".join([media[a:b] for _, _, a, b, _, _ in found])
                s = np.frombuffer(payload, np.uint8)
                high = s >= 128
                feature = f"{len(found)}:{len(cue_points(media))}:{s.mean():.4f}:{s.std():.4f}:{int(np.count_nonzero(high[1:] != high[:-1]))}"
                out.append((doc, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(found), found[-1][1] + FRAME * 1000 // RATE))
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(cols, types)], names)
        give_back()

    text = F.col("text").cast("string")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    stored = cut(mux(rows, "text").select("doc_id", "n_bytes", "media"))
    return stored.mapInArrow(run, FEATURES)
