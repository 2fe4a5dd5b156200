"""Suffix-array dedup of exact substrings, by external induced sorting of sampled suffixes.

A byte goes if it is covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

Sampling. Every window of `length` bytes names one suffix in it: the one whose first k bytes hash least (leftmost of
equals). Equal windows name the same place, so only these sampled suffixes - one in about 13 bytes - are sorted, each
together with the run of windows that name it. A first round sends the 40-odd bit codes of their first k bytes, delta
coded, to code ranges and keeps the samples whose code stands in two documents; no other window can repeat.

Sorting and induction. Kept samples go, with the bytes around them, to code ranges of bounded size. There the sampled
suffixes are sorted with their common-prefix values; the order of the suffixes one byte further left is then induced
from that order by a stable bucket sort on the byte before, and so on for each place to the left, carrying the classes
of equal left strings. At every step, neighbours whose right common prefix reaches the window's end form the class of
one window, and its smallest doc_id decides for all. Runs, merges and queues between tasks are Spark's shuffle, whose
sorters spill to disk; a task holds one shard or one code range.

Hot samples. A code that stands in more than `hot` places would make one range grow without bound. Its windows are dealt
out by their own 128-bit hash instead, after each shard has reduced equal windows to one with its smallest doc_id.

Null text is empty. Texts shorter than `length` lose nothing. Rows with equal doc_ids do not remove from each other. A
null doc_id counts as the largest. Extra columns are ignored. One text must fit a task's memory some ten times.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogaz.llm.common import batches, cut, shared_dir, text_bytes

LENGTH = 50
#: Bytes of text in a shard; codes and kept samples in a range; places of one code beyond which it is hot.
SHARD_BYTES, CODE_ROWS, BUCKET_ROWS, HOT = 8 << 20, 2_000_000, 120_000, 5_000
#: Bytes of text in a bucket of the table of shards.
BUCKET_BYTES = 64 << 20
NULL_ID = (1 << 63) - 1
_CHUNK_BITS = 17
_U = np.uint64
_MULS = [0xD1342543DE82EF95, 0x9E3779B97F4A7C15]


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(data))


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes plane by plane, compressed: equal high bytes cost nothing."""
    a = np.ascontiguousarray(a)
    return _zip(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(np.frombuffer(_unzip(data), np.uint8).reshape(size, -1).T.tobytes(), dtype)


def _hashes(b: np.ndarray, k: int, mul: int) -> np.ndarray:
    """A hash of each run of k bytes: polynomials of lengths 1, 2, 4 ... joined to k, then mixed."""
    level, have = b.astype(_U) * _U(0x9FB21C651E98DF25) + _U(0x8CB92BA72F3D8DD7), 1
    out, got = None, 0
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, got = level, have
            else:
                m = len(b) - got - have + 1
                out = out[:m] * _U(pow(mul, have, 1 << 64)) + level[got : got + m]
                got += have
        rest >>= 1
        if rest:
            m = len(b) - 2 * have + 1
            level = level[:m] * _U(pow(mul, have, 1 << 64)) + level[have : have + m]
            have *= 2
    return _mixed(out[: len(b) - k + 1])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    return h


class Samples:
    """The sampled suffixes of a shard: place `at`, first and last window `lo`, `hi`, code and document of each."""

    def __init__(self, buf: np.ndarray, ends: np.ndarray, length: int, bits: int):
        self.w = min(32, length // 2)
        self.k = length - self.w + 1
        n = max(0, len(buf) - length + 1)
        begins = np.append(0, ends[:-1]).astype(np.int64)
        valid = np.ones(n, bool)
        for s, e in zip(begins.tolist(), ends.tolist()):
            valid[max(s, e - length + 1) : e] = False
        parts, chunk = [], 1 << _CHUNK_BITS
        mask = _U((1 << _CHUNK_BITS + 1) - 1)
        for c in range(0, n, chunk):
            c2 = min(n, c + chunk)
            inside = np.flatnonzero(valid[c:c2])
            if not len(inside):
                continue
            h = _hashes(buf[c : c2 + length - 1], self.k, _MULS[0])
            m = (h & ~mask) | np.arange(len(h), dtype=_U)
            width = 1
            while width * 2 <= self.w:
                m = np.minimum(m[:-width], m[width:])
                width *= 2
            if width < self.w:
                m = np.minimum(m[: len(m) - (self.w - width)], m[self.w - width :])
            p = (m[inside] & mask).astype(np.int64)
            fresh = np.append(True, (p[1:] != p[:-1]) | (np.diff(inside) > 1))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(p)) - 1
            parts.append((p[first] + c, inside[first] + c, inside[last] + c, h[p[first]]))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.array([], np.int64)] * 3 + [np.array([], _U)]
        self.at, self.lo, self.hi, h = cols
        self.code = _mixed(h * _U(_MULS[1])) >> _U(64 - bits)
        self.doc = np.searchsorted(ends, self.lo, side="right")


def _load(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, doc_ids, ends, bytes) of a row of the shard table."""
    shard, ids, ends, text = (batch.column(k)[i].as_py() for k in range(4))
    return shard, np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), np.frombuffer(_unzip(text), np.uint8)


def _shards(df: DataFrame, shard_bytes: int) -> tuple[str, int]:
    """The documents as rows of many texts, in a table bucketed by shard so that later joins leave the text where it is."""
    spark = df.sparkSession
    size = int(df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)

    def run(it):
        part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary()), pa.array([_zip(b"".join(texts))], pa.binary()), pa.array([size])], ["shard", "ids", "ends", "text", "size"])

        for batch in (s for b in it for s in batches([b], shard_bytes // 4 + 1)):
            for d, t in zip(batch.column(0).to_pylist(), text_bytes(batch)):
                ids.append(NULL_ID if d is None else d)
                texts.append(t)
                size += len(t)
                if size >= shard_bytes:
                    yield row()
                    n, ids, texts, size = n + 1, [], [], 0
        if ids:
            yield row()

    rows = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "shard long, ids binary, ends binary, text binary, size long")
    # more buckets than shuffle partitions: joins then deal the other side to these buckets; a bucket's texts stay bounded
    name, buckets = f"shards_{uuid.uuid4().hex}", max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, size // BUCKET_BYTES)
    # binary columns hold compressed text already
    rows.write.bucketBy(buckets, "shard").option("path", shared_dir(spark)).option("compression", "none").option("parquet.enable.dictionary", "false").format("parquet").saveAsTable(name)
    return name, size


def _codes(table: DataFrame, length: int, bits: int, ranges: int) -> DataFrame:
    """(bucket, shard, codes, counts): each shard's distinct codes in order, with the places and documents of each."""

    def run(it):
        for b in it:
            for i in range(b.num_rows):
                shard, _, ends, buf = _load(b, i)
                s = Samples(buf, ends, length, bits)
                yield from _code_rows(shard, *_distinct(s), bits, ranges)

    return table.select("shard", "ids", "ends", "text").mapInArrow(run, "bucket long, shard long, codes binary, counts binary")


def _distinct(s: Samples) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order; places of each, negative if in one document only."""
    order = np.argsort(s.code, kind="stable")
    code, doc = s.code[order], s.doc[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.array([], np.int64)
    n = np.diff(np.append(first, len(code)))
    last = first + n - 1  # equal codes keep the order of their documents
    return code[first], np.where(doc[first] == doc[last], -n, n) if len(code) else n


def _range_of(code: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    top = min(bits, 32)
    return ((code >> _U(bits - top)) * _U(ranges) >> _U(top)).astype(np.int64)


def _code_rows(shard: int, code: np.ndarray, n: np.ndarray, bits: int, ranges: int):
    place = _range_of(code, bits, ranges)
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else []
    rows = [(int(place[a]), shard, _planes(np.diff(code[a:z], prepend=_U(0))), _planes(n[a:z].astype(np.int32))) for a, z in zip(cuts, [*cuts[1:], len(code)])]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "shard", "codes", "counts"])


KEPT = "bucket long, shard long, kept binary, n_kept long"


def _repeated_codes(hot: int):
    """For one range of codes: which of each shard's codes stand in two documents (1) or are hot as well (2)."""

    def run(t: pa.Table) -> pa.Table:
        parts = [np.cumsum(_unplanes(x, np.uint64)) for x in t.column("codes").to_pylist()]
        counts = [_unplanes(x, np.int32).astype(np.int64) for x in t.column("counts").to_pylist()]
        code, n = np.concatenate(parts), np.concatenate(counts)
        order = np.argsort(code, kind="stable")
        sorted_, n_ = code[order], n[order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        shards = np.diff(np.append(first, len(code)))
        twice = (shards > 1) | (n_[first] > 0)  # two shards, or two documents in one
        places = np.add.reduceat(np.abs(n_), first)
        mark = np.empty(len(code), np.uint8)
        mark[order] = np.repeat(np.where(twice, np.where(places > hot, 2, 1), 0).astype(np.uint8), shards)
        at, rows = 0, []
        for bucket, shard, p, c in zip(t.column("bucket").to_pylist(), t.column("shard").to_pylist(), parts, counts):
            m = mark[at : at + len(p)]
            at += len(p)
            rows.append((bucket, shard, _zip(m.tobytes()), int(np.abs(c)[m == 1].sum())))
        return pa.table({k: pa.array([r[i] for r in rows], ty) for i, (k, ty) in enumerate((("bucket", pa.int64()), ("shard", pa.int64()), ("kept", pa.binary()), ("n_kept", pa.int64())))})

    return run


def _marked(s: Samples, kept: list) -> np.ndarray:
    """0, 1 or 2 for each sample of a shard."""
    code, _ = _distinct(s)
    mark = np.frombuffer(b"".join(_unzip(k["kept"]) for k in sorted(kept, key=lambda k: k["bucket"])), np.uint8)
    return mark[np.searchsorted(code, s.code)] if len(code) else np.array([], np.uint8)


class Records:
    """What a shard sends for its kept samples: records of cold ones, and distinct windows of hot ones."""

    def __init__(self, buf, ends, ids, kept, length: int, bits: int, ranges: int):
        s = Samples(buf, ends, length, bits)
        mark = _marked(s, kept)
        self.length, self.buf, self.w = length, buf, s.w
        cold = np.flatnonzero(mark == 1)
        place = _range_of(s.code[cold], bits, ranges)
        order = np.argsort(place, kind="stable")
        self.place, cold = place[order], cold[order]
        self.at, self.lo, self.hi, self.doc = s.at[cold], s.lo[cold], s.hi[cold], s.doc[cold]
        self.id = ids[self.doc]
        hot = np.flatnonzero(mark == 2)
        n = s.hi[hot] - s.lo[hot] + 1
        starts = np.repeat(s.lo[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.repeat(s.doc[hot], n)
        h = np.empty((2, len(starts)), _U)
        for a in range(0, len(starts), 1 << 14):
            rows = buf[starts[a : a + (1 << 14), None] + np.arange(length)].astype(_U)
            for j, mul in enumerate(_MULS):
                powers = np.array([pow(mul, i + 1, 1 << 64) for i in range(length)], _U)
                h[j, a : a + (1 << 14)] = _mixed((rows + _U(1)) @ powers)
        id_ = ids[doc]
        order = np.lexsort((id_, h[1], h[0]))
        self.starts, self.window_id, h = starts[order], id_[order], h[:, order]
        fresh = np.append(True, (h[:, 1:] != h[:, :-1]).any(0)) if len(starts) else np.array([], bool)
        self.window_class = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        self.h, self.least = h[:, first], self.window_id[first]
        self.window_place = _range_of(self.h[0], 64, ranges)

    def rows(self, shard: int):
        """(kind, bucket, shard, payload parts)."""
        for a, z in _runs(self.place):
            lens = self.hi[a:z] - self.lo[a:z] + self.length
            index = np.repeat(self.lo[a:z] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            yield 0, int(self.place[a]), shard, _planes(self.id[a:z]), _planes((self.at - self.lo)[a:z].astype(np.uint8)), _planes(lens.astype(np.uint16)), _zip(self.buf[index].tobytes())
        for a, z in _runs(self.window_place):
            yield 1, int(self.window_place[a]), shard, _planes(self.least[a:z]), _planes(np.diff(self.h[0, a:z], prepend=_U(0))), _planes(self.h[1, a:z]), b""


def _runs(place: np.ndarray) -> list[tuple[int, int]]:
    if not len(place):
        return []
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist()
    return list(zip(cuts, [*cuts[1:], len(place)]))


ROWS = "kind int, bucket long, shard long, ids binary, a binary, b binary, text binary"
MASKS = "kind int, bucket long, shard long, mask binary"


def induced_masks(text: np.ndarray, lefts: np.ndarray, lens: np.ndarray, ids: np.ndarray, length: int, w: int) -> np.ndarray:
    """For each sampled suffix a bit mask: bit o is set if the window that starts o bytes before it also starts in a
    document with a smaller id. Record r holds lens[r] bytes of text, its sample stands at lefts[r] in them."""
    n = len(ids)
    begin = np.cumsum(lens) - lens
    at, stop = begin + lefts, begin + lens
    right = np.zeros((n, -(-length // 8) * 8), np.uint8)
    top = max(len(text) - 1, 0)
    for j in range(length):
        right[:, j] = np.where(at + j < stop, text[np.minimum(at + j, top)], 0)
    keys = right.view(">u8").astype(_U)
    order = np.lexsort(keys.T[::-1])
    # common prefixes of neighbours, up to length
    same = right[order[1:]] == right[order[:-1]]
    lcp = np.append(0, np.where(same[:, :length].all(1), length, same.argmin(1)))
    first_order, left_class, masks = order, np.zeros(n, np.int64), np.zeros(n, np.uint32)
    last = lens - length  # the last window's place in a record
    right_class = np.empty(n, np.int64)
    big = np.iinfo(np.int64).max
    for o in range(w):
        if o:  # induce: suffixes one byte further left, by that byte and the order so far
            byte = text[np.maximum(at - o, 0)]
            order = order[np.argsort(byte[order], kind="stable")]
            b, c = byte[order], left_class[order]
            fresh = np.append(True, (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
            left_class[order] = np.cumsum(fresh)
        right_class[first_order] = np.cumsum(lcp < length - o)
        valid = (lefts - o >= 0) & (lefts - o <= last)
        lc, rc = left_class[order], right_class[order]
        starts = np.flatnonzero(np.append(True, (lc[1:] != lc[:-1]) | (rc[1:] != rc[:-1])))
        own = np.where(valid, ids, big)[order]
        least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, n)))
        masks[order] |= ((own > least) & valid[order]).astype(np.uint32) << np.uint32(o)
    return masks


def _decide(length: int, w: int):
    """One range of records or of hot windows -> the masks of each shard's rows in it."""

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        ids = [_unplanes(x, np.int64) for x in t.column("ids").to_pylist()]
        all_ids = np.concatenate(ids)
        if kind == 0:
            lefts = np.concatenate([_unplanes(x, np.uint8) for x in t.column("a").to_pylist()]).astype(np.int64)
            lens = np.concatenate([_unplanes(x, np.uint16) for x in t.column("b").to_pylist()]).astype(np.int64)
            text = np.frombuffer(b"".join(_unzip(x) for x in t.column("text").to_pylist()), np.uint8)
            mask = induced_masks(text, lefts, lens, all_ids, length, w)
        else:
            hi = np.concatenate([np.cumsum(_unplanes(x, np.uint64)) for x in t.column("a").to_pylist()])
            lo = np.concatenate([_unplanes(x, np.uint64) for x in t.column("b").to_pylist()])
            order = np.lexsort((lo, hi))
            starts = np.flatnonzero(np.append(True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])))
            least = np.repeat(np.minimum.reduceat(all_ids[order], starts), np.diff(np.append(starts, len(hi))))
            mask = np.empty(len(hi), np.uint32)
            mask[order] = all_ids[order] > least
        cuts = np.cumsum([len(x) for x in ids])[:-1]
        return pa.table({"kind": pa.array([kind] * len(ids), pa.int32()), "bucket": t.column("bucket"), "shard": t.column("shard"), "mask": pa.array([_planes(m) for m in np.split(mask, cuts)], pa.binary())})

    return run


def _by_shard(df: DataFrame, *cols: str, name: str) -> DataFrame:
    return df.groupBy("shard").agg(F.collect_list(F.struct(*cols)).alias(name))


def dedup(df: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, bucket_rows: int = BUCKET_ROWS, hot: int = HOT, keep: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if keep, kept (binary: the bytes that stay)."""
    table_name, size = _shards(df, shard_bytes)
    spark = df.sparkSession
    table = spark.table(table_name)
    w = min(32, length // 2)
    bits = min(63, max(40, size.bit_length() + 10))
    ranges = max(spark.sparkContext.defaultParallelism * 2, size // 13 // CODE_ROWS)
    codes = _codes(table, length, bits, ranges)
    kept = cut(codes.groupBy("bucket").applyInArrow(_repeated_codes(hot), KEPT))
    n_kept = kept.agg(F.sum("n_kept")).first()[0] or 0
    places = max(spark.sparkContext.defaultParallelism * 2, n_kept // bucket_rows)
    kept = _by_shard(kept, "bucket", "kept", name="kept")
    shards = table.select("shard", "ids", "ends", "text").join(kept, "shard")

    def send(it):
        names = [x.split()[0] for x in ROWS.split(", ")]
        types = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        for b in it:
            for i in range(b.num_rows):
                shard, ids, ends, buf = _load(b, i)
                rows = list(Records(buf, ends, ids, b.column(4)[i].as_py(), length, bits, places).rows(shard))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    sent = shards.mapInArrow(send, ROWS)
    masks = cut(sent.groupBy("kind", "bucket").applyInArrow(_decide(length, w), MASKS))
    masks = _by_shard(masks, "kind", "bucket", "mask", name="masks")
    joined = table.select("shard", "ids", "ends", "text").join(kept, "shard", "left").join(masks, "shard", "left")

    def finish(it):
        for b in it:
            for i in range(b.num_rows):
                _, ids, ends, buf = _load(b, i)
                gone = _gone(buf, ends, ids, b.column(4)[i].as_py() or [], b.column(5)[i].as_py() or [], length, bits, places)
                yield _digest(ids, ends, buf, gone)

    out = joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = cut(out if keep else out.drop("kept"))
    spark.sql(f"DROP TABLE {table_name}")  # the catalogue's entry alone: the files lie in the shared folder
    return out


def _gone(buf, ends, ids, kept, masks, length: int, bits: int, ranges: int) -> np.ndarray:
    """Which bytes of a shard go."""
    cover = np.zeros(len(buf) + 1, np.int64)
    if kept:
        r = Records(buf, ends, ids, kept, length, bits, ranges)
        by = {k: [m for m in sorted(masks, key=lambda m: m["bucket"]) if m["kind"] == k] for k in (0, 1)}
        cold, windows = (np.concatenate([_unplanes(m["mask"], np.uint32) for m in by[k]] or [np.array([], np.uint32)]) for k in (0, 1))
        for o in range(r.w):
            starts = (r.at - o)[(cold >> np.uint32(o) & np.uint32(1)).astype(bool)]
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + length, -1)
        if len(r.starts):
            c = r.window_class
            starts = r.starts[(r.window_id > r.least[c]) | windows[c].astype(bool)]
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + length, -1)
    return np.cumsum(cover[:-1]) > 0


def _digest(ids, ends, buf, gone) -> pa.RecordBatch:
    rows, begin = [], 0
    for d, end in zip(ids.tolist(), ends.tolist()):
        g = gone[begin:end]
        left = buf[begin:end][~g].tobytes()
        spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0])
        rows.append((None if d == NULL_ID else d, end - begin, int(g.sum()), spans, hashlib.sha256(left).hexdigest(), left))
        begin = end
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup_digest(df: DataFrame, **kw) -> DataFrame:
    """The figures of dedup() without the bytes."""
    return dedup(df, keep=False, **kw)
