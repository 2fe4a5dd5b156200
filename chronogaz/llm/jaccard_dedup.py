"""Near copies by word shingles: the form of operator 8 that the pipeline needs, exact Jaccard similarity and components.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is `least` or more. Words are
those of simhash_dedup (runs of anything but ASCII white space, A-Z lower-cased); a text of fewer words, but not none,
is one shingle, and texts without words are equal.

First come the groups of operator 8: SimHash fingerprints, BK-trees within its radius, components. Each such group is a
shard, whose texts are held against each other exactly. SimHash alone does not find all pairs: at a similarity of 0.8
fingerprints differ in 4 to 14 bits and share no usable block. Rounds of further shards find the rest.

Further shards: minima of hashed shingles, in `BANDS` fingerprints of `ROWS`; texts that share a fingerprint stand in one shard,
and a pair of similarity 0.8 shares none with a probability of 3e-6. Texts with the same set of shingles are one class.

In a shard the sets of shingles are counted against each other through their postings, and what leaves the task is a
spanning forest of the similar texts: never pairs, so rows grow with a group's size and not with its square. Texts of the
component that is largest so far are not counted against each other, as they are linked already; every other text is
counted against all, so no link between two components is left out. Bands come in rounds; a shard whose texts are one
component by then is dropped.

A shard of more than `SHARD` texts or `SHINGLES` shingles is dealt out in parts, with some of its texts as pivots in each
part; then the texts that are still outside its largest component visit every part.

Shingles are held as 48 bits of a hash. Rows: null and empty texts are equal; of rows with one doc_id and text one stays;
null doc_ids come last in the choice of the row that stays. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogaz.llm.common import LOWER_ASCII, batches, by_class, cut, give_back, text_bytes
from chronogaz.llm.simhash_dedup import SEED, components, fingerprint_of, links

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
#: Bands of each round: operator 8's groups, which stand as band -1, then minima; their first round finds most of the
#: other links with few copies of a text's shingles.
SIMHASH = -1
ROUNDS = ((SIMHASH, 0), (0, 2), (2, 8), (8, BANDS))
#: Texts and shingles in a shard, or in a part of a larger one; texts that stand in every part.
SHARD, SHINGLES, PIVOTS = 4_000, 1_000_000, 32

_U = np.uint64
_RANDOM = np.random.default_rng(SEED)
_MASK = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | _U(1)
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, _U(0xD1342543DE82EF95)
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.frombuffer(LOWER_ASCII, np.uint8)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), _U)
    have = 1
    while have < n:
        m = min(have, n - have)
        out[have : have + m] = out[:m] * _U(pow(base, have, 1 << 64))
        have += m
    return out[:n]


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of the texts, text by text in order, and how many each text has."""
    raw = _LOW[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[1:] = ~_WHITE[raw]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * _powers(_BASE, len(raw)), out=total[1:])
    code = _mixed((total[ends] - total[starts]) * _powers(_INVERSE, len(raw) + 1)[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(bounds, starts, side="right")
    words = np.bincount(text, minlength=len(texts))
    left = np.repeat(np.cumsum(words), words) - np.arange(len(code))  # words up to the text's end
    h = np.zeros(len(code), _U)
    for k in range(n):
        m = max(0, len(code) - k)
        h *= _STEP
        h[:m] += np.where(left[:m] > k, code[k:], _U(0))
    first = np.repeat(np.cumsum(words) - words, words) == np.arange(len(code))
    own = (left >= n) | first  # a text of fewer words is one shingle
    h, text = _mixed(h[own]), text[own]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[fresh], np.bincount(text[fresh], minlength=len(texts))


def sketch(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: a digest of its set of shingles, the set's size, and its band fingerprints."""
    h, size = shingle_sets(texts, n)
    some = np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[some]
    digest, bands = np.zeros(len(texts), _U), np.zeros((len(texts), BANDS), _U)
    if len(some):
        digest[some] = _mixed(np.add.reduceat(_mixed(h * _STEP), starts) + size[some].astype(_U))
        for b in range(BANDS):
            key = np.full(len(some), b + 1, _U)
            for k in range(b * ROWS, (b + 1) * ROWS):
                key = _mixed(key * _STEP + np.minimum.reduceat((h ^ _MASK[k]) * _ODD[k], starts))
            bands[some, b] = key
    return digest, size, bands


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, th (hash of the text), node (its class), size (shingles), the shards it goes to, and its SimHash."""

    def run(it):
        for b in (s for x in it for s in batches([x], 1 << 20)):
            texts = text_bytes(b)
            digest, size, bands = sketch(texts, shingle)
            fps = np.array([fingerprint_of(x) for x in texts], np.uint64)
            ends = np.arange(0, BANDS * (b.num_rows + 1), BANDS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest.view(np.int64)), pa.array(size), lists, pa.array(fps.view(np.int64))], ["doc_id", "th", "node", "size", "bands", "fp"])
        give_back()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, node long, size long, bands array<long>, fp long")


def simhash_shards(rows: DataFrame) -> DataFrame:
    """(node, size, fp) -> (node, size, band, key): the groups that operator 8 makes of fingerprints, as shards."""
    prints = cut(rows.where("size > 0").select("fp", "node", "size").distinct())
    near = cut(links(cut(prints.select("fp").distinct())))
    group = components(near).select(F.col("node").alias("fp"), "root")  # the smallest of a group names it and is not listed
    key = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp"))
    return prints.join(group, "fp", "left").select("node", "size", F.lit(SIMHASH).alias("band"), key.alias("key")).distinct()


def packed_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, text) -> (node, shingles: six bytes of each hash)."""

    def run(it):
        for b in (s for x in it for s in batches([x], 1 << 20)):
            h, size = shingle_sets(text_bytes(b), shingle)
            data = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])
            ends = np.append(0, np.cumsum(size * 6)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column(0), packed], ["node", "shingles"])
        give_back()

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def forest(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of similar texts that join different components of a shard: a spanning forest."""
    n, out = len(nodes), []
    comp = np.unique(roots, return_inverse=True)[1]
    if not comp.any():
        return out
    size = np.array(list(map(len, sets)), np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(nodes[0], nodes[1])] if both and both >= least * (size.sum() - both) else out
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    text, flat = np.repeat(np.arange(n), size)[order], flat[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    df = np.diff(np.append(first, len(flat)))
    shingle = np.empty(len(flat), np.int64)
    shingle[order] = np.repeat(np.arange(len(first)), df)
    ends, done = np.cumsum(size), np.zeros(n, bool)
    while True:
        left = np.flatnonzero(~done & (comp != np.bincount(comp).argmax()))
        if not len(left):
            return out
        x = left[0]
        done[x] = True
        s = shingle[ends[x] - size[x] : ends[x]]
        k = df[s]
        postings = np.repeat(first[s] - np.cumsum(k) + k, k) + np.arange(k.sum())
        both = np.bincount(text[postings], minlength=n)
        near = np.flatnonzero((both >= least * (size[x] + size - both)) & (comp != comp[x]))
        others, at = np.unique(comp[near], return_index=True)
        out += [(nodes[x], nodes[y]) for y in near[at]]
        comp[np.isin(comp, others)] = comp[x]


def connected(dealt: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(key, part, chunk, node, root) -> (a, b): forests of the shards; their rows stream through tasks in shard order."""

    def run(it):
        held: list = []  # rows of the shard that is not complete yet

        def links(parts):
            cols = [np.concatenate([p[k] for p in parts]) for k in (0, 1)]
            sets_ = [np.frombuffer(x, np.uint8).reshape(-1, 6) for p in parts for x in p[2]]
            wide = []
            for s in sets_:
                w = np.zeros((len(s), 8), np.uint8)
                w[:, :6] = s
                wide.append(w.view("<u8").ravel())
            _, once = np.unique(cols[0], return_index=True)  # a pivot or visitor may be a member too
            return forest(cols[0][once], cols[1][once], [wide[i] for i in once], least)

        def rows(pairs):
            a, z = ([p[k] for p in pairs] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

        last = None
        for b in (s for x in it for s in batches([x], 8 << 20, "shingles")):
            keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))).tolist()
            node, root, data = b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_pylist()
            pairs = []
            for i, z in zip(cuts, [*cuts[1:], len(keys)]):
                if held and tuple(keys[i]) != last:
                    pairs += links(held)
                    held = []
                last = tuple(keys[i])
                held.append((node[i:z], root[i:z], data[i:z]))
            yield rows(pairs)
        yield rows(links(held) if held else [])
        give_back()

    group = ("key", "part", "chunk")
    joined = dealt.join(sets, "node").select(*group, "node", "root", "shingles")
    return joined.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def _roots(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) of every node on an edge."""
    found = components(edges)
    return cut(found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct())


def _rooted(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The entries with each node's root; without one the node itself."""
    if roots is None:
        return entries.withColumn("root", F.col("node"))
    return entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _dealt(entries: DataFrame, size: int) -> DataFrame:
    """Shards of more than one component, in parts: (key, part, chunk, node, root, parts); pivots stand in every part."""
    shards = entries.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("total")).where("lo < hi")
    parts = F.greatest(F.ceil(F.col("n") / size), F.ceil(F.col("total") / SHINGLES)).cast("int")
    rows = entries.join(shards.select("key", "n", parts.alias("parts")), "key")
    place = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pivot = (F.col("parts") > 1) & (F.xxhash64("node", F.lit(1)) / 2.0**64 + 0.5 <= F.lit(float(PIVOTS)) / F.col("n"))
    where = F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(place))
    return rows.select("key", F.explode(where).alias("part"), F.lit(0).alias("chunk"), "node", "root", "size", "parts")


def _visits(entries: DataFrame, size: int) -> DataFrame:
    """In shards of several parts: the texts outside the largest component visit each part, in chunks of a part's size."""
    large = entries.select("key", "parts").where("parts > 1").distinct()
    rows = entries.join(large.select("key"), "key", "left_semi").select("key", "node", "root", "size", "parts").distinct()
    most = rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
    rows = rows.join(most, "key").withColumn("out", F.col("root") != F.col("largest"))
    n = rows.where("out").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum("size") / SHINGLES)).cast("int").alias("chunks"))
    rows = rows.join(n, "key")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    stay = rows.select("key", own("parts").alias("part"), F.explode(every("chunks")).alias("chunk"), "node", "root")
    visit = rows.where("out").select("key", F.explode(every("parts")).alias("part"), own("chunks").alias("chunk"), "node", "root")
    return stay.unionByName(visit)


def groups(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, size: int = SHARD) -> DataFrame:
    """(doc_id, text) -> doc_id, th, best_id, best_th: each row, and the row that stays of its group.

    That is the one with the smallest doc_id, of several the one whose text hashes lowest; null doc_ids come last."""
    rows = cut(sketches(docs, shingle))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best")
    classes = cut(rows.groupBy("node").agg(best, F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    banded = classes.where("size > 0").select("node", "size", F.posexplode("bands").alias("band", "key")).unionByName(simhash_shards(rows))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    entries = cut(banded.join(shared, "key"))
    named = entries.select("node").distinct().join(classes, "node").select("node", F.col("best.doc_id").alias("_id"), F.col("best.th").alias("_th"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    found = text.join(named, text["doc_id"].eqNullSafe(named["_id"]) & (text["th"] == named["_th"])).dropDuplicates(["node"])
    sets = cut(packed_sets(found, shingle), "lz4")
    edges = roots = None

    def more(dealt: DataFrame) -> None:
        nonlocal edges, roots
        new = cut(connected(dealt, sets, least))
        edges = new if edges is None else edges.unionByName(new)
        roots = _roots(edges)

    for lo, hi in ROUNDS:
        dealt = cut(_dealt(_rooted(entries.where(F.col("band").between(lo, hi - 1)), roots), size))
        more(dealt)
        if dealt.where("parts > 1").limit(1).count():
            more(_visits(_rooted(dealt.drop("root"), roots), size))
    linked = classes.select("node", "best").join(roots, "node")
    of_group = linked.join(linked.groupBy("root").agg(F.min("best").alias("group_best")), "root").select("node", "group_best")
    of_node = classes.select("node", "n", "best").join(of_group, "node", "left").select("node", "n", F.coalesce("group_best", "best").alias("best"))
    return by_class(rows.select("doc_id", "th", "node"), cut(of_node), "node").select("doc_id", "th", F.col("best.doc_id").alias("best_id"), F.col("best.th").alias("best_th"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, size: int = SHARD) -> DataFrame:
    """One row of each group of near copies stays, with all its columns."""
    best = groups(docs, shingle, least, size).select(F.col("best_id").alias("_id"), F.col("best_th").alias("_th")).distinct()
    kept = docs.join(best, docs["doc_id"].cast("long").eqNullSafe(best["_id"]) & (F.xxhash64(docs["text"].cast("string")) == best["_th"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
