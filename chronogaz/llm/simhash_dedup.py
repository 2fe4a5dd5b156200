"""SimHash near-duplicates: fingerprints, BK-tree search within a radius, and connected components.

Fingerprint: a text's words (runs of anything but ASCII white space, A-Z lower-cased) in shingles of n consecutive
words, repeats included; a bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42).

Links: fingerprints that differ in at most r bits agree on one of r + 1 blocks of their bits, so the distinct
fingerprints are dealt out by (block, its value) and each such shard is a BK-tree: children are keyed by their Hamming
distance to the parent, and a search follows only edges within the radius of its own distance. A shard that holds too
many fingerprints is dealt out again by r + 1 blocks of the bits that it does not yet share, so that no task ever holds
more than about one shard; nothing is capped. Trees go to the tasks by this shuffle; the trees of all fingerprints have
no size bound and are not broadcast.

Components: links between distinct fingerprints, then rounds of large-star and small-star joins until nothing changes;
a fingerprint without links is its own component. Members of one fingerprint, thousands or more, are one class and are
never expanded into pairs.

Null, empty and white-space texts have fingerprint zero and are linked like any other. Repeated rows and doc_ids give
one row each; a null doc_id is a member, but never the smallest unless its class has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogaz.llm.common import LOWER_ASCII, by_class, cut, text_bytes

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in one tree; a larger shard is dealt out again.
TREE = 4_000


def fingerprint_of(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text's bytes."""
    import xxhash

    ws = data.translate(LOWER_ASCII).split()
    if not ws:
        return 0
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(ws), SEED)
    text = b" ".join(ws)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(ws) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        set_bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long: the 64 bits as a signed number)."""

    def run(it):
        for b in it:
            fps = np.array([fingerprint_of(x, shingle) for x in text_bytes(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Distinct 64-bit fingerprints; each level's nodes are split by their distance to the subtree's root.

    Built and searched level by level over arrays: a level holds, for each open subtree, the run of members that fall
    into it, and the first member of a run is its root.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (i < j by place in fps) within the radius: every fingerprint is searched for in the tree."""
        fps = self.fps
        members = np.arange(len(fps))  # of the open subtrees, subtree by subtree
        starts = np.array([0]) if len(fps) else np.array([], np.int64)
        searches, at = np.arange(len(fps)), np.zeros(len(fps), np.int64)  # a search stands at a subtree
        left, right = [], []
        while len(starts):
            roots = members[starts]
            ends = np.append(starts[1:], len(members))
            dist = np.bitwise_count(fps[searches] ^ fps[roots[at]]).astype(np.int64)
            hit = (dist <= radius) & (searches < roots[at])
            left.append(searches[hit])
            right.append(roots[at][hit])
            # children: the run's other members, keyed by their distance to the root
            run = np.repeat(np.arange(len(starts)), ends - starts)
            keep = np.ones(len(members), bool)
            keep[starts] = False
            rest, run = members[keep], run[keep]
            edge = np.bitwise_count(fps[rest] ^ fps[roots[run]]).astype(np.int64)
            key = run * 65 + edge
            order = np.argsort(key, kind="stable")
            members, key = rest[order], key[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.array([], np.int64)
            keys = key[starts]
            # a search at distance d goes on along the edges d - radius .. d + radius
            go = (at * 65 + dist)[:, None] + np.arange(-radius, radius + 1)
            inside = (dist[:, None] + np.arange(-radius, radius + 1) >= 0) & (dist[:, None] + np.arange(-radius, radius + 1) <= 64)
            place = np.searchsorted(keys, go)
            found = inside & (place < len(keys))
            found[found] = keys[place[found]] == go[found]
            searches, at = np.repeat(searches, found.sum(1)), place[found]
        return np.concatenate(left or [np.array([], np.int64)]), np.concatenate(right or [np.array([], np.int64)])


def blocks_of(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def _bits(fp, bits: list[int]):
    """The chosen bits of a long column; bits are consecutive in runs."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(fp) distinct -> (a, b): each pair of different fingerprints within the radius, once, a < b."""

    def found(it):
        for b in it:
            a, z = [], []
            for lst in b.column(0):
                fps = np.array(lst.values.to_numpy(), np.int64)
                fps.sort()
                i, j = BKTree(fps.view(np.uint64)).links(radius)
                a.append(fps[i])
                z.append(fps[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [np.array([], np.int64)])), pa.array(np.concatenate(z or [np.array([], np.int64)]))], ["a", "b"])

    out, rows = None, distinct.select("fp", F.lit("").alias("path"), F.lit("").alias("shard"))
    frees = {"": list(range(64))}  # path (the blocks shared so far) -> bits that its shards do not share yet
    while frees:
        arms, free = [], {}
        for path, bits in frees.items():
            if len(bits) <= radius:  # equal but for so few bits: one tree holds 2 ** radius of them at most
                continue
            for k, block in enumerate(blocks_of(bits, radius + 1)):
                free[f"{path}{k}"] = [b for b in bits if b not in block]
                shard = F.concat("shard", F.lit(f"/{k}:"), _bits(F.col("fp"), block).cast("string"))
                arms.append(F.when(F.col("path") == path, F.struct(F.lit(f"{path}{k}").alias("path"), shard.alias("shard"))))
        dealt = rows.select("fp", F.explode(F.filter(F.array(*arms), lambda x: x.isNotNull())).alias("s")).select("fp", "s.path", "s.shard")
        sizes = dealt.groupBy("path", "shard").agg(F.count("*").alias("n"))
        fits = (F.col("n") > 1) & (F.col("n") <= tree)
        lists = dealt.join(sizes.where(fits), ["path", "shard"]).groupBy("shard").agg(F.collect_list("fp").alias("fps")).select("fps")
        part = lists.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(found, "a long, b long")
        out = part if out is None else out.unionByName(part)
        large = cut(sizes.where(F.col("n") > tree).select("path", "shard"))
        frees = {r.path: free[r.path] for r in large.select("path").distinct().collect()}
        if frees:
            rows = cut(dealt.join(large, ["path", "shard"]).select("fp", "path", "shard"))
    return out.distinct()


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: every node but the smallest of a component, with that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): every node but the smallest of each component, with the smallest.

    Each task contracts its own edges to stars; rounds of large-star and small-star joins bring the stars of different
    tasks together, until every node stands under one root and no root under another."""

    def stars(it):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in it]
        a, b = (np.concatenate([g[k] for g in got] or [np.array([], np.int64)]) for k in (0, 1))
        a, b = contracted(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def down(df: DataFrame) -> DataFrame:
        return cut(df.mapInArrow(stars, "a long, b long"))

    both = down(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        ends = both.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(both.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up = 1 and root = 1").isEmpty():
            return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        near = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and the node itself, is linked to the smallest
        low = large.where("a <> b").distinct()
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        star = low.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        both = down(star)


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id, n_links (of its fingerprint to others)."""
    fps = cut(fingerprints(df, shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges = cut(links(classes.select("fp"), radius))
    roots = components(edges)
    ends = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    linked = classes.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), F.col("fp") == F.col("node"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id").join(ends, "fp")
    labels = classes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return by_class(fps, cut(labels), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each group stays, with all its columns: the one with the smallest doc_id (of rows that share it
    and their text, one). Rows without a doc_id stay, one of equal texts: nothing can name them as a group's keeper."""
    groups = near_duplicates(docs, shingle, radius).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])  # one shuffle, by doc_id
    return named.select(docs.columns).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
