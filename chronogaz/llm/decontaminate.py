"""Benchmark decontamination by word suffix arrays of the training shards.

Each task takes a shard of training texts (a batch of rows of bounded bytes), turns it into a stream of word codes with
a break after every text, and sorts its suffixes by their first `window` words; suffixes whose first words start no
test suffix are left out of the array beforehand, as no search can end at them. Every distinct test suffix of window
length is binary-searched in the array word by word, each word narrowing the range; the suffixes in the range left
are its occurrences. From each, the sorted test suffixes are narrowed on, word by word, to the longest verbatim match,
which also gives the location. A document word inside any occurrence of a window is hit; documents with hits are the
affected ones.

Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. Windows: `window` consecutive words of an item; an item
of fewer words, but not none, is one window. Matches never cross texts. A null or empty text has no words, an item
without words no windows. Every row of documents gives its own row, whatever its doc_id and however many blocks the test
data take; repeated items count as one if they share their item_id, null item_ids are named as an empty string. Extra
columns of any name do no harm. One text must fit a task's memory some thirty times.

Test suffixes are broadcast in blocks of at most `block_bytes` of item text (and one item at least); more test data
means more blocks, whose hits are united row by row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogaz.llm.common import WORD_TABLE, batches, cut, give_back, suffix_array, text_bytes

WINDOW = 10
#: Bytes of item text in a broadcast block, and of training text in a shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 2 << 20
#: Words by which suffixes are first looked up.
KEY = 4

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.frombuffer(WORD_TABLE, np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        m = min(have, n - have)
        out[have : have + m] = out[:m] * step
        have += m
    return out[:n]


class Powers:
    """Powers of the hash's base and of its inverse, kept by a task."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up[:n], self.down[:n]


def word_codes(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit codes of the words of data (equal words, equal codes), their first bytes and their ends."""
    raw = _TABLE[np.frombuffer(data, np.uint8)]
    is_word = np.empty(len(raw) + 2, np.int8)
    is_word[0] = is_word[-1] = 0
    np.not_equal(raw, 32, out=is_word[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(is_word))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    code = (total[ends] - total[starts]) * down[starts]
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(29)
    return code, starts, ends


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of the words that stand side by side in the columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = out * np.uint64(_BASE) + c
    return out ^ (out >> np.uint64(32))


def bisect(values, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """np.searchsorted in a range of its own for each searched value: values(places) is sorted in each range."""
    lo, hi = lo.copy(), hi.copy()
    while len(at := np.flatnonzero(lo < hi)):
        mid = (lo[at] + hi[at]) >> 1
        got = values(mid)
        up = got <= want[at] if right else got < want[at]
        lo[at] = np.where(up, mid + 1, lo[at])
        hi[at] = np.where(up, hi[at], mid)
    return lo


def narrowed(values, lo, hi, want) -> tuple[np.ndarray, np.ndarray]:
    return bisect(values, lo, hi, want, False), bisect(values, lo, hi, want, True)


class Tests:
    """The test suffixes of a block of items (item_id, text), sorted once; items by their names' rank in `names`."""

    def __init__(self, rows: list[tuple[str | None, bytes]], window: int):
        powers = Powers()
        self.window, self.names = window, sorted({item or "" for item, _ in rows})
        rank = {x: i for i, x in enumerate(self.names)}
        long, shorts = [], {}
        for item, data in rows:
            code = word_codes(data, powers)[0] | np.uint64(1)
            if len(code) >= window:
                long.append((rank[item or ""], code))
            elif len(code):
                shorts.setdefault(len(code), []).append((rank[item or ""], code))
        # words, odd, with a break, zero, after each item and `window` of them at the end
        self.stream = np.concatenate([np.append(c, np.uint64(0)) for _, c in long] + [np.zeros(window, np.uint64)])
        lens = np.array([len(c) for _, c in long], np.int64)
        item = np.append(np.repeat([r for r, _ in long], lens + 1), np.zeros(window)).astype(np.int64)
        left = np.append(np.repeat(np.cumsum(lens + 1) - 1, lens + 1) - np.arange(int((lens + 1).sum())), np.zeros(window, np.int64))
        order = suffix_array(self.stream, int(lens.max(initial=1)))
        self.order = order[left[order] >= window]
        self.item = item[self.order]
        heads = self.stream[self.order[:, None] + np.arange(window)]
        fresh = np.ones(len(heads), bool)
        fresh[1:] = (heads[1:] != heads[:-1]).any(1)
        first = np.flatnonzero(fresh)
        #: distinct windows, and the range of suffixes that open with each
        self.windows, self.lo, self.hi = heads[first], first, np.append(first[1:], len(heads))
        self.depth = min(KEY, window)
        self.keys = keys_of([self.windows[:, k] for k in range(self.depth)])
        self.sorted = np.unique(self.keys)
        #: whole items of fewer words: length -> (items, words)
        self.shorts = {n: (np.array([r for r, _ in rs], np.int64), np.array([c for _, c in rs], np.uint64)) for n, rs in shorts.items()}
        self.bits = int(np.clip(int(len(self.sorted)).bit_length() + 6, 10, 24))
        self.likely = np.zeros(1 << self.bits, bool)  # no key is missed; the sorted keys decide
        self.likely[self.sorted >> np.uint64(64 - self.bits)] = True


class Suffixes:
    """The word suffix array of one shard, of the suffixes that open as some test suffix does."""

    def __init__(self, texts: list[bytes], powers: Powers, tests: Tests):
        code, starts, _ = word_codes(b"\n".join(texts), powers)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text_of = np.searchsorted(bounds, starts, side="right") - 1
        self.counts = np.bincount(text_of, minlength=len(texts))[: len(texts)]
        first = np.cumsum(np.append(0, self.counts))[:-1]
        # words, odd, with a break, zero, after each text and `window` of them at the end
        self.stream = np.zeros(len(code) + len(texts) + tests.window, np.uint64)
        self.stream[np.arange(len(code)) + text_of] = code | np.uint64(1)
        self.begin = first + np.arange(len(texts))  # of each text in the stream
        self.tests = tests

    def array(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in the order of their first `window` words, and the keys that they open with."""
        t = self.tests
        n = len(self.stream) - t.window
        keys = keys_of([self.stream[k : k + n] for k in range(t.depth)])
        at = np.flatnonzero(t.likely[keys >> np.uint64(64 - t.bits)])
        found = np.searchsorted(t.sorted, keys[at])
        at = at[t.sorted[np.minimum(found, len(t.sorted) - 1)] == keys[at]] if len(t.sorted) else at[:0]
        return at[np.lexsort([self.stream[at + k] for k in reversed(range(t.window))])], np.unique(keys[at])

    def find(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every occurrence: place in the stream, words, first and last + 1 of its test suffixes, or -1 and the item."""
        t = self.tests
        order, keys = self.array()
        which = np.flatnonzero(np.isin(t.keys, keys))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
        for k in range(t.window):
            lo, hi = narrowed(lambda i, k=k: self.stream[order[i] + k], lo, hi, t.windows[which, k])
            there = lo < hi
            which, lo, hi = which[there], lo[there], hi[there]
        n = hi - lo
        at = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        out = [(at, np.full(len(at), t.window), np.repeat(t.lo[which], n), np.repeat(t.hi[which], n))]
        for size, (items, codes) in t.shorts.items():
            at = np.flatnonzero(np.isin(self.stream[: len(self.stream) - t.window], codes[:, 0]))
            key, want = keys_of([self.stream[at + k] for k in range(size)]), keys_of([codes[:, k] for k in range(size)])
            by = np.argsort(want, kind="stable")
            a, z = np.searchsorted(want[by], key, "left"), np.searchsorted(want[by], key, "right")
            places = np.repeat(at, z - a)
            tests = by[np.repeat(a, z - a) + np.arange((z - a).sum()) - np.repeat(np.cumsum(z - a) - (z - a), z - a)]
            same = np.ones(len(places), bool)
            for k in range(size):
                same &= self.stream[places + k] == codes[tests, k]
            out.append((places[same], np.full(same.sum(), size), np.full(same.sum(), -1), items[tests[same]]))
        return tuple(np.concatenate([x[k] for x in out]) for k in range(4))

    def longest(self, at, n, lo, hi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of the longest verbatim match at each occurrence, and its test suffixes: narrowed word by word."""
        t = self.tests
        n, lo, hi = n.copy(), lo.copy(), hi.copy()
        live = np.flatnonzero(lo >= 0)
        while len(live):
            word = self.stream[at[live] + n[live]]
            live, word = live[word != 0], word[word != 0]
            values = lambda i, d: t.stream[np.minimum(t.order[i] + d, len(t.stream) - 1)]
            depth = n[live]
            a, z = _narrow_at(values, lo[live], hi[live], word, depth)
            on = a < z
            live = live[on]
            n[live] += 1
            lo[live], hi[live] = a[on], z[on]
        return n, lo, hi


def _narrow_at(values, lo, hi, want, depth):
    """narrowed() with a depth of its own for each searched value."""
    out = []
    for right in (False, True):
        a, z = lo.copy(), hi.copy()
        while len(at := np.flatnonzero(a < z)):
            mid = (a[at] + z[at]) >> 1
            got = values(mid, depth[at])
            up = got <= want[at] if right else got < want[at]
            a[at] = np.where(up, mid + 1, a[at])
            z[at] = np.where(up, z[at], mid)
        out.append(a)
    return out[0], out[1]


SPANS = "array<struct<start:long,end:long>>"
FOUND = f"n_words long, spans {SPANS}, items array<string>, longest_match long, longest_at long, longest_item string"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _lists(owner: np.ndarray, n: int, values: pa.Array, kind: pa.DataType) -> pa.Array:
    """One list for each of n owners from values sorted by owner."""
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values).cast(kind)


def hits(texts: list[bytes], powers: Powers, tests: Tests) -> list[pa.Array]:
    """The columns of FOUND for the texts of a shard."""
    arr = Suffixes(texts, powers, tests)
    at, n, lo, hi = arr.find()
    by = np.argsort(at, kind="stable")
    at, n, lo, hi = at[by], n[by], lo[by], hi[by]
    doc = np.searchsorted(arr.begin, at, side="right") - 1
    # spans: hits that overlap or touch; breaks keep those of two texts apart
    ends = np.maximum.accumulate(at + n) if len(at) else at
    first = np.flatnonzero(np.append(True, at[1:] > ends[:-1])) if len(at) else at
    last = np.append(first[1:], len(at)) - 1 if len(at) else at
    base = arr.begin[doc[first]]
    spans = pa.StructArray.from_arrays([pa.array(at[first] - base), pa.array(ends[last] - base)], ["start", "end"])
    # items: distinct ranges of test suffixes of a text first, then distinct items
    rows = np.unique(np.stack([doc, lo, hi]), axis=1)
    size = np.where(rows[1] < 0, 1, rows[2] - rows[1])
    own = np.repeat(rows[0], size)
    place = np.repeat(rows[1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    item = np.where(np.repeat(rows[1], size) < 0, np.repeat(rows[2], size), tests.item[np.maximum(place, 0)] if len(tests.item) else 0)
    own, item = np.unique(np.stack([own, item]), axis=1)
    names = pa.array(tests.names, pa.string()).take(pa.array(item.astype(np.int64)))
    # the longest match of each text, of equal ones the first, of equal places the item first by name
    full, lo, hi = arr.longest(at, n, lo, hi)
    by = np.lexsort((at, -full, doc))
    best = by[np.flatnonzero(np.append(True, doc[by][1:] != doc[by][:-1]))] if len(by) else by
    length, where, which = np.zeros(len(texts), np.int64), np.full(len(texts), -1), np.full(len(texts), -1)
    for i in best.tolist():
        d = doc[i]
        same = [j for j in range(*np.searchsorted(at, [at[i], at[i] + 1])) if full[j] == full[i]]
        length[d], where[d] = full[i], at[i] - arr.begin[d]
        which[d] = min(int(hi[j]) if lo[j] < 0 else int(tests.item[lo[j] : hi[j]].min()) for j in same)
    none = pa.array(where < 0)
    named = pa.array(tests.names or [""], pa.string()).take(pa.array(np.maximum(which, 0)))
    return [pa.array(arr.counts.astype(np.int64)), _lists(doc[first], len(texts), spans, _SPAN), _lists(own.astype(np.int64), len(texts), names, pa.list_(pa.string())), pa.array(length), pc.if_else(none, None, pa.array(where)), pc.if_else(none, None, named)]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of about block_bytes of text; the driver and each task hold one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def _tests(block: DataFrame, window: int):
    rows = [(r.item_id, bytes(r.text or b"")) for r in block.toLocalIterator()]
    return block.sparkSession.sparkContext.broadcast(Tests(rows, window))


def _search(rows: DataFrame, block: DataFrame, window: int, only_hits: bool) -> DataFrame:
    """(key ..., text) -> key ..., FOUND for one block of items."""
    given = _tests(block, window)

    def run(it):
        powers = Powers()
        for batch in (s for b in it for s in batches([b], SHARD_BYTES)):
            cols = hits(text_bytes(batch), powers, given.value)
            keys = batch.columns[:-1]
            if only_hits:
                some = pc.greater(cols[3], 0)
                cols, keys = [c.filter(some) for c in cols], [c.filter(some) for c in keys]
            yield pa.RecordBatch.from_arrays([*keys, *cols], [*batch.schema.names[:-1], *names])
        give_back()

    names = ("n_words", "spans", "items", "longest_match", "longest_at", "longest_item")
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, kept + FOUND)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, spans of hit words, items, longest_match (words), longest_at (word), longest_item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first, *more = _blocks(benchmark, block_bytes)
    if not more:
        return _search(rows, first, window, False)
    # Written once, so that a row keeps its number in every block's pass.
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    found = reduce(DataFrame.unionByName, [cut(_search(rows.select("row", "text"), b, window, True)) for b in more])
    found = _search(rows, first, window, False).unionByName(found.withColumn("doc_id", F.lit(None).cast("long")))
    ranked = found.withColumn("at", -F.col("longest_at"))
    united = ranked.groupBy("row").agg(  # a row has at most as many partial rows as there are blocks
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max(F.struct("longest_match", "at")).alias("best"),
        F.collect_list(F.struct("longest_match", "at", "longest_item")).alias("all"),
    )
    step = F.aggregate(
        F.array_sort("s"),
        F.expr(f"cast(array() as {SPANS})"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    item = F.array_min(F.transform(F.filter("all", lambda x: (x["longest_match"] == F.col("best.longest_match")) & (x["at"] == F.col("best.at"))), lambda x: x["longest_item"]))
    return united.select("doc_id", "n_words", step.alias("spans"), "items", F.col("best.longest_match").alias("longest_match"), (-F.col("best.at")).alias("longest_at"), item.alias("longest_item"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_at, longest_item."""
    m = matches(docs, benchmark, window, block_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = m.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "longest_match", "longest_at", "longest_item")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without a hit, with all their columns: rows pass through the search, and no text is shuffled."""
    for block in _blocks(benchmark, block_bytes):
        docs = _clean(docs, _tests(block, window))
    return docs


def _clean(docs: DataFrame, given) -> DataFrame:
    text = docs.columns.index("text")

    def run(it):
        powers = Powers()
        for batch in (s for b in it for s in batches([b], SHARD_BYTES)):
            texts = pa.RecordBatch.from_arrays([batch.column(text)], ["text"])
            arr = Suffixes(text_bytes(texts), powers, given.value)
            hit = np.zeros(batch.num_rows, bool)
            hit[np.searchsorted(arr.begin, arr.find()[0], side="right") - 1] = True
            yield batch.filter(pa.array(~hit))
        give_back()

    return docs.mapInArrow(run, docs.schema)
