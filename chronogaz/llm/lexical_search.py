"""Ranked lexical search by Block-Max MaxScore over a segmented index.

`build()` reads every document once and writes an inverted index to the shared folder: segments of a bounded size, a
row for each segment and term with its postings in compressed blocks (document steps and term counts in 1, 2 or 4
bytes) and, outside the blocks, each block's first and last document and its greatest impact. A row without a term
holds the segment's documents. Impacts need the corpus' size, which a first pass counts.

`search()` answers queries in blocks of a bounded size. For each block the terms' document counts come from the index;
then a task takes the lists of one segment and walks it by windows of documents in doc_id order. Lists whose bounds
(greatest impact of the list, weighed) cannot sum to more than the tenth best score so far are not essential: they
bring no candidates. For the candidates of the others, the non-essential lists are tried from the greatest bound down;
a candidate whose score so far, this list's block maximum and the bounds below cannot pass the tenth best score is
rejected before the block is decompressed. The best of each segment are merged by rank.

Null and empty texts have no terms and are never found; queries without terms give no rows. Rows with equal doc_ids,
or without one, are ranked each by itself (without one: last among equals); so are queries. Ties go by doc_id. Texts
are indexed whole, a text longer than a segment is a segment of its own. Extra columns are not read. An empty table of
documents or queries gives no rows.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from chronogaz.llm.common import WORD_TABLE, batches, cut, give_back, text_bytes, words

#: Bytes of text in a segment, postings in a block, results for each query, bytes of queries answered in one pass.
SEGMENT, BLOCK, BEST, QUERY_BYTES = 16 << 20, 128, 10, 8 << 20
#: Documents in the first window of a segment; each is twice the one before, up to the last number.
WINDOWS = (128, 2048)
#: Rows of the index in one batch.
_ROWS = 20_000
HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("top", "<u4"), ("at", "<u4"), ("count", "<u2"), ("step_bytes", "u1"), ("tf_bytes", "u1")])
_UINT = {1: np.dtype("<u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and all their terms."""

    def run(it):
        n = total = 0
        for b in batches(it, column=text):
            for data in text_bytes(b, text):
                inside = np.frombuffer(data.translate(WORD_TABLE), np.uint8) != 32
                starts = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])
                n, total = n + (starts > 0), total + starts
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})

    got = docs.select(text).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return got[0] or 0, got[1] or 0


class _Segment:
    """Postings of some documents, gathered one document at a time."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids, self.sizes, self.bytes = [], [], 0
        self.doc_of, self.term_of, self.tf = array("I"), array("I"), array("I")

    def add(self, doc_id, data: bytes) -> None:
        self.bytes += len(data)
        found = Counter(words(data))
        if not found:
            return
        known, fresh = self.terms, self.terms.setdefault
        self.term_of.extend([fresh(t, len(known)) for t in found])
        self.tf.extend(found.values())
        self.doc_of.extend([len(self.ids)] * len(found))
        self.ids.append(doc_id)
        self.sizes.append(found.total())

    def batches(self, name: int, n: int, total: int, block: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The documents' row, then a row for each term."""
        m = np.array([10 + (90 * size * n) // total for size in self.sizes], np.int64)
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        m = m[order]
        lists = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("df", pa.int32()), ("top", pa.int64()), ("heads", pa.binary()), ("data", pa.binary()), ("ids", pa.list_(id_type)), ("m", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pydict({"segment": [name], "term": [None], "df": [0], "top": [0], "heads": [b""], "data": [b""], "ids": [[self.ids[i] for i in order]], "m": [m]}, lists)
        heads, data, df, top, head_at, data_at = _blocks(rank[np.frombuffer(self.doc_of, np.uint32)], np.frombuffer(self.term_of, np.uint32), np.frombuffer(self.tf, np.uint32).astype(np.int64), m, block)
        whole = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(df), name)), pa.array(list(self.terms), pa.binary()), pa.array(df.astype(np.int32)), pa.array(top), _slices(heads, head_at), _slices(data, data_at), pa.nulls(len(df), lists.field("ids").type), pa.nulls(len(df), lists.field("m").type)],
            schema=lists,
        )
        for at in range(0, len(df), _ROWS):
            yield whole.slice(at, _ROWS)


def _slices(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _bytes_for(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4)).astype(np.uint8)


def _blocks(doc, term, tf, m, block):
    """Block heads and compressed blocks of all lists; for each list its df, greatest impact and where its parts start."""
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    df = np.diff(np.append(first, len(doc)))
    place = np.arange(len(doc)) - np.repeat(first, df)
    starts = np.flatnonzero(place % block == 0)
    counts = np.diff(np.append(starts, len(doc)))
    step = np.append(0, doc[1:] - doc[:-1])
    step[starts] = 0
    tops = np.maximum.reduceat(impact(tf, m[doc]), starts)
    step_bytes, tf_bytes = _bytes_for(np.maximum.reduceat(step, starts)), _bytes_for(np.maximum.reduceat(tf, starts))
    ends = np.cumsum(counts * (step_bytes.astype(np.int64) + tf_bytes))
    at = np.append(0, ends[:-1])
    data = np.zeros(int(ends[-1]), np.uint8)
    inside = np.arange(len(doc)) - np.repeat(starts, counts)
    for values, width, base in ((step, step_bytes, at), (tf, tf_bytes, at + counts * step_bytes.astype(np.int64))):
        of_each = np.repeat(width, counts)
        where = np.repeat(base, counts) + inside * of_each
        for byte in range(4):
            has = of_each > byte
            data[where[has] + byte] = values[has] >> 8 * byte & 255
    lists = np.flatnonzero(place[starts] == 0)  # the first block of each list
    data_at = np.append(at[lists], len(data))
    heads = np.empty(len(starts), HEAD)
    heads["first"], heads["last"], heads["top"], heads["count"] = doc[starts], doc[starts + counts - 1], tops, counts
    heads["at"] = at - np.repeat(at[lists], np.diff(np.append(lists, len(starts))))
    heads["step_bytes"], heads["tf_bytes"] = step_bytes, tf_bytes
    head_at = np.append(lists, len(starts)) * HEAD.itemsize
    return heads.view(np.uint8), data, df, np.maximum.reduceat(tops, lists), head_at, data_at


def build(docs: DataFrame, n: int, total: int, key: str = "doc_id", text: str = "text", segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """The index over all documents, written to the shared folder."""
    id_type = docs.schema[key].dataType
    arrow_type = pa.string() if isinstance(id_type, T.StringType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.int64()

    def run(it):
        part, made, open_ = TaskContext.get().partitionId() << 32, 0, _Segment()
        for b in batches(it, segment, text):
            ids = b.column(b.schema.get_field_index(key)).to_pylist()
            for doc_id, data in zip(ids, text_bytes(b, text)):
                if open_.ids and open_.bytes + len(data) > segment:
                    yield from open_.batches(part + made, n, total, block, arrow_type)
                    made, open_ = made + 1, _Segment()
                open_.add(doc_id, data)
        if open_.ids:
            yield from open_.batches(part + made, n, total, block, arrow_type)
        del open_
        give_back()

    schema = T.StructType().add("segment", "long").add("term", "binary").add("df", "integer").add("top", "long").add("heads", "binary").add("data", "binary").add("ids", T.ArrayType(id_type)).add("m", T.ArrayType(T.LongType()))
    return cut(docs.select(key, text).mapInArrow(run, schema))


class _List:
    """One term's list in one segment; decoded blocks stay while the segment is read."""

    __slots__ = ("blocks", "data", "heads", "last", "m", "read", "top", "tops")

    def __init__(self, heads: bytes, data: bytes, top: int, m: np.ndarray):
        self.heads, self.data, self.top, self.m, self.blocks = np.frombuffer(heads, HEAD), data, top, m, {}
        self.last, self.tops = self.heads["last"].astype(np.int64), self.heads["top"].astype(np.int64)
        self.read = 0

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their impacts."""
        got = self.blocks.get(b)
        if got is None:
            first, _, _, at, count, step_bytes, tf_bytes = self.heads[b].item()
            docs = first + np.cumsum(np.frombuffer(self.data, _UINT[step_bytes], count, at), dtype=np.int64)
            tf = np.frombuffer(self.data, _UINT[tf_bytes], count, at + count * step_bytes).astype(np.int64)
            got = self.blocks[b] = docs, impact(tf, self.m[docs])
            self.read += 1
        return got

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from a to b (not b) and their impacts."""
        one, two = np.searchsorted(self.last, (a, b - 1)).tolist()
        got = [self.block(i) for i in range(one, min(two + 1, len(self.last)))]
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, values = (got[0][0], got[0][1]) if len(got) == 1 else (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        lo, hi = np.searchsorted(docs, (a, b))
        return docs[lo:hi], values[lo:hi]


def best_of_segment(lists: list[tuple[int, _List]], n_docs: int, best: int = BEST, windows: tuple[int, int] = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """(weight, list) of a query's terms -> its best documents (places in the segment) and scores, best first."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0] * x[1].top)
    upto = np.append(0, np.cumsum([w * x.top for w, x in lists])).tolist()  # bounds of the lists before each
    top_docs, top_scores = np.empty(0, np.int64), np.empty(0, np.int64)
    least, a, size = 0, 0, windows[0]
    while a < n_docs:
        b = min(a + size, n_docs)
        essential = int(np.searchsorted(upto, least, side="right")) - 1  # lists before it sum to no more than least
        if essential >= len(lists):
            break  # no document can pass
        score = np.zeros(b - a, np.int64)
        for w, x in lists[essential:]:
            docs, values = x.between(a, b)
            score[docs - a] += w * values
        at = np.flatnonzero(score)
        score = score[at]
        for i in range(essential - 1, -1, -1):
            keep = score + upto[i + 1] > least
            at, score = at[keep], score[keep]
            if not len(at):
                break
            w, x = lists[i]
            of = np.searchsorted(x.last, at + a)
            in_list = of < len(x.last)
            most = np.where(in_list, w * x.tops[np.minimum(of, len(x.last) - 1)], 0)
            keep = score + most + upto[i] > least
            at, score, of = at[keep], score[keep], np.where(in_list, of, -1)[keep]
            for j in np.unique(of[of >= 0]).tolist():
                mine = np.flatnonzero(of == j)
                docs, values = x.block(j)
                place = np.minimum(np.searchsorted(docs, at[mine] + a), len(docs) - 1)
                score[mine] += np.where(docs[place] == at[mine] + a, w * values[place], 0)
        keep = score > least
        if keep.any():
            top_docs, top_scores = np.append(top_docs, at[keep] + a), np.append(top_scores, score[keep])
            order = np.lexsort((top_docs, -top_scores))[:best]
            top_docs, top_scores = top_docs[order], top_scores[order]
            least = int(top_scores[-1]) if len(order) == best else 0
        a, size = b, min(size * 2, windows[1])
    return top_docs, top_scores


def _query_blocks(items: DataFrame, key: str, text: str, size: int):
    """Lists of (item, distinct terms) of some `size` bytes."""
    got, held = [], 0
    for item, data in items.select(key, text).toLocalIterator():
        terms = sorted(set(words((data or "").encode())))
        got.append((item, terms))
        held += sum(map(len, terms)) + 64
        if held >= size:
            yield got
            got, held = [], 0
    if got:
        yield got


def _answers(spark: SparkSession, index: DataFrame, queries: list, n: int, best: int, item_type, id_type) -> DataFrame:
    """(query, item_id, doc_id, score): the best of each segment."""
    asked = {t for _, terms in queries for t in terms}
    terms = spark.createDataFrame([(t,) for t in [None, *sorted(asked)]], "asked binary")
    mine = index.join(F.broadcast(terms), F.col("term").eqNullSafe(F.col("asked")), "left_semi")  # at most QUERY_BYTES of terms
    counts = mine.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = {bytes(r["term"]): weight(n, r["df"]) for r in counts}
    plans = [(i, item, [(t, weights[t]) for t in terms if t in weights]) for i, (item, terms) in enumerate(queries)]
    schema = T.StructType().add("query", "integer").add("item_id", item_type).add("doc_id", id_type).add("score", "long")
    held = spark.sparkContext.broadcast(plans)

    def run(rows: pa.Table) -> pa.Table:
        about = rows.filter(pc.is_null(rows["term"])).to_pylist()[0]
        m = np.array(about["m"], np.int64)
        lists = {r["term"]: _List(r["heads"], r["data"], r["top"], m) for r in rows.select(["term", "heads", "data", "top"]).to_pylist() if r["term"] is not None}
        out = {"query": [], "item_id": [], "doc_id": [], "score": []}
        for i, item, terms in held.value:
            docs, scores = best_of_segment([(w, lists[t]) for t, w in terms if t in lists], len(m), best)
            out["query"] += [i] * len(docs)
            out["item_id"] += [item] * len(docs)
            out["doc_id"] += [about["ids"][d] for d in docs.tolist()]
            out["score"] += scores.tolist()
        types = (pa.int32(), _arrow(item_type), _arrow(id_type), pa.int64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    return mine.groupBy("segment").applyInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    return pa.string() if isinstance(t, T.StringType) else pa.int32() if isinstance(t, T.IntegerType) else pa.int64()


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", best: int = BEST, segment: int = SEGMENT, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each query."""
    spark = docs.sparkSession
    n, total = corpus_size(docs, text)
    item_type, id_type = items.schema[item].dataType, docs.schema[key].dataType
    out = spark.createDataFrame([], T.StructType().add("item_id", item_type).add("rank", "integer").add("doc_id", id_type).add("score", "long"))
    if not n:
        return out
    index = build(docs, n, total, key, text, segment, block)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for queries in _query_blocks(items, item, item_text, query_bytes):
        found = _answers(spark, index, queries, n, best, item_type, id_type)
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
