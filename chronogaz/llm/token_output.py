"""Token-ID output: Parquet list columns of token ids in document order, read back by column.

Format: rows (part, doc_id, n_tokens, tokens array<int>) in ascending doc_id order (nulls first; rows with the same
doc_id in the order of their texts' hashes, then their texts, so that one doc_id may take many files), one file for each range. Token lists are dictionary encoded, or with
encoding="delta" written by the version 2 writer as DELTA_BINARY_PACKED; row groups and pages have a set size and the
page index is written, so that counts, single documents and ranges are read without the token pages of others.

The start of a document in the whole stream is not stored: it is the prefix sum of n_tokens, which `starts` gets from
the narrow columns alone. A null text is empty: its tokens are the end id alone. Extra columns are not written.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronogaz.llm.common import batches, give_back, shared_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of a row group and of a page; bytes of text in a file; entries of a worker's table of known words; text in a batch;
#: words encoded as one text.
ROW_GROUP, PAGE, TEXT_IN_FILE, KNOWN, BATCH, JOINED = 8 << 20, 256 << 10, 32 << 20, 1_000_000, 4 << 20, 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """encode() of a byte-level BPE for columns of texts, with the ids of known words taken from a bounded table.

    A text in which no space touches other white space falls into pieces, one from each space to the next, whose ids
    do not depend on their surroundings: the pre-tokenizer starts a token at such a space and none goes past the next.
    A piece that ends in full stops or commas after a letter is a word and a tail, which the pre-tokenizer parts too.
    Every other text, and any text that holds an added token's string, goes through the tokenizer as a whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.end = self._binary(np.array([end_id], self.dtype), np.array([1]))
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())  # known words and their ids
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        space = "Ġ"  # fixed value: how a byte-level vocabulary writes the space
        self.opens = np.zeros(self.tok.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tok.get_vocab().items() if t.startswith(space)]] = True
        parted = self.tok.pre_tokenizer.pre_tokenize_str(" ab., a") if self.tok.pre_tokenizer else []
        self.tails = ".," if [t for t, _ in parted] == [space + "ab", ".,", space + "a"] else ""

    def _binary(self, flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Runs of flat as one binary value each."""
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32) * self.dtype().itemsize
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*rows, np.array([], self.dtype)]), np.array(list(map(len, rows)), np.int64)

    def _spaced(self, words: pa.Array) -> pa.Array:
        """The ids of words that hold no space, each with a space before it: some are encoded as one text, and the
        tokens that open with a space part it again. A word that ends in white space ends its text."""
        closed = np.flatnonzero(pc.not_equal(pc.utf8_rtrim_whitespace(words), words).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.concatenate([np.arange(0, len(words), JOINED), closed + 1, [len(words)]])).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ").to_pylist()
        flat, _ = self._encode([" " + t for t in texts])
        at = np.flatnonzero(self.opens[flat])
        if len(at) != len(words):  # a vocabulary that writes spaces in another way
            return self._binary(*self._encode([" " + w for w in words.to_pylist()]))
        return self._binary(flat, np.diff(np.append(at, len(flat))))

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, each with a space before it."""
        words, last = pieces, None
        if self.tails:
            last = pc.utf8_slice_codeunits(pieces, -1)
            parts = pc.and_(pc.is_in(last, value_set=pa.array(list(self.tails))), pc.utf8_is_alpha(pc.utf8_slice_codeunits(pieces, -2, -1)))
            words, last = pc.if_else(parts, pc.utf8_slice_codeunits(pieces, 0, -1), pieces), pc.if_else(parts, last, "").dictionary_encode()
        distinct = words.dictionary_encode()
        at = pc.index_in(distinct.dictionary, value_set=self.words)
        new = distinct.dictionary.filter(at.is_null())
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if len(new):
            place[place < 0] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.ids = pa.concat_arrays([self.ids, self._spaced(new)])
        own = self.ids.take(pa.array(place))
        if len(self.words) > KNOWN:  # the words of this batch stay
            self.words, self.ids = distinct.dictionary, own
        out = own.take(distinct.indices)
        if last is not None and len(last.dictionary) > 1:
            ends = self._binary(*self._encode(last.dictionary.to_pylist()))
            out = pc.binary_join_element_wise(out, ends.take(last.indices), b"")
        return out

    @staticmethod
    def _parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces between spaces, the piece at each place, and the places where a text begins."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        pieces = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        return pieces.dictionary, pieces.indices.to_numpy().copy(), offsets[:-1] - offsets[0]

    @staticmethod
    def _touching(pieces: pa.Array, index: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The texts in which a space touches other white space, or that begin or end with a space."""
        trimmed = pc.and_(pc.equal(pc.utf8_trim_whitespace(pieces), pieces), pc.greater(pc.binary_length(pieces), 0))
        open_or_closed = np.flatnonzero(~trimmed.to_numpy(zero_copy_only=False))
        if not len(open_or_closed):
            return np.array([], np.int64)
        opens, closes = np.zeros(len(pieces), bool), np.zeros(len(pieces), bool)
        for k in open_or_closed.tolist():
            p = pieces[k].as_py()
            opens[k], closes[k] = not p or p[0].isspace(), not p or p[-1].isspace()
        first, last = np.zeros(len(index), bool), np.zeros(len(index), bool)
        first[firsts] = last[np.append(firsts[1:], len(index)) - 1] = True
        return np.flatnonzero(np.add.reduceat((opens[index] & ~first) | (closes[index] & ~last), firsts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and how many each text has. A null text is empty."""
        n, texts = len(texts), pc.fill_null(texts, "")
        if not n:
            return np.array([], np.int32), np.array([], np.int64)
        alone = np.zeros(n, bool)
        for a in self.added:
            alone |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        pieces, index, firsts = self._parted(pc.if_else(pa.array(alone), "", texts) if alone.any() else texts)
        touching = self._touching(pieces, index, firsts)
        if len(touching):
            alone[touching] = True
            pieces, index, firsts = self._parted(pc.if_else(pa.array(alone), "", texts))
        heads = pc.if_else(pa.array(alone), texts, pieces.take(pa.array(index[firsts])))
        index[firsts] = -1  # a text's first piece has no space before it
        held = np.zeros(len(pieces) + 1, bool)
        held[index] = True
        used = np.flatnonzero(held[:-1])
        spaced = self._ids(pieces.take(pa.array(used)))
        ids = pa.concat_arrays([spaced, self._binary(*self._encode(heads.to_pylist())), self.end])
        place = np.full(len(pieces), -1, np.int64)
        place[used] = np.arange(len(used))
        index = place[index]
        index[firsts] = len(used) + np.arange(n)
        index = np.insert(index, np.append(firsts[1:], len(index)), len(ids) - 1)
        got = ids.take(pa.array(index))
        offsets = np.frombuffer(got.buffers()[1], np.int32)[: len(got) + 1] // self.dtype().itemsize
        out = np.frombuffer(got.buffers()[2], self.dtype)[: offsets[-1]].astype(np.int32)
        return out, np.diff(offsets[np.append(firsts + np.arange(n), len(index))]).astype(np.int64)


@functools.lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> PieceEncoder:
    """One encoder for each Python worker: its bounded table of known pieces serves the worker's later tasks too."""
    return PieceEncoder(path, end_id)


def encode(df: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, tokens), each list closed by the end id."""

    def run(it):
        enc, batch = encoder(path, end_id), None
        for batch in (b for x in it for b in batches([x], BATCH)):
            ids, counts = enc.encode(batch.column(1))
            ends = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "n_tokens", "tokens"])
        del enc, batch  # the worker lives on: give the batches' memory back
        give_back()

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>")


def write_tokens(df: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", text_in_file: int = TEXT_IN_FILE) -> str:
    """Writes the tokens of (doc_id, text) to the folder out, in ascending doc_id order over its files."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // text_in_file), df.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order, "text")
    writer = encode(ordered, path or tokenizer_path(), end_id).select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "tokens").write
    options = {"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.write-checksum.enabled": "true"}
    if encoding == "delta":
        options |= {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"}
    writer.options(**options).parquet(out)
    return out


def read_tokens(spark: SparkSession, out: str, columns: tuple[str, ...] = ("part", "doc_id", "n_tokens", "tokens"), doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """Chosen columns, of a range of doc_ids if given: row groups and pages outside it are skipped by their statistics."""
    df = spark.read.schema("part int, doc_id long, n_tokens long, tokens array<int>").parquet(out)
    return (df.where(F.col("doc_id").between(*doc_ids)) if doc_ids else df).select(*columns)


def starts(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Adds start, the ids before each document, to rows (part, row, n_tokens): sums for each file, a running sum over the
    files (a row each), then one inside each file in the order of its rows.

    The sums are taken of sizes (part, n_tokens), the same rows without wider columns, if given."""
    sums = (rows if sizes is None else sizes).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("base")


def token_digest(df: DataFrame, out: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the token files and returns, from them: doc_id, start, n_tokens, ids_crc32."""
    spark = df.sparkSession
    out = write_tokens(df, out or shared_dir(spark), path)

    def crc(it):
        for b in it:
            lists = b.column(3)
            ids, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            data = memoryview(ids).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])
        give_back()

    place = F.col("_metadata.row_index").alias("row")  # of the row in its file
    rows = read_tokens(spark, out, ("part", place, "doc_id", "tokens")).mapInArrow(crc, "part int, row long, doc_id long, n_tokens long, ids_crc32 long")
    return starts(rows, read_tokens(spark, out, ("part", "n_tokens"))).select("doc_id", "start", "n_tokens", "ids_crc32")
