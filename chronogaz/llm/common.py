"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER_ASCII, and every byte outside `[0-9A-Za-z\x80-\xff]` becomes a space: after it, split() gives the words
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the lower-cased text.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, which is set only if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        else:
            root = tempfile.mkdtemp(prefix="spark-ckpt-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes a frame once to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_class(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """rows joined to their classes (key, n: rows of the class, ...), without n. Classes of over a thousandth of all rows,
    a thousand at most, are broadcast, so that none of them is one task's."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = classes.where(F.col("n") > total // 1000 + 1)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(F.col("n") <= total // 1000 + 1), key)
    return few.unionByName(rest).drop("n")


def words(data: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return data.translate(WORD_TABLE).split()


def batches(it, size_bytes: int = 16 << 20, column: str = "text"):
    """Re-slices record batches so that one slice holds about size_bytes of the column (one row at least)."""
    for b in it:
        n = b.num_rows
        if not n:
            continue
        at = 0
        lengths = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths)
        while at < n:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + size_bytes, side="right")))
            yield b.slice(at, end - at)
            at = end


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    got = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(got.type) or pa.types.is_large_string(got.type):
        got = got.cast(pa.binary() if pa.types.is_string(got.type) else pa.large_binary())
    return [x or b"" for x in got.to_pylist()]


def crc_mod(column, mod: int):
    """crc32 of a column's text, modulo; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % mod


def give_back() -> None:
    """Called at a task's end: the Python worker lives on, so freed memory goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a stream of codes in the order of their first `depth` codes, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    order, have = np.argsort(rank, kind="stable"), 1
    while have < depth:
        step = min(have, depth - have)
        later = np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))[: len(rank)]
        order = np.lexsort((later, rank))
        a, b = rank[order], later[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.array([], bool)
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(fresh)
        have += step
    return order
