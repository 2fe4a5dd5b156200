"""Sharding by a computed permutation.

Rows get global row numbers 0 to n-1 in the order of a key: rows are dealt into key ranges, sorted there and written
once to the shared folder with their place in their range; a running sum over the ranges' counts gives each range its
first number. A Feistel network over two sides a * b >= n (rounds add an MD5 of the other side, modulo the own side)
permutes the numbers; a value of n or more is permuted again until it falls below n (cycle walking). Permuted number p
is slot p div shards of shard p mod shards: counts differ by one at most and slots have no gaps. Nothing but the seed,
n and the number of shards is needed to compute the place of a row number, or the row number at a place.

Only SQL functions: no Python in tasks. The order among equal keys is given by `ties`; rows equal in both are dealt out
over ranges by their position in the input, so that a hot key takes many tasks. They are interchangeable for the
numbers' sake, but their position must be repeatable: give a table that was written, not the output of a shuffle.
Null keys come first. Null and empty texts count as any row; an empty table has no shards. Columns of any name pass
through, one that has the name of a column of the result gives way to it. Texts pass through whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogaz.llm.common import cut

SHARDS, SEED, ROUNDS = 8, "shard-1", 6
#: So many lengths of the first side are tried for the one that leaves the fewest values beyond n.
TRIES = 1 << 20
RESULT = ("row_no", "shard", "slot")


def sides(n: int) -> tuple[int, int]:
    """(a, b): a * b >= n, both near the root of n, with few values from n on."""
    if n < 2:
        return 1, 1
    root = math.isqrt(n - 1) + 1
    a = np.arange(root, root + min(root, TRIES), dtype=np.int64)
    best = int(a[int(np.argmin(-n % a))])
    return best, -(-n // best)


def _div(value: Column, by: int) -> Column:
    """Whole quotient; exact, as the number divided is a multiple (below 2^53)."""
    return ((value - value % by) / F.lit(by)).cast("long")


def _mixed(value: Column, n: int, seed: str, rounds: range) -> Column:
    """One pass of the network over a number below a * b; rounds in falling order with a minus sign undo it."""
    a, b = sides(n)
    sign, order = (1, rounds) if rounds.step > 0 else (-1, rounds)

    def added(k: Column, other: Column, own: Column, side: int) -> Column:
        digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), k, other)), 1, 15)  # 60 bits
        return F.pmod(own + F.conv(digits, 16, 10).cast("long") % side * sign, F.lit(side).cast("long"))

    def step(s: Column, k: Column) -> Column:
        left, right = s["left"], s["right"]
        return F.when(k % 2 == 0, F.struct(added(k, right, left, a).alias("left"), right.alias("right"))).otherwise(
            F.struct(left.alias("left"), added(k, left, right, b).alias("right"))
        )

    start = F.struct(_div(value, b).alias("left"), (value % b).cast("long").alias("right"))
    return F.aggregate(F.array(*[F.lit(k) for k in order]), start, step, lambda s: s["left"] * b + s["right"])


def _walked(value: Column, n: int, seed: str, rounds: range) -> Column:
    """Permuted until it is below n. A walk meets each value from n on once at most, which bounds the steps."""
    a, b = sides(n)
    once = _mixed(value, n, seed, rounds)
    if a * b == n:
        return once
    more = F.sequence(F.lit(1), F.lit(a * b - n))
    return F.aggregate(more, once, lambda v, _: F.when(v < n, v).otherwise(_mixed(v, n, seed, rounds)))


def permuted(row_no: Column, n: int, seed: str = SEED) -> Column:
    """The place of a row number in the shuffled order of n rows."""
    return _walked(row_no.cast("long"), n, seed, range(ROUNDS))


def row_at(shard: Column, slot: Column, n: int, shards: int = SHARDS, seed: str = SEED) -> Column:
    """The row number that stands in this slot of this shard."""
    return _walked(slot.cast("long") * shards + shard, n, seed, range(ROUNDS - 1, -1, -1))


def numbered(df: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(row: all columns of df, row_no) and the number of rows."""
    at = F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(ties)])
    rows = df.select(F.struct("*").alias("row"), at.alias("at")).withColumn("spread", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange("at", "spread").sortWithinPartitions("at", "spread")
    placed = cut(ranges.select("row", F.monotonically_increasing_id().alias("id")))  # range in the upper bits, place in the lower 33
    placed = placed.select("row", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place"))
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range: thousands, whatever the input
    first = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("range", first.alias("base"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    return placed.join(F.broadcast(bases), "range").select("row", (F.col("base") + F.col("place")).alias("row_no")), n


def sharded(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", ties: tuple[str, ...] = (), seed: str = SEED) -> DataFrame:
    """Adds row_no (long), shard (int) and slot (long) to each row of df."""
    rows, n = numbered(df, key, ties)
    place = rows.withColumn("_place", permuted(F.col("row_no"), n, seed))
    return place.select(
        *[F.col("row")[c].alias(c) for c in df.columns if c not in RESULT],
        "row_no",
        (F.col("_place") % shards).cast("int").alias("shard"),
        _div(F.col("_place"), shards).alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, **how) -> None:
    """A folder for each shard, its files in ranges of slots and sorted by slot."""
    out = sharded(df, shards, **how).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (bytes of the text and one), text_crc32, law, shard, slot, grown_shard, row_no of each document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharded(rows, shards, ties=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
