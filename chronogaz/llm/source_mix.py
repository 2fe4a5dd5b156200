"""Mixing sources to target weights.

Every row gets a hash-random key (MD5 of a seed and its doc_id); inside each source rows stand in key order, cut into
key ranges of a bounded number of rows; distributed prefix sums (sums for each range, then a running sum in each) give
the words before each row; and the source is cut at its exact budget. A budget over the source's size takes every row
once (or more often) and cuts in the last epoch. The row at the cut gives the words that are left, so that a source
takes its budget to the word.

Null sources are a source of their own. A null or empty text has size 0 and takes nothing. Rows with the same doc_id
have the same key and stand in the order of their size; equal rows in any order, as they are equal. Rows without a
doc_id get a key from all their columns, so that they spread over the key ranges. Sources without words have target 0.
Columns of any name pass through; one that has the name of a column of the result gives way to it. Texts are counted
where they are read, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronogaz.llm.common import cut

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = "mix-1"
#: Rows in one key range of a source.
RANGE_ROWS = 5_000
#: Up to so many sources their plan is broadcast (a row of some 50 bytes for each).
MOST_SOURCES = 1_000_000
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_rows) -> with target: share of all sizes by weight, at most `most` times a source's size.

    Sources with the smallest room for their weight are full first; what they cannot take is shared among the rest.
    The closed form: order by size/weight; source k is full if the budget left, shared by the weights left, is at
    least its room.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    one = Window.partitionBy()  # one row for each source
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    by_room = one.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    left = (
        ranked.withColumn("_budget", F.sum("source_size").over(one) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("_weight", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_rank", F.row_number().over(by_room))
        .withColumn("_full", F.col("source_size") * most * F.col("_weight") <= F.col("_budget") * F.col("weight"))
    )
    first = F.min(F.when(~F.col("_full"), F.struct("_rank", "_budget", "_weight"))).over(one)
    cut = left.withColumn("_first", first)
    target = F.when(F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank")), F.col("source_size") * F.lit(float(most))).otherwise(
        F.col("_first._budget") * F.col("weight") / F.col("_first._weight")
    )
    return cut.select("source", "source_size", "n_rows", target.cast("double").alias("target"))


RESULT = ("size", "source_size", "target", "taken", "copies")


def _mixed(df: DataFrame, size, source: str, key: str, seed: str, range_rows: int, policy: dict) -> DataFrame:
    """(row: all columns of df, and RESULT); df's names cannot clash with those used here."""
    plain = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    named = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null"), F.xxhash64(*plain).cast("string")))
    #: md5 text sorts as its number does; its first 8 digits name the key range
    rows = df.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(key).alias("id"), size.cast("long").alias("size"), F.md5(F.concat(F.lit(seed + ":"), named).cast("binary")).alias("key"))
    rows = cut(rows)  # the sizes are counted once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = targets(sizes, **policy).withColumnRenamed("source", "of")
    small = plan.count() <= MOST_SOURCES
    keyed = rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("of")))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.ceil(F.col("n_rows") / float(range_rows)))
    keyed = keyed.withColumn("range", part.cast("long"))
    sums = keyed.groupBy("of", "range").agg(F.sum("size").alias("sum"))
    upto = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("of").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("of", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(base, F.col("of").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - full * F.col("source_size")
    part_taken = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("base") + F.col("inside"))))
    taken = (full * F.col("size") + part_taken).cast("long")
    copies = (full + (part_taken * 2 >= F.greatest(F.col("size"), F.lit(1))).cast("int")).cast("int")
    return placed.select("row", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def mix(df: DataFrame, size, source: str = "source", key: str = "doc_id", seed: str = SEED, range_rows: int = RANGE_ROWS, **policy) -> DataFrame:
    """Adds size, source_size, target, taken (words) and copies (whole rows: full epochs, and one more if the last
    epoch takes at least half of the row) to each row of df, whose other columns pass through."""
    out = _mixed(df, size, source, key, seed, range_rows, policy)
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in RESULT], *RESULT)


def word_count(text):
    """Number of runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0))


def mixed_rows(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED, range_rows: int = RANGE_ROWS, **policy) -> DataFrame:
    """The mix itself: every row as often as `copies` says, with the columns of df."""
    out = _mixed(df, word_count(F.col(text)), source, key, seed, range_rows, policy)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
