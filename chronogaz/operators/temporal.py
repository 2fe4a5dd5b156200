"""Half-open integer intervals [from, to): merge, coverage, runs, as-of, overlap, override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys):
    return Window.partitionBy(*keys).orderBy("from", "to")


def islands(df: DataFrame, keys: list[str], same: list[str], touching: bool = True) -> DataFrame:
    """Numbers runs of consecutive intervals with equal `same` columns (and, if touching, without a gap)."""
    w = _order(keys)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if touching:
        change = change | (F.col("from") != F.lag("to").over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", F.when(first | F.coalesce(change, F.lit(True)), 1).otherwise(0)).withColumn(
        "island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_new")


def merge_touching(df: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Touching intervals with equal state become one; sources, if there, are united and sorted."""
    rows = islands(df, keys, same)
    aggs = [F.min("from").alias("from"), F.max("to").alias("to")]
    if "sources" in df.columns:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return rows.groupBy(*keys, *same, "island").agg(*aggs).drop("island")


def coverage(df: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """Gaps and overlaps inside [lo, hi), against a cursor that is the largest end so far: (keys, kind, from, to)."""
    w = _order(keys).rowsBetween(Window.unboundedPreceding, -1)
    cur = df.withColumn("_cursor", F.greatest(lo, F.coalesce(F.max("to").over(w), lo)))
    gaps = cur.where(F.col("from") > F.col("_cursor")).select(*keys, F.lit("gap").alias("kind"), F.col("_cursor").alias("from"), F.col("from").alias("to"))
    over = cur.where(F.col("from") < F.col("_cursor")).select(*keys, F.lit("overlap").alias("kind"), "from", F.col("_cursor").alias("to"))
    tail = df.groupBy(*keys).agg(F.greatest(lo, F.max("to")).alias("_end")).where(F.col("_end") < hi)
    return gaps.unionByName(over).unionByName(tail.select(*keys, F.lit("gap").alias("kind"), F.col("_end").alias("from"), hi.alias("to")))


def stop_changes(periods: DataFrame, keys: list[str], state: list[str], stops: DataFrame) -> DataFrame:
    """(stop) -> (stop, n_meeting, changes): how many pairs of neighbouring periods of a key meet at each stop, and whether
    the state differs over any of them. A stop where none changes is one too many."""
    w = Window.partitionBy(*keys).orderBy("from", "to")
    differs = ~F.lit(True)
    for c in state:
        differs = differs | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    pairs = periods.withColumns({"_meets": F.lag("to").over(w) == F.col("from"), "_differs": differs}).where("_meets")
    found = pairs.groupBy(F.col("from").alias("stop")).agg(F.count("*").alias("n_meeting"), F.max("_differs").alias("changes"))
    return stops.select("stop").distinct().join(found, "stop", "left").select("stop", F.coalesce("n_meeting", F.lit(0)).alias("n_meeting"), F.coalesce("changes", F.lit(False)).alias("changes"))


def adjacent_same(df: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Intervals that touch a predecessor of equal state: they should have been merged."""
    w = _order(keys)
    hit = F.lag("to").over(w) == F.col("from")
    for c in same:
        hit = hit & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_hit", hit).where("_hit").drop("_hit")


def holder_runs(df: DataFrame, keys: list[str], holder: str) -> DataFrame:
    """Each interval with the contiguous run of its holder around it: run_from, run_to."""
    rows = islands(df, keys, [holder])
    w = Window.partitionBy(*keys, "island")
    return rows.withColumn("run_from", F.min("from").over(w)).withColumn("run_to", F.max("to").over(w)).drop("island")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, value: str, or_first: bool = False) -> DataFrame:
    """Each left row with the latest right row of its key at or before it; before the first: null, or the first.

    One union and one window over the key instead of a range join, so the cost is one shuffle and one sort.
    """
    r = right.select(F.col(key), F.col(at), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_hit"))
    l = left.withColumns({"_side": F.lit(1), "_tie": F.lit(None).cast(right.schema[tie].dataType), "_hit": F.lit(None).cast(r.schema["_hit"].dataType)})  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side", "_tie")
    got = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if or_first:
        got = F.coalesce(got, F.first("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return both.withColumn("_got", got).where("_side = 1").withColumn("matched_at", F.col("_got.at")).withColumn("matched", F.col("_got.v")).drop("_side", "_tie", "_hit", "_got")


def buckets(lo: Column, hi: Column, width: int) -> Column:
    """The buckets that [lo, hi) touches."""
    return F.explode(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width)))


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals of one key that overlap, found once: in the bucket of the later start.

    a has (key, a_id, a_from, a_to), b has (key, b_id, b_from, b_to), each with from < to."""
    left = a.withColumn("_b", buckets(F.col("a_from"), F.col("a_to"), width))
    right = b.withColumn("_b", buckets(F.col("b_from"), F.col("b_to"), width))
    hit = left.join(right, [key, "_b"]).where((F.col("a_from") < F.col("b_to")) & (F.col("b_from") < F.col("a_to")))
    return hit.where(F.col("_b") == F.floor(F.greatest("a_from", "b_from") / width)).drop("_b")


def holder_at(points: DataFrame, periods: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Points with the interval of their key that holds them; points without one are kept with nulls."""
    cells = periods.withColumn("_b", buckets(F.col("from"), F.col("to"), width)).withColumnRenamed(key, "_k")
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    on = (p[key] == cells["_k"]) & (p["_b"] == cells["_b"]) & (p[at] >= cells["from"]) & (p[at] < cells["to"])
    return p.join(cells, on, "left").drop("_k", "_b")


def override(base: DataFrame, over: DataFrame, key: str, width: int = 365) -> DataFrame:
    """Base intervals (key, from, to, holder) with non-overlapping overrides of the same key laid over them.

    An override keeps only what lies in a base interval; pieces are the base's cuts. All overrides of a key are cut in
    one pass: elementary pieces between consecutive bounds, each with the override that holds it, else its base. Base and
    overrides meet in buckets of `width`, so a key with many periods is no product."""
    own = F.struct("from", "to", "holder")
    a = base.select(F.col(key), own.alias("a_id"), F.col("from").alias("a_from"), F.col("to").alias("a_to")).distinct()
    b = over.select(F.col(key), F.struct(F.col("from").alias("_f"), F.col("to").alias("_t"), F.col("holder").alias("_h")).alias("b_id"), F.col("from").alias("b_from"), F.col("to").alias("b_to"))
    held_by = overlaps(a, b, key, width).groupBy(key, "a_id").agg(F.array_sort(F.collect_list("b_id")).alias("_o"))
    none = F.array().cast(held_by.schema["_o"].dataType)
    grouped = base.withColumn("a_id", own).join(held_by, [key, "a_id"], "left").withColumn("_o", F.coalesce("_o", none)).drop("a_id")
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("from", "to"), F.flatten(F.transform("_o", lambda x: F.array(F.greatest(F.col("from"), x["_f"]), F.least(F.col("to"), x["_t"])))))))
    pieces = grouped.withColumn("_c", cuts).withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.size("_c") - 2), lambda i: F.struct(F.get("_c", i).alias("f"), F.get("_c", i + 1).alias("t")))))
    held = F.get(F.filter("_o", lambda x: (x["_f"] <= F.col("_p.f")) & (F.col("_p.t") <= x["_t"])), F.lit(0))["_h"]
    return pieces.select(key, F.col("_p.f").alias("from"), F.col("_p.t").alias("to"), F.coalesce(held, F.col("holder")).alias("holder"))


def history(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Base periods (key, from, to, holder, sources) with the overrides (key, id, from, to, holder, sources) of each key laid
    over them one after the other, by start and id, touching periods of one holder merged after each: their sources unite,
    and a later cut keeps the united sources on both sides. Rounds grow with the largest number of overrides of a key; a
    key leaves after its last, so a round writes the keys that it changes alone."""
    from chronogaz.operators.graph import checkpointed

    place = F.row_number().over(Window.partitionBy(key).orderBy("from", "id"))
    laid = checkpointed(over.withColumn("place", place))
    rounds = laid.agg(F.max("place")).first()[0] or 0
    # how many overrides each key still has goes with its periods
    many = laid.groupBy(key).agg(F.max("place").alias("_n"))
    now, out = checkpointed(merge_touching(base, [key], ["holder"]).join(many, key, "left")), []
    for r in range(1, rounds + 1):
        out.append(now.where(F.coalesce("_n", F.lit(0)) < r))
        now = now.where(F.col("_n") >= r)
        o = laid.where(F.col("place") == r).select(F.col(key).alias("_k"), F.col("from").alias("_f"), F.col("to").alias("_t"), F.col("holder").alias("_h"), F.col("sources").alias("_s"))
        hit = now.join(o, (F.col(key) == F.col("_k")) & (F.col("_f") < F.col("to")) & (F.col("from") < F.col("_t")), "left")
        piece = lambda a, b, h, s: F.struct(a.alias("from"), b.alias("to"), h.alias("holder"), s.alias("sources"))
        f, t = F.greatest("from", "_f"), F.least("to", "_t")
        own = F.col("holder"), F.col("sources")
        cut = F.array(piece(F.col("from"), f, *own), piece(f, t, F.col("_h"), F.col("_s")), piece(t, F.col("to"), *own))
        whole = F.array(piece(F.col("from"), F.col("to"), *own))
        pieces = F.filter(F.when(F.col("_k").isNull(), whole).otherwise(cut), lambda p: p["from"] < p["to"])
        now = checkpointed(merge_touching(hit.select(key, "_n", F.explode(pieces).alias("p")).select(key, "_n", "p.*"), [key, "_n"], ["holder"]))
    for done in out:
        now = now.unionByName(done)
    return now.drop("_n")
