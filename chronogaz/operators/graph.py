"""Iterative graph jobs as rounds of joins; each round is written to the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one is set only where there is none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return (root or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder.

    A table's size is read from its files; a checkpointed frame keeps the planner's guess, which joins multiply, so that
    over some rounds the guess alone grows to numbers of thousands of digits."""
    path = f"{shared_root(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (node, component): the smallest node reachable; labels spread and jump to their label's label."""
    both = checkpointed(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    label = checkpointed(nodes.withColumn("component", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        spread = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = spread.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = checkpointed(spread.join(jump, F.col("component") == F.col("_n")).select("node", F.least("component", "_c").alias("component")))
        changed = new.join(label.withColumnRenamed("component", "_old"), "node").where("component <> _old")
        if changed.isEmpty():
            return new
        label = new


def shortest_costs(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """(src, dst, weight) and (node) -> (node, cost, prev): frontier relaxation until nothing improves; ties by prev.

    Paths that cost more than limit are not followed."""
    best = checkpointed(sources.select("node", F.lit(0).cast("long").alias("cost"), F.lit(None).cast("long").alias("prev")))
    frontier = best
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("src").alias("prev"))
        step = step if limit is None else step.where(F.col("cost") <= limit)
        least = step.groupBy("node").agg(F.min(F.struct("cost", "prev")).alias("m")).select("node", F.col("m.cost").alias("cost"), F.col("m.prev").alias("prev"))
        old = best.select("node", F.col("cost").alias("_c"), F.col("prev").alias("_p"))
        better = least.join(old, "node", "left").where("_c is null or cost < _c or (cost = _c and prev < _p)")
        frontier = checkpointed(better.select("node", "cost", "prev"))
        best = checkpointed(best.join(frontier, "node", "left_anti").unionByName(frontier))
    return best


def ancestors(tree: DataFrame) -> DataFrame:
    """(id, parent) -> (id, ancestor, depth) by pointer doubling: rounds grow with the log of the depth."""
    up = checkpointed(tree.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    out, span = up, 1
    while True:
        hop = up.where(F.col("depth") == span).select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        more = out.join(hop, "ancestor").select("id", F.col("_a").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth"))
        new = checkpointed(out.unionByName(more).distinct())
        far = new.where(F.col("depth") == 2 * span)
        if far.isEmpty():
            return new
        out = up = new
        span *= 2


def cycle_members(tree: DataFrame) -> DataFrame:
    """(id, parent) -> (id, cycle): nodes that reach themselves, named by their cycle's smallest node.

    Pointer doubling: after 2^r steps only nodes that long ways lead to are left, and ways that ended at a root have gone.
    When one more doubling leaves as many, the steps turn what is left onto itself: these are the cycles. Rounds grow with
    the log of the longest chain."""
    step = checkpointed(tree.where("parent is not null").select("id", F.col("parent").alias("to")))
    jump, before = step, None
    while True:
        held = checkpointed(jump.select(F.col("to").alias("id")).distinct())
        n = held.count()
        if n == before:
            break
        before = n
        hop = jump.select(F.col("id").alias("to"), F.col("to").alias("_to"))
        jump = checkpointed(jump.join(hop, "to").select("id", F.col("_to").alias("to")))
    step = step.join(held, "id", "left_semi")
    return connected_components(step.select(F.col("id").alias("src"), F.col("to").alias("dst"))).select(F.col("node").alias("id"), F.col("component").alias("cycle"))


def positions(df: DataFrame, key: str) -> DataFrame:
    """Adds pos, each row's place from 1 in the order of a unique key: ranges of keys, their counts summed, rows numbered
    inside their range. The ranges' sums are one row for each range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, key).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key))
    return ranged.join(F.broadcast(base), "range").withColumn("pos", (F.col("base") + inside).cast("long")).drop("range", "base")  # a row for each range


def traced_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst, weight, id) -> (target, back, node, edge, cost): the least-cost path to each target that is reached, from
    the target back; edge is the id of the edge that leads to the node, null at the source."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "id"))
    best = checkpointed(both.groupBy("src", "dst").agg(F.min(F.struct("weight", "id")).alias("m")).select("src", "dst", "m.weight", "m.id"))
    reached = shortest_costs(best.drop("id"), sources)
    step = reached.join(best.select(F.col("src").alias("prev"), F.col("dst").alias("node"), F.col("id").alias("edge")), ["prev", "node"], "left").select("node", "cost", "prev", "edge")
    at = checkpointed(targets.select("node").distinct().join(step, "node").withColumns({"target": F.col("node"), "back": F.lit(0)}))
    out = at
    while True:
        on = at.where("prev is not null").select("target", (F.col("back") + 1).alias("back"), F.col("prev").alias("node"))
        at = checkpointed(on.join(step, "node"))
        if at.isEmpty():
            return out.select("target", "back", "node", "edge", "cost")
        out = out.unionByName(at.select(out.columns))


def running(values: DataFrame, by: str, value: str, n: str) -> DataFrame:
    """(by, value, n), values distinct in a key -> with upto: n summed over the key's values up to this one.

    Key and value are range-partitioned together, so a hot key takes many ranges; their sums, a row for each key and range,
    are summed first, then the values inside a range."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(values.select(by, value, n).repartitionByRange(parts, by, value).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(by, "range").agg(F.sum(n).alias("s")).select(F.col(by).alias("_by"), F.col("range").alias("_range"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = F.sum(n).over(Window.partitionBy(by, "range").orderBy(value))
    rows = ranged.withColumn("inside", inside).join(base, F.col(by).eqNullSafe(F.col("_by")) & (F.col("range") == F.col("_range")))
    return rows.select(by, value, n, (F.col("base") + F.col("inside")).alias("upto"))
