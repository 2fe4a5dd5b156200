"""Hand-checked micro tables and invariants."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from chronogaz.functions import geo, text
from chronogaz.operators import graph, spatial, temporal


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_override_adds_nothing_outside_and_covers_the_base(spark):
    base = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 20, "b"), (2, 0, 5, "a")], "k int, `from` long, `to` long, holder string")
    over = spark.createDataFrame([(1, -5, 3, "X"), (1, 8, 12, "Y"), (2, 7, 9, "X")], "k int, `from` long, `to` long, holder string")
    assert rows(temporal.override(base, over, "k"), "k", "from", "to", "holder") == [(1, 0, 3, "X"), (1, 3, 8, "a"), (1, 8, 10, "Y"), (1, 10, 12, "Y"), (1, 12, 20, "b"), (2, 0, 5, "a")]


def test_as_of_before_the_first(spark):
    left = spark.createDataFrame([(1, 5), (1, 15), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 10, "s")], "k int, t int, v string").withColumn("tie", F.lit(0))
    assert rows(temporal.as_of(left, right, "k", "t", "tie", "v").fillna("-"), "k", "t", "matched") == [(1, 5, "-"), (1, 15, "s"), (2, 1, "-")]
    assert rows(temporal.as_of(left, right, "k", "t", "tie", "v", True).fillna("-"), "k", "t", "matched") == [(1, 5, "s"), (1, 15, "s"), (2, 1, "-")]


def test_overlap_is_reported_up_to_the_cursor(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 2, 4), (1, 12, 14)], "k int, `from` long, `to` long")
    got = rows(temporal.coverage(df, ["k"], F.lit(0).cast("long"), F.lit(20).cast("long")), "kind", "from", "to")
    assert got == [("gap", 10, 12), ("gap", 14, 20), ("overlap", 2, 10)]


def test_one_edit_takes_distant_swaps(spark):
    df = spark.createDataFrame([("abcd", "dbca"), ("abcd", "abxd"), ("abcd", "xbcy"), ("ab", "abc"), ("", "")], "a string, b string")
    assert [r.x for r in df.select(text.one_edit(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, True, True]


def test_rounding_ties_go_up(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (-1.25,)], "x double")
    assert [r.x for r in df.select(geo.round_half_up(F.col("x"), 0).alias("x")).collect()] == [0.0, 1.0, -1.0]


def test_cycles_and_components(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, None), (7, 6)], "id long, parent long")
    assert rows(graph.cycle_members(tree), "id", "cycle") == [(1, 1), (2, 1), (3, 1), (5, 5)]
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    assert {r.component for r in graph.connected_components(e).collect()} == {0, 100}


def test_dissolve_cancels_shared_edges_and_keeps_area(spark):
    sq = lambda a, x: [(a, x, 0.0, x + 1, 0.0), (a, x + 1, 0.0, x + 1, 1.0), (a, x + 1, 1.0, x, 1.0), (a, x, 1.0, x, 0.0)]
    e = spark.createDataFrame(sq(1, 0.0) + sq(2, 1.0), "area_id int, x1 double, y1 double, x2 double, y2 double")
    assert spatial.dissolve(e.withColumn("g", F.lit(1)), "g").count() == 6
    assert rows(spatial.shoelace(e, "area_id"), "area_id", "area") == [(1, 1.0), (2, 1.0)]
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 5.0, 0.5)], "id int, lon double, lat double")
    assert rows(spatial.containing(p, e), "id", "area_id") == [(1, 1), (2, 2)]


def plain_simplify(points, tolerance):
    def far(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
        return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5

    def keep(lo, hi):
        best = max(range(lo + 1, hi), key=lambda i: (far(points[i], points[lo], points[hi]), -i), default=None)
        if best is None or far(points[best], points[lo], points[hi]) <= tolerance:
            return set()
        return {best} | keep(lo, best) | keep(best, hi)

    return {0, len(points) - 1} | keep(0, len(points) - 1)


def test_simplified_lines_equal_the_plain_version(spark):
    lines = {k: [(float(i * 7 % 5 + i), float(i * (k + 3) % 11)) for i in range(n)] for k, n in enumerate((1, 2, 3, 30, 61))}
    df = spark.createDataFrame([(k, i, x, y) for k, ps in lines.items() for i, (x, y) in enumerate(ps)], "line_id int, seq int, lon double, lat double")
    assert rows(spatial.simplify(df, 2.0), "line_id", "seq") == sorted((k, i) for k, ps in lines.items() for i in plain_simplify(ps, 2.0))


def test_lines_are_simplified_in_one_pass(spark):
    """Lines longer than a batch, many short ones, and vertices without a place; no round is written."""
    rng = random.Random(8)
    lines = {k: [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(n)] for k, n in enumerate([25, 700, 1, 2] + [rng.randint(1, 8) for _ in range(200)])}
    df = spark.createDataFrame([(f"l{k}", i * 3, x, y) for k, ps in lines.items() for i, (x, y) in enumerate(ps)], "line_id string, seq long, lon double, lat double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        root = Path(graph.shared_root(spark).removeprefix("file:"), "rounds")
        before = len(list(root.glob("*")))
        got = rows(spatial.simplify(df, 2.0), "line_id", "seq")
        assert len(list(root.glob("*"))) == before
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((f"l{k}", i * 3) for k, ps in lines.items() for i in plain_simplify(ps, 2.0))
    odd = [(1, 0, 0.0, 0.0), (1, 1, None, 5.0), (1, 2, 5.0, 5.0), (1, 3, 9.0, 0.0), (2, 0, None, None), (2, 1, 5.0, 9.0), (2, 2, 1.0, 1.0), (3, 0, 0.0, 0.0), (3, 1, float("nan"), 0.0), (3, 2, 1.0, 0.0)]
    schema = "line_id int, seq int, lon double, lat double"
    assert rows(spatial.simplify(spark.createDataFrame(odd, schema), 2.0), "line_id", "seq") == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 2), (3, 0), (3, 1), (3, 2)]
    assert spatial.simplify(spark.createDataFrame([], schema), 2.0).count() == 0


def test_cycles_behind_long_chains(spark):
    n = 3000
    tree = [(i, i + 1) for i in range(n)] + [(n, n + 1), (n + 1, n + 2), (n + 2, n)] + [(10**6 + i, 10**6 + i + 1) for i in range(n)] + [(2 * 10**6, 2 * 10**6)]
    got = rows(graph.cycle_members(spark.createDataFrame(tree, "id long, parent long")), "id", "cycle")
    assert got == [(n, n), (n + 1, n), (n + 2, n), (2 * 10**6, 2 * 10**6)]
    assert graph.cycle_members(spark.createDataFrame([(1, 2), (2, None)], "id long, parent long")).count() == 0
    assert graph.cycle_members(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_nearest_where_points_lie_dense_and_sparse(spark):
    import math
    import random

    rng = random.Random(3)
    b = [(i, 10 + rng.random() / 50, 40 + rng.random() / 50) for i in range(1500)] + [(5000 + i, rng.uniform(0, 40), rng.uniform(20, 60)) for i in range(60)] + [(9000 - i, 10.0, 40.0) for i in range(1500)]
    a = [(i, rng.uniform(-5, 45), rng.uniform(15, 65)) for i in range(120)] + [(500 + i, 10 + rng.random() / 60, 40 + rng.random() / 60) for i in range(120)] + [(900, 10.0, 40.0)]

    def km(p, q):
        x, y, u, v = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))

    want = {p[0]: min((round(km(p, q), 9), q[0]) for q in b)[1] for p in a if min(km(p, q) for q in b) <= 300}
    df = lambda ps: spark.createDataFrame([(i, float(x), float(y)) for i, x, y in ps], "id long, lon double, lat double")
    assert {r.a_id: r.b_id for r in spatial.nearest(df(a), df(b), 300.0).collect()} == want
    assert spatial.nearest(df(a), df(b).limit(0), 300.0).count() == 0 and spatial.nearest(df(a).limit(0), df(b), 300.0).count() == 0
