"""Jobs on tables with many rows at one place: what is looked at must not grow with their product."""

import math
import random

from pyspark.sql import functions as F

from chronogaz.functions import geo
from chronogaz.operators import audit as A
from chronogaz.operators import network as N
from chronogaz.operators import regions as R
from chronogaz.operators import spatial as S
from chronogaz.plans import views as V

XY = "x1 double, y1 double, x2 double, y2 double"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def lines(spark, n, copies):
    rng = random.Random(5)
    shape = [(rng.uniform(0, 3), rng.uniform(40, 43), rng.uniform(0, 3), rng.uniform(40, 43)) for _ in range(n)]
    return spark.createDataFrame([(c * n + i, 1, *s) for c in range(copies) for i, s in enumerate(shape)], f"line_id long, seq int, {XY}")


def test_points_at_one_place_are_one_search(spark):
    segs = lines(spark, 40, 3)
    sites = spark.createDataFrame([(i, 1.0 + i % 2, 41.0) for i in range(60)], "id long, lon double, lat double")
    near = S.near_places(sites, segs, 20.0).select("lon", "lat", "line_id").distinct()
    assert near.count() * 30 == S.near_edges(sites, segs, 20.0).select("id", "line_id").distinct().count() > 0
    feet = S.nearest_foot(sites, segs, 60.0, ["line_id", "seq"])
    every = {(r.id, r.line_id): r.km for r in S.near_edges(sites, segs, 60.0).collect()}
    want = {i: min((km, line) for (j, line), km in every.items() if j == i) for i in range(60)}
    assert {r.id: (r.km, r.line_id) for r in feet.collect()} == want


def test_radius_falls_as_edges_grow_dense(spark):
    assert S.dozen_km(lines(spark, 40, 50), 60.0) < S.dozen_km(lines(spark, 40, 5), 60.0) < 60.0
    assert S.dozen_km(lines(spark, 40, 1).limit(0), 60.0) == 60.0


def test_lines_that_cross_a_shore_need_no_distance(spark, monkeypatch):
    shore = A.projected(spark.createDataFrame([(1.5, 39.0, 1.5, 44.0)], XY))
    flat = A.projected(spark.createDataFrame([(1, 1, 1.0, 41.0, 2.0, 41.0), (2, 1, 1.52, 41.0, 2.0, 41.0), (3, 1, 2.0, 41.0, 2.5, 41.0), (4, 1, 1.0, 41.0, 1.0, 41.0)], f"line_id long, seq int, {XY}"))
    seen, beside = [], A._beside
    monkeypatch.setattr(A, "_beside", lambda segs, *a: seen.append(segs.count()) or beside(segs, *a))
    skips = flat.selectExpr("line_id", "0D as start_km", "0D as end_km")
    got = {r.line_id: round(r.km, 2) for r in A.nearest_shore(flat, shore, skips).collect()}
    assert got == {1: 0.0, 2: round(0.02 * geo.EARTH_KM * 0.017453292519943295 * 0.7547095802227721, 2), 3: 4.0, 4: 4.0}
    assert seen == [2]


def test_turns_back_along_a_parallel_keep_their_side(spark):
    """A zero's sign tells the side of a turn of half a circle, as in DuckDB."""
    import duckdb

    pairs = [(y, x) for y in (0.0, -0.0, 1.0, -1.0) for x in (0.0, -0.0, 2.0, -2.0)]
    got = [r[0] for r in spark.createDataFrame(pairs, "y double, x double").select(geo.atan2(F.col("y"), F.col("x"))).collect()]
    want = [duckdb.execute("select atan2(?::double, ?::double)", p).fetchone()[0] for p in pairs]
    assert got == want
    # east, a short step back west, east and north: the step's turns are -180 degrees and more than 20 to the right
    flat = spark.createDataFrame([(1, 1, 9000.0, 0.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 900.0, 0.0), (1, 3, 900.0, 0.0, 900.0, 900.0)], f"line_id long, seq int, {XY}")
    assert rows(A.stair_steps(flat), "line_id", "seq", "single") == [(1, 2, True)]


def test_ends_on_other_lines_leave_before_the_distances(spark):
    from chronogaz.operators import network as N

    shape = [(0.0, 0.0, 0.1, 0.0), (0.0, 0.0, 0.0, 0.2), (5.0, 5.0, 5.1, 5.0), (5.0, 5.01, 5.1, 5.02)]
    segs = spark.createDataFrame([(i, 1, *s) for i, s in enumerate(shape)], f"road_id long, seq int, {XY}")
    tips = [(i, side, *s[k : k + 2], *s[2 - k : 4 - k]) for i, s in enumerate(shape) for k, side in ((0, "start"), (2, "end"))]
    ends = spark.createDataFrame(tips, "road_id long, side string, lon double, lat double, before_lon double, before_lat double")
    assert rows(N._off_others(ends, segs, "road_id"), "road_id", "side") == [(0, "end"), (1, "end"), (2, "end"), (2, "start"), (3, "end"), (3, "start")]
    got = N.gap_candidates(ends, segs, "road_id")
    assert rows(got, "road_id", "side") == [(2, "end"), (2, "start"), (3, "end"), (3, "start")]


def crossing(a, b):
    """Where two segments (line, seq, x1 .. y2) cross: t on the first and u on the second."""
    rx, ry, sx, sy = a[4] - a[2], a[5] - a[3], b[4] - b[2], b[5] - b[3]
    den = rx * sy - ry * sx
    qx, qy = b[2] - a[2], b[3] - a[3]
    return ((qx * sy - qy * sx) / den, (qx * ry - qy * rx) / den) if den else (-1.0, -1.0)


def dealt(monkeypatch):
    """Rows that are dealt to cells, each time."""
    seen, deal = [], S.passed_cells
    monkeypatch.setattr(S, "passed_cells", lambda df, *a, **k: seen.append(df.count()) or deal(df, *a, **k))
    return seen


def test_lines_that_lie_alike_cross_as_one(spark, monkeypatch):
    segs = lines(spark, 12, 4)
    flat, seen = [tuple(r) for r in segs.collect()], dealt(monkeypatch)
    want = {(a[0], b[0]) for a in flat for b in flat if a[0] < b[0] and all(0 <= v <= 1 for v in crossing(a, b))}
    got = rows(N.crossings_of_lines(segs, "line_id", 0.5), "a", "b", "x", "y")
    assert [g[:2] for g in got] == sorted(want) and len(want) > 100 and max(seen) == 12
    one = {r[0]: r for r in flat}
    for a, b, x, y in got:
        t = crossing(one[a], one[b])[0]
        assert (x, y) == (one[a][2] + t * (one[a][4] - one[a][2]), one[a][3] + t * (one[a][5] - one[a][3]))


def test_rays_that_lie_alike_are_one_search(spark, monkeypatch):
    """Copies meet each other's lines, but never their own; loose ends are those without another line."""
    rng = random.Random(9)
    at = [(rng.uniform(0, 1), rng.uniform(40, 41)) for _ in range(30)]
    shape = [(x, y, x + rng.uniform(-0.2, 0.2), y + rng.uniform(-0.2, 0.2)) for x, y in at]
    # the first ten stand once, the others three times; the last line starts on the first one
    flat = [(c * 30 + i, 1, *s) for c in range(3) for i, s in enumerate(shape) if c == 0 or i >= 10] + [(200, 1, *shape[0][:2], 5.0, 45.0)]
    segs = spark.createDataFrame(flat, f"line_id long, seq int, {XY}")
    ends = [(r[0], side, *(r[2:] if side == "start" else r[4:] + r[2:4])) for r in flat for side in ("start", "end")]
    given = spark.createDataFrame(ends, "line_id long, side string, lon double, lat double, before_lon double, before_lat double")
    seen = dealt(monkeypatch)
    got = {(r.line_id, r.side): (r.target, r.target_seq, r.km) for r in N.ray_hits(given, segs, "line_id", 40.0).collect()}
    assert max(seen) <= 2 * 31
    want = {}
    for line, side, lon, lat, blon, blat in ends:
        k = math.cos(math.radians(lat)) * geo.DEG_LON_KM
        dx, dy = (lon - blon) * k, (lat - blat) * geo.DEG_LAT_KM
        rx, ry = dx / math.hypot(dx, dy), dy / math.hypot(dx, dy)
        hits = []
        for target, seq, x1, y1, x2, y2 in flat:
            px, py, ex, ey = (x1 - lon) * k, (y1 - lat) * geo.DEG_LAT_KM, (x2 - x1) * k, (y2 - y1) * geo.DEG_LAT_KM
            cross = rx * ey - ry * ex
            if target != line and abs(cross) >= 1e-9 and 0 < (px * ey - py * ex) / cross <= 40 and 0 <= (px * ry - py * rx) / cross <= 1:
                hits.append((round((px * ey - py * ex) / cross, 9), target, seq))
        if hits:
            want[line, side] = min(hits)
    assert {k: v[:2] for k, v in got.items()} == {k: v[1:] for k, v in want.items()} and len(want) >= 60
    loose = {(r.line_id, r.side) for r in N.loose_ends(given, segs, "line_id").collect()}
    assert loose == {(i, side) for i in range(10) for side in ("start", "end")} - {(0, "start")} | {(200, "end")}


def test_vertices_at_one_place_are_one_search_of_their_source(spark, monkeypatch):
    segs = lines(spark, 20, 3)
    at = [(r.line_id, 1, r.x1, r.y1, "k") for r in segs.collect()] + [(500, 1, 1.0, 41.0, "k")]
    given = spark.createDataFrame(at, "line_id long, seq int, lon double, lat double, kind string")
    seen = dealt(monkeypatch)
    got = {r.line_id: (r.worst_km, r.ok) for r in R.permitted(given, "line_id", {"k": (segs.withColumnRenamed("line_id", "owner"), 30.0)}).collect()}
    assert max(seen) <= 2 * 20  # of three copies two stand for all
    near = [(r.id, r.line_id, r.km) for r in S.near_edges(given.withColumn("id", F.col("line_id")).drop("line_id"), segs, 60.0).collect()]
    want = {a[0]: min((km for i, other, km in near if i == a[0] and other != a[0]), default=None) for a in at}
    assert {k: v[0] and round(v[0], 9) for k, v in got.items()} == {k: v and round(v, 9) for k, v in want.items()} and want[0] == 0


def test_pieces_of_lines_are_not_shuffled(spark):
    vertices = spark.createDataFrame([(i, k, float(i % 7 + 3 * k), float(40 + (i * k) % 5)) for i in range(50) for k in range(4)], "line_id long, seq int, lon double, lat double")
    shores = A.projected(spark.createDataFrame([(1, "land", *e) for e in ((0.0, 40.0, 6.0, 40.0), (6.0, 40.0, 6.0, 44.0), (6.0, 44.0, 0.0, 44.0), (0.0, 44.0, 0.0, 40.0))], f"area_id long, kind string, {XY}"))
    pieces = A.split_at_shores(A.projected(S.segments(vertices)), shores)
    assert {r.surface for r in pieces.select("surface").distinct().collect()} == {"land", "sea"}
    assert pieces._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of the vertices, to their lines


def test_small_and_large_rings_have_the_same_faults(spark, monkeypatch):
    rng = random.Random(2)
    at = [[(rng.randrange(5), rng.randrange(5)) for _ in range(n)] for n in (3, 4, 9, 33, 40)]
    edges = [(i, k + 1, *map(float, p), *map(float, ps[(k + 1) % len(ps)])) for i, ps in enumerate(at) for k, p in enumerate(ps)]
    df = spark.createDataFrame(edges, f"ring long, seq int, {XY}")
    got = {}
    for size in (0, S.SMALL_RING, 99):
        monkeypatch.setattr(S, "SMALL_RING", size)
        got[size] = rows(S.ring_faults(df, "ring", 2.0), "ring", "a_seq", "b_seq", "kind")
    assert got[0] == got[32] == got[99] and len(got[0]) > 100


def test_boxes_of_lines_take_no_order(spark, sf):
    v = V.v_line(spark, sf).groupBy("line_id").agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat"))
    boxes = V.line_boxes(spark, sf)
    assert rows(boxes, *boxes.columns) == sorted(map(tuple, v.collect()))


def plain_km(px, py, x1, y1, x2, y2):
    k = math.cos(math.radians(py)) * 111.32
    ax, ay, bx, by = (x1 - px) * k, (y1 - py) * 110.574, (x2 - px) * k, (y2 - py) * 110.574
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, -(ax * dx + ay * dy) / n)) if n else 0.0
    return math.hypot(ax + t * dx, ay + t * dy)


def test_passes_wait_in_no_aggregation(spark, monkeypatch, capsys):
    """Lines that end between batches, places and gates with several keys, more targets than a task holds at once: as by
    plain search; and no pair of a line and a target is grouped or shuffled."""
    rng = random.Random(4)
    spot = lambda: (rng.randint(0, 80) / 20, 40 + rng.randint(0, 60) / 20)
    lines = {i: [spot() for _ in range(rng.randint(2, 6))] for i in range(40)}
    sites = [(i, *spot()) for i in range(60)]
    sites += [(100 + i, lon, lat) for i, lon, lat in sites[:10]] + [(999, None, 41.0)]
    gates = [(i, lon, lat, lon, lat + 0.5) for i, lon, lat in sites if i % 4 == 1]
    segs = [(i, j + 1, *a, *b) for i, v in lines.items() for j, (a, b) in enumerate(zip(v, v[1:]))]
    islands = [(5, 1.0, 41.0, 1.5, 41.0), (5, 1.5, 41.0, 1.5, 41.6), (7, 3.0, 42.0, 3.0, 42.5)]
    frames = [spark.createDataFrame(segs, "line_id long, seq int, " + XY), spark.createDataFrame(sites, "id long, lon double, lat double"), spark.createDataFrame(islands, "key long, " + XY), spark.createDataFrame(gates, "key long, " + XY)]
    want = {}
    for i, j, *s in segs:
        for k, lon, lat in sites:
            if lon is not None and plain_km(lon, lat, *s) <= 5:
                want.setdefault((i, "point", k), j)
        for k, x, y, _, top in gates:
            if min(s[0], s[2]) <= x <= max(s[0], s[2]) and s[0] != s[2]:
                my = lambda lat: math.log(math.tan(math.radians(lat) / 2 + math.pi / 4))
                at = my(s[1]) + (my(s[3]) - my(s[1])) * (x - s[0]) / (s[2] - s[0])
                if my(y) - 1e-12 <= at <= my(top) + 1e-12:
                    want.setdefault((i, "gate", k), j)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = A.passes(*frames)
        rows = {(r.line_id, r.kind, r.key): r["at"] for r in got.collect()}
        assert len(rows) == got.count()
        assert {k: v for k, v in rows.items() if k[1] != "island"} == want and len(want) > 100
        by_shore = A._beside(A.projected(frames[0]), A.projected(frames[2]), ["line_id", "seq"], 10.0).groupBy("line_id", "key").agg(F.min("seq").alias("at"))
        assert {(k[0], k[2]): v for k, v in rows.items() if k[1] == "island"} == {(r.line_id, r.key): r["at"] for r in by_shore.collect()}
        got.explain()
        assert "Aggregate" not in capsys.readouterr().out
        monkeypatch.setattr(A, "TARGETS", 20)
        assert {(r.line_id, r.kind, r.key): r["at"] for r in A.passes(*frames).collect()} == rows
        assert A.passes(frames[0], *[f.limit(0) for f in frames[1:]]).count() == 0 and A.passes(frames[0].limit(0), *frames[1:]).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_repeated_items_are_one_vertex(spark, tmp_path, capsys):
    rows = [(1, 2, 10, 20, 5.0), (1, 1, 10, 20, 5.0), (1, 2, 10, 20, 5.0), (1, 2, 10, 20, 6.0), (2, 1, 7, 8, None), (2, 1, 7, 8, None), (2, 1, 7, 8, 0.0), (2, 1, 7, 8, -0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    line = V.v_line(spark, str(tmp_path))
    assert sorted((r.line_id, r.seq) for r in line.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    S.segments(line).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
