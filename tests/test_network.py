"""Line operators against loops over small lists."""

import math

from pyspark.sql import functions as F

from chronogaz.operators import audit, network, spatial
from chronogaz.plans import registry


def test_gap_joins_equal_the_choice_in_order(spark, sf):
    q = registry.QUERIES["spa22_gap_candidates"](spark, sf.replace("0.001", "0.01")).collect()
    rows = [(r.road_id, r.side, r.source, r.target, r.to_end, float(r.m)) for r in q]
    # chains of candidates that hold each other's ends, so that choices depend on choices
    rows += [(9000 + i, "start", f"p{i:02d}", f"p{i + 1:02d}", True, 1.0 + (i * 7 % 5)) for i in range(12)] + [(9100, "end", "p03", "x", False, 0.5), (9101, "end", "q", "p05", True, 0.1)]
    taken, held = set(), set()
    for r in sorted(rows, key=lambda r: (not r[4], r[2], r[5], r[3])):
        ends = {r[2], r[3]} if r[4] else {r[2]}
        if not ends & held:
            held |= ends
            taken.add(r[:4])
    df = spark.createDataFrame(rows, "road_id long, side string, source string, target string, to_end boolean, km double")
    got = {(r.road_id, r.side, r.source, r.target) for r in network.accepted_joins(df).collect()}
    assert got == taken and len(taken) < len(rows)
    assert network.accepted_joins(df.limit(0)).count() == 0


def test_chains(spark):
    ways = [(1, 10, 11, 6), (2, 12, 11, 6), (3, 12, 13, 3), (4, 20, 21, 2), (5, 30, 31, 5), (6, 31, 32, 5), (7, 32, 30, 5), (8, 40, 41, 9), (9, 41, 42, 9), (10, 41, 43, 12), (11, 50, 50, 20)]
    got = network.chains(spark.createDataFrame(ways, "way_id long, start long, end long, n_vertices long"), 10).orderBy("chain", "pos").collect()
    rows = [(r.chain, r.pos, r.way_id, r.reversed, r.vertices) for r in got]
    assert rows[:3] == [(1, 1, 1, False, 13), (1, 2, 2, True, 13), (1, 3, 3, False, 13)]
    ring = [r for r in rows if r[0] == 5]
    assert len(ring) == 3 and {r[4] for r in ring} == {13} and [r[1] for r in ring] == [1, 2, 3]
    assert {r[0] for r in rows} == {1, 5, 10, 11}  # three ends meet at 41; way 4 is too short, 8 and 9 as well


def test_stitched(spark):
    lines = {1: [(0, 0), (1, 0)], 2: [(2.2, 0), (1.1, 0)], 3: [(2.3, 0.1), (3, 0)], 4: [(-0.1, 0.1), (-1, 0)], 5: [(9, 9), (8, 8)]}
    df = spark.createDataFrame([("n", k, i, float(x), float(y)) for k, ps in lines.items() for i, (x, y) in enumerate(ps)], "name string, line_id long, seq int, lon double, lat double")
    anchor = spark.createDataFrame([("n", 0.9, 0.0)], "name string, lon double, lat double")
    got = [(r.line_id, r.reversed) for r in network.stitched(df, anchor, "name", "line_id").orderBy("pos").collect()]
    assert got == [(3, True), (2, False), (1, True), (4, False)] or got == [(4, True), (1, False), (2, True), (3, False)]


def test_line_over_an_island(spark):
    """A line by sea that crosses an island in the middle and ends on land, and one by land over a lake."""
    box = lambda a, kind, x, y, w: [(a, kind, *p, *q) for p, q in zip([(x, y), (x + w, y), (x + w, y + w), (x, y + w)], [(x + w, y), (x + w, y + w), (x, y + w), (x, y)])]
    shores = audit.projected(spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in box(1, "land", 2, 0, 1) + box(2, "land", 5, 0, 9) + box(3, "lake", 7, 0.2, 0.3)], "area_id int, kind string, x1 double, y1 double, x2 double, y2 double"))
    segs = spark.createDataFrame([(1, 1, 0.0, 0.3, 1.0, 0.3), (1, 2, 1.0, 0.3, 5.01, 0.3), (2, 1, 6.0, 0.3, 8.0, 0.3), (3, 1, 0.0, 9.0, 1.0, 9.0)], "line_id long, seq int, x1 double, y1 double, x2 double, y2 double")
    stage = [(1, "sea", "sea", 0.0, 0.0, 1000.0, False, False), (2, "land", "road", 0.0, 3.0, 0.0, False, True), (3, "unknown", "unknown", 0.0, 0.0, 0.0, False, False)]
    stages = spark.createDataFrame(stage, "line_id long, mode string, method string, from_off_m double, to_off_m double, baseline_km double, reason boolean, recorded boolean")
    got = {r.line_id: r for r in audit.audit(audit.projected(segs), shores, stages).collect()}
    degree = math.pi * 6371.0088 / 180 * math.cos(math.radians(0.3))
    assert math.isclose(got[1].crossing_km, degree, rel_tol=1e-6) and math.isclose(got[1].end_km, 0.01 * degree, rel_tol=1e-6) and got[1].start_km == 0
    assert got[1].failures == ["crosses land", "end: connector not recorded"]
    assert math.isclose(got[2].crossing_km, 0.3 * degree, rel_tol=1e-6) and got[2].failures == ["ends off its stop", "crosses water"] and got[3].failures == []
    none = audit.audit(audit.projected(segs).limit(0), shores, stages)
    assert none.count() == 0


def test_passed_cells_of_a_segment(spark):
    rows = [(0.5, 0.5, 3.5, 1.2), (2.5, 0.1, 2.5, 3.9), (1.0, 1.0, 1.0, 1.0), (3.9, 0.1, 0.1, 3.9)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    got = {(r.x1, r.y1, r._cx, r._cy) for r in spatial.passed_cells(df, 1.0).collect()}
    want = {(a, b, math.floor(a + (c - a) * k / 9999), math.floor(b + (d - b) * k / 9999)) for a, b, c, d in rows for k in range(10000)}
    assert want <= got and len(got) <= len(want) + 8
    near = spatial.nearest_edge(spark.createDataFrame([(1, 2.0, 2.4)], "id int, lon double, lat double"), df, 60.0, []).withColumn("km", F.round("km", 3)).collect()
    assert len(near) == 1
