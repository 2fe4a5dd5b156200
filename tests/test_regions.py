"""Region operators against loops over a few areas."""

import math

from pyspark.sql import functions as F

from chronogaz.operators import regions
from chronogaz.plans import registry


def square(a, x, y, w):
    ps = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    return [(a, i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(ps, ps[1:] + ps[:1]))]


EDGE = "area_id int, seq int, x1 double, y1 double, x2 double, y2 double"


def test_refined_cover_measures_a_triangle(spark):
    ps = [(0.013, 0.007), (3.1, 0.2), (0.4, 2.9)]
    tri = [(1, i, *p, *q) for i, (p, q) in enumerate(zip(ps, ps[1:] + ps[:1]))]
    planar = abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(ps, ps[1:] + ps[:1]))) / 2
    cover = regions.refined_cover(spark.createDataFrame(tri, EDGE), levels=3)
    km2 = cover.agg(F.sum(regions.cell_km2(F.col("level").cast("double"), F.col("cy")))).first()[0]
    want = planar * (math.pi * 6371.0088 / 180) ** 2
    assert abs(km2 / want - 1) < 0.005 and cover.select("level").distinct().count() == 2
    assert regions.refined_cover(spark.createDataFrame([], EDGE)).count() == 0


def test_label_point_equals_the_loop(spark):
    edges = square(1, 0, 0, 4) + square(2, 10, 10, 1)
    pins = [(1, 2.0, 2.0), (2, 1.0, 3.0)]
    labels = spark.createDataFrame([(1, 80.0, 2), (2, 80.0, 2)], "area_id int, width_px double, n_lines int")
    got = {r.area_id: r for r in regions.label_points(spark.createDataFrame(edges, EDGE), labels, spark.createDataFrame(pins, "id int, lon double, lat double"), grid=8).collect()}

    def px(lon, lat):
        world = 256 * 2**8
        return (lon / 360 + 0.5) * world, (0.5 - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) / (2 * math.pi)) * world

    def best(x, y, w, own):
        rows = []
        (l, b), (r, t) = px(x, y), px(x + w, y + w)
        for i in range(8):
            for j in range(8):
                lon, lat = x + (i + 0.5) / 8 * w, y + (j + 0.5) / 8 * w
                p = px(lon, lat)
                edge = min(p[0] - l, r - p[0], b - p[1], p[1] - t)
                pin = min((math.dist(p, px(*q)) for q in own), default=math.inf)
                half = 80 / 2 + 4, 2 * 14 / 2 + 4
                zoom = next((z for z in range(4, 10) if all(l < p[0] + a * half[0] * 2 ** (8 - z) < r and t < p[1] + c * half[1] * 2 ** (8 - z) < b for a in (-1, 1) for c in (-1, 1))), 10)
                rows.append((zoom, pin < 24, -pin, -round(edge, 6), lon, lat))
        return min(rows)

    for a, want in ((1, best(0, 0, 4, [(2, 2), (1, 3)])), (2, best(10, 10, 1, []))):
        assert (got[a].min_zoom, got[a].lon, got[a].lat) == (want[0], want[4], want[5])


def test_acceptance_report_names_each_rule(spark, sf):
    rows = registry.QUERIES["spa10_acceptance_report"](spark, sf).groupBy("rule_id").count().collect()
    assert {r.rule_id for r in rows} >= {"overlap", "place", "not-built"}
