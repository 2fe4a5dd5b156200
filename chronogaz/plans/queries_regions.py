"""Regions: overlap, equal distance, leftovers, permitted inputs, frontiers, label points, the acceptance report."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronogaz.functions import geo
from chronogaz.operators import regions as R
from chronogaz.operators import rules, voronoi
from chronogaz.operators import spatial as S
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

_RECT = "(SELECT area_id, min(least(x1, x2)) + {dx} AS w, max(greatest(x1, x2)) + {dx} AS e, min(least(y1, y2)) + {dy} AS s, max(greatest(y1, y2)) + {dy} AS n FROM v_edge GROUP BY 1)"
_OVER = f"SELECT a.area_id AS area_a, b.area_id AS area_b, radians(least(a.e, b.e) - greatest(a.w, b.w)) * (sin(radians(least(a.n, b.n))) - sin(radians(greatest(a.s, b.s)))) * 6371.0088e0 * 6371.0088e0 AS km2 FROM {_RECT.format(dx='0e0', dy='0e0')} a JOIN {_RECT.format(dx='3.24e0', dy='1.16e0')} b ON least(a.e, b.e) - greatest(a.w, b.w) > 1e-9 AND least(a.n, b.n) - greatest(a.s, b.s) > 1e-9"


def _edges(spark, sf):
    return V.v_edge(spark, sf).select("area_id", "seq", "x1", "y1", "x2", "y2")


def _overlaps(spark, sf, levels=R.LEVELS):
    e = _edges(spark, sf)
    moved = e.select("area_id", *[(F.col(c) + (3.24 if c[0] == "x" else 1.16)).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return R.overlaps_km2(R.refined_cover(e, levels=levels), R.refined_cover(moved, levels=levels), levels=levels)


@query(f"SELECT area_a, area_b, floor(km2 + 0.5e0)::BIGINT AS km2 FROM ({_OVER})", ("v_edge",))
def spa8_overlap(spark, sf):
    """Square kilometres that areas share with the same areas moved: cells refined along borders to 0.008 degrees (about
    0.7 square kilometres). The areas are rectangles, so the twin has a closed form."""
    return _overlaps(spark, sf).select("area_a", "area_b", F.floor(F.col("km2") + 0.5).cast("long").alias("km2"))


_IN_, _OUT, _PHI = [(10.0, 35.0), (22.0, 41.0)], (31.0, 30.0), math.cos(math.radians(36))


def _gap(x: str, y: str, a: tuple[float, float]) -> str:
    d2 = lambda p: f"(pow(({x} - {p[0]}e0) * {_PHI!r}e0, 2) + pow({y} - {p[1]}e0, 2))"
    return f"({d2(_OUT)} - {d2(a)})"


def _root(a, other) -> str:
    t = f"({_gap('x1', 'y1', a)} / nullif({_gap('x1', 'y1', a)} - {_gap('x2', 'y2', a)}, 0))"
    x, y = f"(x1 + {t} * (x2 - x1))", f"(y1 + {t} * (y2 - y1))"
    return f"SELECT line_id, seq, {t} AS t, {x} AS x, {y} AS y FROM v_seg WHERE {t} BETWEEN 0 AND 1 AND {_gap(x, y, other)} <= 0"


@query(f"SELECT line_id, seq::BIGINT AS seq, floor(t * 1e6 + 0.5e0)::BIGINT AS t, floor(x * 1e5 + 0.5e0)::BIGINT AS x, floor(y * 1e5 + 0.5e0)::BIGINT AS y FROM ({_root(*_IN_)} UNION ALL {_root(*_IN_[::-1])})", ("v_seg",))
def spa14_equidistant_points(spark, sf):
    """Where lines are as far from the outside anchor as from the nearest of two inside ones."""
    p = R.equidistant(S.segments(V.v_line(spark, sf)), _IN_, _OUT, _PHI)
    return p.select("line_id", F.col("seq").cast("long").alias("seq"), geo.scaled(F.col("t"), 1e6).alias("t"), geo.scaled(F.col("x"), 1e5).alias("x"), geo.scaled(F.col("y"), 1e5).alias("y"))


_IN = "SELECT p.id, e.area_id FROM v_site p JOIN v_edge e ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) {where} GROUP BY 1, 2 HAVING count(*) % 2 = 1"


@query(f""", smp AS (SELECT area_id AS piece, seq, k, x1 + k / n * (x2 - x1) AS lon, y1 + k / n * (y2 - y1) AS lat FROM (SELECT *, unnest(range(0, n::BIGINT)) AS k FROM (SELECT *, greatest(1, ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 0.25e0)) AS n FROM v_edge WHERE area_id % 3 = 0))),
sh AS (SELECT piece, area_id AS other, count(*) AS n FROM (SELECT DISTINCT piece, s.seq, k, area_id FROM smp s JOIN v_edge e ON area_id % 3 <> 0 AND {V.seg('s.lon', 's.lat')} <= 5) GROUP BY 1, 2),
bs AS (SELECT *, lead(n) OVER w AS second, row_number() OVER w AS place FROM sh WINDOW w AS (PARTITION BY piece ORDER BY n DESC, other)),
held AS ({_IN.format(where="WHERE area_id % 3 = 0 AND p.id % 20 = 7")}),
mark(piece) AS (SELECT DISTINCT area_id FROM held UNION SELECT b.area_id FROM mark m JOIN v_edge a ON a.area_id = m.piece JOIN v_edge b ON b.area_id % 3 = 0 AND a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1)
SELECT piece, CASE WHEN status = 'given' THEN other END AS area_id, status FROM (SELECT p.piece, other, CASE WHEN m.piece IS NOT NULL THEN 'unlisted' WHEN n IS NULL THEN 'island' WHEN second > n * 0.33e0 THEN 'ambiguous' ELSE 'given' END AS status
FROM (SELECT n_nationkey AS piece FROM nation WHERE n_nationkey % 3 = 0) p LEFT JOIN (SELECT DISTINCT piece FROM mark) m USING (piece) LEFT JOIN (SELECT * FROM bs WHERE place = 1) b USING (piece))""", ("v_edge", "v_site"))
def spa27_leftover_pieces(spark, sf):
    """Every third area as a leftover piece: unlisted, given to its one neighbour, or ambiguous."""
    e = _edges(spark, sf)
    pieces = V.read(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("area_id"))
    return R.leftovers(e, pieces, V.v_site(spark, sf).where("id % 20 = 7"), 0.25, 5.0)




@query(f""", src AS (SELECT 'area-edge' AS kind, NULL::BIGINT AS owner, 60 AS tol, x1, y1, x2, y2 FROM v_edge UNION ALL SELECT 'road-slice', road_id, 40, x1, y1, x2, y2 FROM v_rseg WHERE road_id % 3 = 1 UNION ALL SELECT 'anchor', NULL, 50, lon, lat, lon, lat FROM v_site),
vx AS (SELECT road_id, seq, lon, lat, CASE road_id % 3 WHEN 0 THEN 'area-edge' WHEN 1 THEN 'road-slice' ELSE 'anchor' END AS kind FROM v_road),
d AS (SELECT p.road_id, p.seq, p.kind, any_value(tol) AS tol, min({V.seg('p.lon', 'p.lat')}) FILTER (owner IS NULL OR owner <> p.road_id) AS km FROM vx p JOIN src s ON s.kind = p.kind GROUP BY 1, 2, 3),
w AS (SELECT road_id, kind, any_value(tol) AS tol, CASE WHEN max(km) <= 2 * any_value(tol) THEN max(km) END AS worst FROM d GROUP BY 1, 2)
SELECT road_id, kind, floor(worst * 1000 + 0.5e0)::BIGINT AS worst_m, coalesce(worst <= tol, false) AS ok FROM w""", ("v_edge", "v_road", "v_rseg", "v_site"))
def spa31_permitted_inputs(spark, sf):
    """Roads of three kinds, each against its declared source and tolerance."""
    road, k = V.v_road(spark, sf), F.col("road_id") % 3
    kinds = road.withColumn("kind", F.when(k == 0, "area-edge").when(k == 1, "road-slice").otherwise("anchor"))
    none = F.lit(None).cast("long").alias("owner")
    point = V.v_site(spark, sf).select(none, F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    own = S.segments(road, "road_id").where("road_id % 3 = 1").select(F.col("road_id").alias("owner"), "x1", "y1", "x2", "y2")
    edge = _edges(spark, sf).select(none, "x1", "y1", "x2", "y2")
    out = R.permitted(kinds, "road_id", {"area-edge": (edge, 60.0), "road-slice": (own, 40.0), "anchor": (point, 50.0)})
    return out.select("road_id", "kind", geo.scaled(F.col("worst_km")).alias("worst_m"), "ok")


@query(f""", fr AS (SELECT a.area_id AS area_a, a.seq, a.x1, a.y1, a.x2, a.y2 FROM v_edge a JOIN v_edge b ON a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1 WHERE a.holder < 2 AND b.holder >= 2),
smp AS (SELECT area_a, seq, k, x1 + k / n * (x2 - x1) AS lon, y1 + k / n * (y2 - y1) AS lat FROM (SELECT *, unnest(range(0, n::BIGINT)) AS k FROM (SELECT *, greatest(1, ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / {0.2 / 111.32!r}e0)) AS n FROM fr))),
bd AS (SELECT s.*, sqrt(pow((lon - 14) * cos(radians(32e0)) * 111.32e0, 2) + pow((lat - 32) * 110.574e0, 2)) <= 1 AS skipped FROM smp s WHERE EXISTS (SELECT 1 FROM v_rseg WHERE {V.seg('s.lon', 's.lat')} <= 5)),
ol AS (SELECT x1 + 0.02e0 * (1 + seq % 3) AS x1, y1, x2 + 0.02e0 * (1 + seq % 3) AS x2, y2 FROM v_edge WHERE holder = 2),
g AS (SELECT s.area_a, s.seq, s.k, min({V.seg('s.lon', 's.lat')}) AS km FROM bd s, ol WHERE NOT skipped GROUP BY 1, 2, 3)
SELECT area_a, count(*)::BIGINT AS n_samples, count(*) FILTER (skipped)::BIGINT AS n_skipped, floor(max(km) * 1000 + 0.5e0)::BIGINT AS gap_m FROM bd LEFT JOIN g USING (area_a, seq, k) GROUP BY 1""", ("v_edge", "v_rseg"))
def spa29_frontier_gap(spark, sf):
    """The largest gap between a frontier, every 0.2 km of it that has a road within 5 km, and an outline drawn beside it."""
    e = V.v_edge(spark, sf)
    b = e.where("holder >= 2").select(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    frontier = e.where("holder < 2").select(F.col("area_id").alias("area_a"), "seq", "x1", "y1", "x2", "y2").join(b, ["x1", "y1", "x2", "y2"], "left_semi")
    off = 0.02 * (1 + F.col("seq") % 3)
    outline = e.where("holder = 2").select((F.col("x1") + off).alias("x1"), "y1", (F.col("x2") + off).alias("x2"), "y2")
    g = R.frontier_gap(frontier, S.segments(V.v_road(spark, sf), "road_id").select("x1", "y1", "x2", "y2"), outline, (14.0, 32.0))
    return g.select("area_a", "n_samples", "n_skipped", geo.scaled(F.col("gap_km")).alias("gap_m"))


@query()
def spa11_label_points(spark, sf):
    """The best label point of each area away from its sites. No twin: tests hold it against a loop on a few areas."""
    labels = V.read(spark, sf, "nation").select(F.col("n_nationkey").alias("area_id"), (F.length("n_name") * 7.0).alias("width_px"), F.lit(2).alias("n_lines"))
    return R.label_points(_edges(spark, sf), labels, V.v_site(spark, sf))


@query(f", over AS ({_OVER}), inside AS ({_IN.format(where='')})" + f""", near AS (SELECT p.id, e.area_id FROM v_site p JOIN v_edge e ON e.area_id = p.id % 25 GROUP BY 1, 2 HAVING min({V.seg('p.lon', 'p.lat')}) <= 3)
SELECT 'overlap' AS rule_id, 'error' AS severity, area_a || '-' || area_b AS path, floor(km2 + 0.5e0)::BIGINT || ' km2 shared' AS message FROM over WHERE km2 > 1 AND area_a <> area_b
UNION ALL SELECT 'place', 'error', p.id::VARCHAR, 'outside area ' || p.id % 25 FROM v_site p WHERE p.id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.id = p.id AND i.area_id = p.id % 25) AND NOT EXISTS (SELECT 1 FROM near n WHERE n.id = p.id)
UNION ALL SELECT 'anchor', 'error', p.id::VARCHAR, 'lies in ' || coalesce((SELECT string_agg(i.area_id::VARCHAR, ',' ORDER BY i.area_id) FROM inside i WHERE i.id = p.id), 'no area') FROM v_site p WHERE p.id % 10 = 3 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.id = p.id AND i.area_id % 2 = 0)
UNION ALL SELECT 'not-built', 'error', n_nationkey::VARCHAR, 'area not built' FROM nation WHERE n_nationkey % 8 = 5""", ("v_edge", "v_site"))
def spa10_acceptance_report(spark, sf):
    """One failure list: overlaps of over a square kilometre, places outside the area that they name (but for explained
    ones), anchors in no area of the expected kind, areas expected and not built."""
    e = _edges(spark, sf)
    site = V.v_site(spark, sf)
    over = _overlaps(spark, sf, 3).where("km2 > 1 and area_a <> area_b")
    flat = e.select("area_id", "x1", "y1", "x2", "y2")
    inside = S.containing(site, flat)
    named = site.select("id", (F.col("id") % 25).cast("int").alias("area_id"))
    near = S.nearest_edge(site, flat, 3.0, ["area_id"]).select("id", F.col("area_id").cast("int").alias("area_id"))
    lost = named.where("id % 7 <> 0").join(inside.select("id", F.col("area_id").cast("int").alias("area_id")), ["id", "area_id"], "left_anti").join(near, ["id", "area_id"], "left_anti")
    wrong = site.select("id").where("id % 10 = 3").join(inside, "id", "left").groupBy("id").agg(F.array_sort(F.collect_list("area_id")).alias("in"), F.max(F.coalesce((F.col("area_id") % 2 == 0).cast("int"), F.lit(0))).alias("ok")).where("ok = 0")
    where = F.when(F.size("in") > 0, F.array_join(F.transform("in", lambda a: a.cast("string")), ",")).otherwise("no area")
    missing = V.read(spark, sf, "nation").where("n_nationkey % 8 = 5")
    return rules.report(
        rules.violation(over, "overlap", F.concat_ws("-", "area_a", "area_b"), F.concat(F.floor(F.col("km2") + 0.5).cast("string"), F.lit(" km2 shared"))),
        rules.violation(lost, "place", F.col("id"), F.concat(F.lit("outside area "), F.col("area_id").cast("string"))),
        rules.violation(wrong, "anchor", F.col("id"), F.concat(F.lit("lies in "), where)),
        rules.violation(missing, "not-built", F.col("n_nationkey"), F.lit("area not built")),
    )


_KX = "cos(radians(35e0))"
_VOR = f""", sd AS (SELECT min(id) AS id, x, y FROM (SELECT id, lon * {_KX} AS x, lat AS y FROM v_site) GROUP BY x, y),
pr AS (SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, a.y - b.y AS dx, b.x - a.x AS dy FROM sd a JOIN sd b ON a.id < b.id),
ct AS (SELECT a, b, ax, ay, mx, my, dx, dy, 2 * (dx * (c.x - ax) + dy * (c.y - ay)) AS k, c.x * c.x + c.y * c.y - ax * ax - ay * ay - 2 * (mx * (c.x - ax) + my * (c.y - ay)) AS room FROM pr JOIN sd c ON c.id <> a AND c.id <> b
UNION ALL SELECT *, dx, 50 * {_KX} - mx FROM pr UNION ALL SELECT *, -dx, mx + 10 * {_KX} FROM pr UNION ALL SELECT *, dy, 50 - my FROM pr UNION ALL SELECT *, -dy, my - 20 FROM pr),
iv AS (SELECT a, b, any_value(mx) AS mx, any_value(my) AS my, any_value(dx) AS dx, any_value(dy) AS dy, max(room / k) FILTER (k < 0) AS t0, min(room / k) FILTER (k > 0) AS t1, bool_or(k = 0 AND room < 0) AS off FROM ct GROUP BY 1, 2)"""


@query(_VOR + " SELECT a, b, floor((mx + dx * t0) * 1000 + 0.5e0)::BIGINT AS x1, floor((my + dy * t0) * 1000 + 0.5e0)::BIGINT AS y1, floor((mx + dx * t1) * 1000 + 0.5e0)::BIGINT AS x2, floor((my + dy * t1) * 1000 + 0.5e0)::BIGINT AS y2 FROM iv WHERE NOT off AND t1 - t0 > 1e-9", ("v_site",))
def spa13_bisectors(spark, sf):
    """The lines that part the areas nearest to each site, on the plane about 35 degrees north."""
    kx = F.cos(F.radians(F.lit(35.0)))
    seeds = V.v_site(spark, sf).select("id", (F.col("lon") * kx).alias("x"), F.col("lat").alias("y"))
    k = math.cos(math.radians(35.0))
    lines = voronoi.bisectors(seeds, (-10 * k, 20.0, 50 * k, 50.0))
    return lines.select("a", "b", *[geo.scaled(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])
