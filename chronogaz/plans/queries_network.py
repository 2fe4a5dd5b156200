"""Roads and ways that meet: rays, loose ends, gaps, intersections, slices, chains, stitches; plane and sphere distances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogaz.functions import geo
from chronogaz.operators import audit as A
from chronogaz.operators import network as N
from chronogaz.operators import spatial as S
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

VIEWS = ("v_rend", "v_rseg")


def _roads(spark, sf):
    """(ends, segments) of the roads."""
    r = V.v_road(spark, sf)
    return N.line_ends(r, "road_id"), S.segments(r, "road_id")


_RAY = """, ray AS (SELECT *, dx / n AS rx, dy / n AS ry FROM (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM (SELECT *, (lon - before_lon) * k AS dx, (lat - before_lat) * 110.574e0 AS dy FROM (SELECT *, cos(radians(lat)) * 111.32e0 AS k FROM v_rend))) WHERE n > 0),
pq AS (SELECT r.*, s.road_id AS target, s.seq AS target_seq, s.x1, s.y1, s.x2, s.y2, (s.x1 - lon) * k AS px, (s.y1 - lat) * 110.574e0 AS py, (s.x2 - s.x1) * k AS ex, (s.y2 - s.y1) * 110.574e0 AS ey FROM ray r JOIN v_rseg s ON s.road_id <> r.road_id AND abs(s.x1 - lon) < 1.5e0 AND abs(s.y1 - lat) < 1.5e0),
hit AS (SELECT *, (px * ey - py * ex) / (rx * ey - ry * ex) AS km, (px * ry - py * rx) / (rx * ey - ry * ex) AS u FROM pq WHERE abs(rx * ey - ry * ex) >= 1e-9),
best AS (SELECT * FROM hit WHERE km > 0 AND km <= 30 AND u BETWEEN 0 AND 1 QUALIFY row_number() OVER (PARTITION BY road_id, side ORDER BY km, target, target_seq) = 1)"""


@query(_RAY + " SELECT road_id, side, target, target_seq::BIGINT AS target_seq, floor(km * 1000 + 0.5e0)::BIGINT AS m, floor((x1 + u * (x2 - x1)) * 1e5 + 0.5e0)::BIGINT AS hit_x, floor((y1 + u * (y2 - y1)) * 1e5 + 0.5e0)::BIGINT AS hit_y FROM best", VIEWS)
def jon27_ray_to_segment(spark, sf):
    """Where a road, carried on in its last direction, meets another within 30 km."""
    h = N.ray_hits(*_roads(spark, sf), "road_id")
    return h.select("road_id", "side", "target", F.col("target_seq").cast("long").alias("target_seq"), geo.scaled(F.col("km")).alias("m"), geo.scaled(F.col("hit_lon"), 1e5).alias("hit_x"), geo.scaled(F.col("hit_lat"), 1e5).alias("hit_y"))


_LOOSE = f"SELECT road_id, side FROM v_rend e WHERE NOT EXISTS (SELECT 1 FROM v_rseg s WHERE s.road_id <> e.road_id AND {V.seg('e.lon', 'e.lat')} <= 0.1e0)"


@query(_RAY + f" SELECT l.road_id, l.side, target, floor(km * 1000 + 0.5e0)::BIGINT AS m FROM ({_LOOSE}) l LEFT JOIN best USING (road_id, side)", VIEWS)
def spa23_dangling_ends(spark, sf):
    """Ends with no other road within a tenth of a kilometre, each with the road that it reaches if carried on 30 km."""
    ends, segs = _roads(spark, sf)
    loose = N.loose_ends(ends, segs, "road_id")
    return loose.join(N.ray_hits(loose, segs, "road_id"), ["road_id", "side"], "left").select("road_id", "side", "target", geo.scaled(F.col("km")).alias("m"))


_SIX = "floor({} * 1e6 + 0.5e0)::BIGINT || ',' || floor({} * 1e6 + 0.5e0)::BIGINT"


@query(f""", nr AS (SELECT *, {V.hav('lon', 'lat', 'fx', 'fy')} AS foot_km FROM (SELECT e.road_id, e.side, e.lon, e.lat, s.road_id AS other, s.seq, x1 + {V.seg_t('e.lon', 'e.lat')} * (x2 - x1) AS fx, y1 + {V.seg_t('e.lon', 'e.lat')} * (y2 - y1) AS fy FROM v_rend e JOIN v_rseg s ON s.road_id <> e.road_id AND {V.seg('e.lon', 'e.lat')} <= 4.2e0)),
b AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY road_id, side ORDER BY foot_km, other, seq) = 1),
p AS (SELECT b.*, e.lon AS ex, e.lat AS ey, {V.hav('b.fx', 'b.fy', 'e.lon', 'e.lat')} AS end_km FROM b JOIN v_rend e ON e.road_id = b.other WHERE foot_km > 0.2e0 AND foot_km <= 4 QUALIFY row_number() OVER (PARTITION BY b.road_id, b.side ORDER BY {V.hav('b.fx', 'b.fy', 'e.lon', 'e.lat')}, e.side DESC) = 1),
c AS (SELECT *, CASE WHEN end_km <= 0.2e0 THEN ex ELSE fx END AS tx, CASE WHEN end_km <= 0.2e0 THEN ey ELSE fy END AS ty FROM p)
SELECT road_id, side, {_SIX.format('lon', 'lat')} AS source, {_SIX.format('tx', 'ty')} AS target, end_km <= 0.2e0 AS to_end, floor({V.hav('lon', 'lat', 'tx', 'ty')} * 1000 + 0.5e0)::BIGINT AS m FROM c WHERE {V.hav('lon', 'lat', 'tx', 'ty')} > 0.2e0 AND {V.hav('lon', 'lat', 'tx', 'ty')} <= 4""", VIEWS)
def spa22_gap_candidates(spark, sf):
    """For each road end the way to the nearest other road, 0.2 to 4 km off; to its end where that is next to the foot."""
    c = N.gap_candidates(*_roads(spark, sf), "road_id")
    return c.select("road_id", "side", "source", "target", "to_end", geo.scaled(F.col("km")).alias("m"))


@query()
def spa22_gap_joins(spark, sf):
    """The joins accepted in order, no end twice. No twin: each choice rests on those before; tests hold it against a loop."""
    return N.accepted_joins(N.gap_candidates(*_roads(spark, sf), "road_id")).select("road_id", "side", "source", "target", "to_end", "km")


_DEN = "nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0)"
_T = f"(((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / {_DEN})"
_U = f"(((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / {_DEN})"


@query(f"SELECT a.road_id AS a, a.seq AS a_seq, b.road_id AS b, b.seq AS b_seq, floor((a.x1 + {_T} * (a.x2 - a.x1)) * 1e5 + 0.5e0)::BIGINT AS x, floor((a.y1 + {_T} * (a.y2 - a.y1)) * 1e5 + 0.5e0)::BIGINT AS y FROM v_rseg a JOIN v_rseg b ON a.road_id < b.road_id AND {_T} BETWEEN 0 AND 1 AND {_U} BETWEEN 0 AND 1", VIEWS)
def spa30_intersections(spark, sf):
    """Where two roads cross or touch."""
    segs = _roads(spark, sf)[1]
    x = N.crossings_of_lines(segs, "road_id", 0.25)
    at = lambda c: geo.scaled(F.col(c), 1e5).alias(c)
    return x.select("a", F.col("a_seq").cast("long").alias("a_seq"), "b", F.col("b_seq").cast("long").alias("b_seq"), at("x"), at("y"))


_FOOT = ", {n} AS (SELECT * FROM (SELECT s.*, t, x1 + t * (x2 - x1) AS fx, y1 + t * (y2 - y1) AS fy, px, py FROM (SELECT s.*, q.lon + {dx} AS px, q.lat + {dy} AS py, {t} AS t FROM v_rseg s JOIN v_road q ON q.road_id = s.road_id AND q.seq = {v}) s) QUALIFY row_number() OVER (PARTITION BY road_id ORDER BY pow(fx - px, 2) + pow(fy - py, 2), seq) = 1)"
_ONE, _TWO = ("0.1e0", "0.05e0"), ("(-0.05e0)", "0.1e0")


@query("".join(_FOOT.format(n=n, v=v, dx=d[0], dy=d[1], t=V.seg_t(f"(q.lon + {d[0]})", f"(q.lat + {d[1]})")) for n, v, d in (("fa", 3, _ONE), ("fz", 1, _TWO))) + """, ft AS (SELECT fa.road_id, fa.seq + fa.t AS a, fa.fx AS ax, fa.fy AS ay, fz.seq + fz.t AS z, fz.fx AS zx, fz.fy AS zy FROM fa JOIN fz USING (road_id)),
vs AS (SELECT road_id, seq::DOUBLE AS pl, lon, lat, a > z AS back FROM v_road JOIN ft USING (road_id) WHERE seq > least(a, z) AND seq < greatest(a, z) UNION SELECT road_id, a, ax, ay, a > z FROM ft UNION SELECT road_id, z, zx, zy, a > z FROM ft)
SELECT road_id, row_number() OVER (PARTITION BY road_id ORDER BY CASE WHEN back THEN -pl ELSE pl END, lon, lat)::BIGINT AS pos, floor(lon * 1e5 + 0.5e0)::BIGINT AS x, floor(lat * 1e5 + 0.5e0)::BIGINT AS y FROM vs""", ("v_road", "v_rseg"))
def spa30_slices(spark, sf):
    """Each road between the feet of a point near its end and one near its start, in that direction."""
    r = V.v_road(spark, sf)
    near = lambda seq, dx, dy: r.where(F.col("seq") == seq).select("road_id", (F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    s = N.sliced(r, "road_id", near(3, 0.1, 0.05), near(1, -0.05, 0.1))
    return s.select("road_id", F.col("pos").cast("long").alias("pos"), geo.scaled(F.col("lon"), 1e5).alias("x"), geo.scaled(F.col("lat"), 1e5).alias("y"))


@query(""", c AS (SELECT way_id, way_id // 7 AS g, n_vertices FROM v_way), t AS (SELECT *, min(way_id) OVER (PARTITION BY g) AS chain, sum(n_vertices) OVER (PARTITION BY g) - count(*) OVER (PARTITION BY g) + 1 AS vertices FROM c)
SELECT chain, row_number() OVER (PARTITION BY g ORDER BY way_id)::BIGINT AS pos, way_id, way_id % 2 = 1 AS reversed, vertices::BIGINT AS vertices FROM t WHERE vertices >= 10""", ("v_way",))
def grf6_way_chains(spark, sf):
    """Ways joined at shared nodes, turned where needed, in order; chains of under ten vertices go. The twin knows the runs."""
    c = N.chains(V.v_way(spark, sf))
    return c.select("chain", F.col("pos").cast("long").alias("pos"), "way_id", "reversed", F.col("vertices").cast("long").alias("vertices"))


@query()
def grf7_stitched_roads(spark, sf):
    """Twelve roads to a name, put together by nearest ends from an anchor on. No twin: a loop by nature; tests hold one."""
    r = V.v_road(spark, sf).withColumn("name", F.floor(F.col("road_id") / 12))
    r = r.withColumns({"lon": F.col("name") % 50 + F.col("lon") / 60, "lat": F.col("name") % 25 + F.col("lat") / 60})  # a name's roads lie together
    anchors = r.groupBy("name").agg((F.floor(F.min("lon"))).cast("double").alias("lon"), (F.floor(F.min("lat"))).cast("double").alias("lat"))
    return N.stitched(r, anchors, "name", "road_id")


@query(""", s AS (SELECT line_id, seq, radians(x1 / 1000) * 6378137e0 AS x1, ln(tan(radians(y1 / 1000) / 2 + pi() / 4)) * 6378137e0 AS y1, radians(x2 / 1000) * 6378137e0 AS x2, ln(tan(radians(y2 / 1000) / 2 + pi() / 4)) * 6378137e0 AS y2, x1 / 1000 AS a, y1 / 1000 AS b, x2 / 1000 AS c, y2 / 1000 AS d FROM v_seg),
t AS (SELECT *, atan2(lag(dx) OVER w * dy - lag(dy) OVER w * dx, lag(dx) OVER w * dx + lag(dy) OVER w * dy) AS t1, atan2(dx * lead(dy) OVER w - dy * lead(dx) OVER w, dx * lead(dx) OVER w + dy * lead(dy) OVER w) AS t2 FROM (SELECT line_id, seq, x2 - x1 AS dx, y2 - y1 AS dy, sqrt(pow(radians(d - b), 2) + pow(radians(c - a) * cos(radians((b + d) / 2)), 2)) * 6371.0088e0 AS km FROM s) WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
f AS (SELECT line_id, seq, coalesce(km < 2 AND t1 * t2 < 0 AND abs(t1) > radians(20e0) AND abs(t2) > radians(20e0), false) AS step FROM t)
SELECT line_id, seq::BIGINT AS seq, coalesce(NOT lag(step) OVER w, true) AND coalesce(NOT lead(step) OVER w, true) AS single FROM f WINDOW w AS (PARTITION BY line_id ORDER BY seq) QUALIFY step""", ("v_seg",))
def win10_stair_steps(spark, sf):
    """Segments of under two kilometres between opposite turns of over 20 degrees; single without a step beside them. The
    lines are drawn at a thousandth of their size, so that such segments occur."""
    small = S.segments(V.v_line(spark, sf)).select("line_id", F.col("seq").cast("long").alias("seq"), *[(F.col(c) / 1000).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return A.stair_steps(A.projected(small))


_H, _P = V.hav("a.lon", "a.lat", "b.lon", "b.lat"), "(sqrt(pow((b.lon - a.lon) * cos(radians(a.lat)) * 111.32e0, 2) + pow((b.lat - a.lat) * 110.574e0, 2)))"
_PSI = "ln(tan(radians(b.lat) / 2 + pi() / 4) / tan(radians(a.lat) / 2 + pi() / 4))"
_R = f"(sqrt(pow(radians(b.lat) - radians(a.lat), 2) + pow(CASE WHEN abs({_PSI}) > 1e-12 THEN (radians(b.lat) - radians(a.lat)) / {_PSI} ELSE cos(radians(a.lat)) END * radians(b.lon - a.lon), 2)) * 6371.0088e0)"


@query(f"SELECT a.id, floor({_H} * 1000 + 0.5e0)::BIGINT AS great_circle, floor({_R} * 1000 + 0.5e0)::BIGINT AS rhumb, floor({_P} * 1000 + 0.5e0)::BIGINT AS plane FROM v_probe a JOIN v_site b ON b.id = a.id % 50 + 1", ("v_probe", "v_site"))
def geo1_geo2_geo4_distances(spark, sf):
    """Metres between two points along the great circle, along the rhumb line and on the local plane."""
    a, b = V.v_probe(spark, sf), V.v_site(spark, sf).select(F.col("id").alias("b"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    four = [F.col(c) for c in ("lon", "lat", "x", "y")]
    return a.join(b, F.col("b") == F.col("id") % 50 + 1).select("id", geo.scaled(geo.haversine_km(*four)).alias("great_circle"), geo.scaled(geo.rhumb_km(*four)).alias("rhumb"), geo.scaled(geo.plane_km(*four)).alias("plane"))


@query(f"SELECT p.id, road_id, seq::BIGINT AS seq, floor({V.seg('p.lon', 'p.lat')} * 1000 + 0.5e0)::BIGINT AS m, floor((x1 + {V.seg_t('p.lon', 'p.lat')} * (x2 - x1)) * 1e5 + 0.5e0)::BIGINT AS x, floor((y1 + {V.seg_t('p.lon', 'p.lat')} * (y2 - y1)) * 1e5 + 0.5e0)::BIGINT AS y FROM v_site p JOIN v_rseg ON road_id % 100 = p.id % 100", ("v_site", "v_rseg"))
def geo5_point_to_segment(spark, sf):
    """Distance of a point and a segment, and the foot point."""
    # each place and each shape is measured once; the sites and roads that share them are told apart at the end
    p = V.v_site(spark, sf).groupBy("lon", "lat", (F.col("id") % 100).alias("g")).agg(F.collect_list("id").alias("ids"))
    s = _roads(spark, sf)[1].groupBy("x1", "y1", "x2", "y2", F.col("seq").cast("long").alias("seq"), (F.col("road_id") % 100).alias("g")).agg(F.collect_list("road_id").alias("roads"))
    six = [F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")]
    t = geo.segment_t(*six)
    foot = lambda c: geo.scaled(F.col(f"{c}1") + t * (F.col(f"{c}2") - F.col(f"{c}1")), 1e5).alias(c)
    # a site's places are written, as their size lets Spark broadcast them where they are few; the shapes are dealt out
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = S.checkpointed(s).repartition(parts, "x1", "y1", "x2", "y2").join(S.checkpointed(p), "g").select("ids", "roads", "seq", geo.scaled(geo.segment_km(*six)).alias("m"), foot("x"), foot("y"))
    return met.select(F.explode("ids").alias("id"), "roads", "seq", "m", "x", "y").select("id", F.explode("roads").alias("road_id"), "seq", "m", "x", "y")


@query(f"SELECT a.line_id, a.seq::BIGINT AS seq, floor({_T} * 1e6 + 0.5e0)::BIGINT AS t FROM v_seg a JOIN v_seg b ON a.line_id = b.line_id AND b.seq = a.seq + 2 WHERE {_T} BETWEEN 0 AND 1 AND {_U} BETWEEN 0 AND 1", ("v_seg",))
def geo6_crossing_parameter(spark, sf):
    """Where on a segment the segment after the next one crosses it; both must be met inside."""
    w = Window.partitionBy("line_id").orderBy("seq")
    at = {f"p{i}": F.lead(F.struct("lon", "lat"), i).over(w) for i in range(4)}
    p = V.v_line(spark, sf).withColumns(at).where("p3 is not null")
    ends = {"a_": (0, 1), "b_": (2, 3)}
    p = p.select("line_id", "seq", *[F.col(f"p{i}.{c}").alias(f"{s}{n}{k}") for s, ii in ends.items() for k, i in enumerate(ii, 1) for c, n in (("lon", "x"), ("lat", "y"))])
    t, u = N.crossing_parameters("a_", "b_")
    return p.withColumns({"t": t, "u": u}).where("t between 0 and 1 and u between 0 and 1").select("line_id", F.col("seq").cast("long").alias("seq"), geo.scaled(F.col("t"), 1e6).alias("t"))
