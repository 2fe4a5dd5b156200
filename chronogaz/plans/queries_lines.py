"""Lines, rings and surfaces: selections, stretches, steps, crossings, contact, coverage; stops and their holders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogaz.functions import geo
from chronogaz.operators import graph as G
from chronogaz.operators import gridpath as P
from chronogaz.operators import regions as R
from chronogaz.operators import spatial as S
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

EDGE = ("area_id", "x1", "y1", "x2", "y2")


def _edges(spark, sf):
    return V.v_edge(spark, sf).select(*EDGE)


@query("""SELECT line_id, CASE WHEN line_id % 11 = 0 THEN 'excluded' ELSE 'kept' END AS outcome FROM (SELECT line_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM v_line GROUP BY 1)
WHERE line_id % 3 = 0 AND w <= 20 AND e >= 0 AND s <= 40 AND n >= 25""", ("v_line",))
def flt3_feature_selection(spark, sf):
    """Lines of an era that meet a box; those on the list of excluded ids are reported apart."""
    era = F.when(F.col("line_id") % 3 == 0, "LR").otherwise("L")
    box = V.v_line(spark, sf).groupBy("line_id").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    hit = box.where(F.contains(era, F.lit("R"))).where("w <= 20 and e >= 0 and s <= 40 and n >= 25")
    listed = V.read(spark, sf, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("line_id"), F.lit(True).alias("_x")).distinct()
    return hit.join(listed, "line_id", "left").select("line_id", F.when(F.col("_x"), "excluded").otherwise("kept").alias("outcome"))


@query("""SELECT area_id, shape FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY prio) AS rn FROM (SELECT n_nationkey AS area_id, 0 AS prio, 'union-' || n_regionkey AS shape FROM nation WHERE n_regionkey < 2
UNION ALL SELECT n_nationkey, 1, 'part-' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 2, 'outline' FROM nation)) WHERE rn = 1""")
def flt13_shape_precedence(spark, sf):
    """The shape that stands for an area: its holder's union, else its part, else its outline."""
    n = V.read(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    shape = lambda prio, s: F.struct(F.lit(prio).alias("prio"), s.alias("shape"))
    own = F.array(
        F.when(F.col("n_regionkey") < 2, shape(0, F.concat(F.lit("union-"), F.col("n_regionkey").cast("string")))),
        F.when(F.col("n_nationkey") % 2 == 0, shape(1, F.concat(F.lit("part-"), F.col("n_nationkey").cast("string")))),
        shape(2, F.lit("outline")),
    )
    return n.select(F.col("n_nationkey").alias("area_id"), F.array_min(F.array_compact(own))["shape"].alias("shape"))


_SHIFTED = ", pt AS (SELECT id, lon + 4 AS lon, lat + 2 AS lat FROM v_probe)"
_PT_IN = ", inside AS (SELECT p.id, e.area_id FROM {p} p JOIN v_edge e ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


@query(_SHIFTED + _PT_IN.format(p="pt") + f""", near AS (SELECT id, area_id FROM (SELECT p.id, area_id, row_number() OVER (PARTITION BY p.id ORDER BY min({V.seg('p.lon', 'p.lat')}), area_id) AS rn FROM pt p CROSS JOIN v_edge GROUP BY p.id, area_id HAVING min({V.seg('p.lon', 'p.lat')}) <= 150) WHERE rn = 1)
SELECT p.id, coalesce(i.area_id, n.area_id) AS area_id, CASE WHEN i.id IS NOT NULL THEN 'inside' WHEN n.id IS NOT NULL THEN 'nearest' ELSE 'none' END AS how FROM pt p LEFT JOIN inside i ON i.id = p.id LEFT JOIN near n ON n.id = p.id""", ("v_probe", "v_edge"))
def jon21_containing_else_nearest(spark, sf):
    """The area around a point, else the nearest one within 150 km; points are shifted so that some lie outside."""
    p = V.v_probe(spark, sf).select("id", (F.col("lon") + 4).alias("lon"), (F.col("lat") + 2).alias("lat"))
    inside = S.containing(p, _edges(spark, sf)).withColumnRenamed("area_id", "_in")
    out = p.join(inside, "id", "left_anti")
    near = S.nearest_edge(out, _edges(spark, sf), 150.0, ["area_id"]).groupBy("id").agg(F.min(F.struct("km", "area_id"))["area_id"].alias("_near"))
    how = F.when(F.col("_in").isNotNull(), "inside").when(F.col("_near").isNotNull(), "nearest").otherwise("none")
    return p.select("id").join(inside, "id", "left").join(near, "id", "left").select("id", F.coalesce("_in", "_near").alias("area_id"), how.alias("how"))


_STOPS = ", stops AS (SELECT DISTINCT year(o_orderdate::DATE)::BIGINT AS y, date_diff('day', DATE '1970-01-01', make_date(year(o_orderdate::DATE)::BIGINT, 7, 1))::BIGINT AS d FROM orders)"


def _at_stops(spark, sf):
    """Holders at the first of July of each year of the orders: periods are dealt to the years that they touch."""
    years = V.read(spark, sf, "orders").select(F.year(F.col("o_orderdate").cast("date")).alias("y")).distinct()
    stops = years.select("y", F.unix_date(F.make_date("y", F.lit(7), F.lit(1))).cast("long").alias("d"))
    p = V.v_period(spark, sf)
    year = lambda c: F.year(F.date_from_unix_date(F.col(c).cast("int")))
    starts = p.groupBy("area_id").agg(F.min("from").alias("_first"))
    spread = p.withColumn("y", F.explode(F.sequence(year("from"), year("to"))))
    hit = spread.join(stops, "y").where("`from` <= d and d < `to`").join(starts, "area_id")
    return hit.select(F.col("y").cast("long").alias("y"), "area_id", "id", "holder", (F.col("from") > F.col("_first")).alias("known_start"))


@query(_STOPS + " SELECT y, holder, count(*)::BIGINT AS n_areas, count(*) FILTER (f > s)::BIGINT AS n_known, min(p.area_id) AS first_area FROM stops JOIN v_period p ON f <= d AND d < t JOIN (SELECT area_id, min(f) AS s FROM v_period GROUP BY 1) b ON b.area_id = p.area_id GROUP BY 1, 2", ("v_period",))
def tmp5_state_at_stops(spark, sf):
    """All stops at once: how many areas each holder has."""
    g = _at_stops(spark, sf).groupBy("y", "holder")
    return g.agg(F.count("*").alias("n_areas"), F.count_if("known_start").alias("n_known"), F.min("area_id").alias("first_area"))


@query("SELECT id, CASE WHEN kind = 'state' AND side THEN 'state on the side' WHEN kind = 'part' AND NOT side THEN 'part off the side' END AS message FROM (SELECT n_nationkey AS id, CASE WHEN n_regionkey % 2 = 0 THEN 'state' ELSE 'part' END AS kind, n_nationkey % 3 = 0 AS side FROM nation) WHERE (kind = 'state') = side")
def tmp6_entity_rules(spark, sf):
    """An entity's kind against its side."""
    n = V.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") % 2 == 0, "state").otherwise("part").alias("kind"), (F.col("n_nationkey") % 3 == 0).alias("side"))
    message = F.when((F.col("kind") == "state") & F.col("side"), "state on the side").when((F.col("kind") == "part") & ~F.col("side"), "part off the side")
    return n.select("id", message.alias("message")).where("message is not null")


_SAMPLES = ", smp AS (SELECT area_id, seq * 100 + k AS pos, x1 + k / n * (x2 - x1) AS lon, y1 + k / n * (y2 - y1) AS lat FROM (SELECT *, unnest(range(0, n::BIGINT)) AS k FROM (SELECT *, greatest(1, ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 0.75e0)) AS n FROM v_edge)))"


def _samples(spark, sf):
    """(area_id, pos, id, lon, lat): the rings' samples in order."""
    s = S.densify(V.v_edge(spark, sf), ["area_id", "seq"], 0.75).withColumn("pos", F.col("seq") * 100 + F.col("k"))
    return s.select("area_id", "pos", (F.col("area_id") * 10000 + F.col("pos")).alias("id"), "lon", "lat")


_DIST = _SAMPLES.replace("x1 + k / n * (x2 - x1) AS lon", f"{V.hav('x1', 'y1', 'x2', 'y2')} / n AS km, x1 + k / n * (x2 - x1) AS lon") + f", nr AS (SELECT area_id, pos, km, d, d <= 60 AS near FROM (SELECT s.*, (SELECT min({V.hav('s.lon', 's.lat', 'b.lon', 'b.lat')}) FROM v_site b) AS d FROM smp s))"


@query(_DIST + """, r AS (SELECT *, sum(fresh) OVER (PARTITION BY area_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN near IS DISTINCT FROM lag(near) OVER (PARTITION BY area_id ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM nr)),
w AS (SELECT *, max(run) OVER (PARTITION BY area_id) AS top, bool_or(near AND run = 1) OVER (PARTITION BY area_id) AS head FROM r)
SELECT area_id, arg_min(pos, pos - run * 100000)::BIGINT AS starts, count(*)::BIGINT AS n, floor(sum(km) + 0.5e0)::BIGINT AS km, floor(min(d) * 1000 + 0.5e0)::BIGINT AS closest_m FROM w WHERE near GROUP BY area_id, CASE WHEN run = top AND head THEN 1 ELSE run END""", ("v_edge", "v_site"))
def win8_near_stretches(spark, sf):
    """Stretches of a ring near a site: where they start, their length, how near they come; the first and last join up."""
    e = V.v_edge(spark, sf)
    length = e.select("area_id", "seq", geo.haversine_km(*(F.col(c) for c in EDGE[1:])).alias("len"))
    s = S.densify(e, ["area_id", "seq"], 0.75)
    n = s.groupBy("area_id", "seq").agg(F.count("*").alias("n")).join(length, ["area_id", "seq"]).select("area_id", "seq", (F.col("len") / F.col("n")).alias("km"))
    s = s.join(n, ["area_id", "seq"]).withColumns({"id": F.struct("area_id", "seq", "k"), "pos": F.col("seq") * 100 + F.col("k")})
    d = S.within_km(s.select("id", "lon", "lat"), V.v_site(spark, sf), 60.0).groupBy(F.col("a_id").alias("id")).agg(F.min("km").alias("d"))
    w = Window.partitionBy("area_id").orderBy("pos")
    s = s.join(d, "id", "left").withColumn("near", F.col("d").isNotNull())
    s = s.withColumn("_f", (~F.col("near").eqNullSafe(F.lag("near").over(w))).cast("int")).withColumn("run", F.sum("_f").over(w))
    whole = Window.partitionBy("area_id")
    s = s.withColumns({"top": F.max("run").over(whole), "head": F.bool_or(F.col("near") & (F.col("run") == 1)).over(whole)}).where("near")
    joined = F.when((F.col("run") == F.col("top")) & F.col("head"), 1).otherwise(F.col("run"))
    g = s.groupBy("area_id", joined.alias("_r")).agg(F.min_by("pos", F.col("pos") - F.col("run") * 100000).cast("long").alias("starts"), F.count("*").alias("n"), F.floor(F.sum("km") + 0.5).cast("long").alias("km"), geo.scaled(F.min("d")).alias("closest_m"))
    return g.drop("_r")


@query(_SAMPLES.replace("x1 + k / n * (x2 - x1) AS lon", f"{V.hav('x1', 'y1', 'x2', 'y2')} / n AS km, x1 + k / n * (x2 - x1) AS lon") + f", nr AS (SELECT area_id, km, EXISTS (SELECT 1 FROM v_site b WHERE {V.hav('s.lon', 's.lat', 'b.lon', 'b.lat')} <= 60) AS near FROM smp s) SELECT area_id, floor(sum(km) + 0.5e0)::BIGINT AS perimeter_km, floor(coalesce(sum(km) FILTER (near), 0) + 0.5e0)::BIGINT AS contact_km, coalesce(sum(km) FILTER (near), 0) / sum(km) >= 0.1e0 AS allowed FROM nr GROUP BY 1", ("v_edge", "v_site"))
def agg18_contact_km(spark, sf):
    """Kilometres of an outline and of its stretches that have a site near them: each sample stands for its share of its edge."""
    e = V.v_edge(spark, sf)
    length = e.select("area_id", "seq", geo.haversine_km(*(F.col(c) for c in EDGE[1:])).alias("len"))
    s = S.densify(e, ["area_id", "seq"], 0.75)
    n = s.groupBy("area_id", "seq").agg(F.count("*").alias("n")).join(length, ["area_id", "seq"]).select("area_id", "seq", (F.col("len") / F.col("n")).alias("km"))
    s = s.join(n, ["area_id", "seq"]).withColumn("id", F.struct("area_id", "seq", "k"))
    near = S.within_km(s.select("id", "lon", "lat"), V.v_site(spark, sf), 60.0).select(F.col("a_id").alias("id"), F.lit(True).alias("near")).distinct()
    g = s.join(near, "id", "left").groupBy("area_id").agg(F.sum("km").alias("p"), F.coalesce(F.sum(F.when(F.col("near"), F.col("km"))), F.lit(0.0)).alias("c"))
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("long")
    return g.select("area_id", whole("p").alias("perimeter_km"), whole("c").alias("contact_km"), (F.col("c") / F.col("p") >= 0.1).alias("allowed"))


@query(_SAMPLES + f""", c AS (SELECT area_id, b.id % 4 AS cand, count(DISTINCT pos)::BIGINT AS n FROM smp s JOIN v_site b ON {V.hav('s.lon', 's.lat', 'b.lon', 'b.lat')} <= 100 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY n DESC, cand) AS rn FROM c)
SELECT a.area_id, a.cand AS winner, a.n, coalesce(b.n * 100 > a.n * 33, false) AS ambiguous FROM o a LEFT JOIN o b ON b.area_id = a.area_id AND b.rn = 2 WHERE a.rn = 1""", ("v_edge", "v_site"))
def agg17_dominant_neighbour(spark, sf):
    """The candidate with most of an outline's samples near it; ambiguous if the second has more than a third of that."""
    near = S.within_km(_samples(spark, sf), V.v_site(spark, sf), 100.0)
    c = near.select(F.floor(F.col("a_id") / 10000).alias("area_id"), "a_id", (F.col("b_id") % 4).alias("cand")).distinct().groupBy("area_id", "cand").agg(F.count("*").alias("n"))
    w = Window.partitionBy("area_id").orderBy(F.desc("n"), "cand")
    o = c.withColumns({"rn": F.row_number().over(w), "second": F.lead("n").over(w)}).where("rn = 1")
    return o.select("area_id", F.col("cand").alias("winner"), "n", F.coalesce(F.col("second") * 100 > F.col("n") * 33, F.lit(False)).alias("ambiguous"))


_KM2 = "abs(sum(radians(x2 - x1) * (sin(radians(y1)) + sin(radians(y2))))) * 6371.0088e0 * 6371.0088e0 / 2"


_D = V.hav("a.lon", "a.lat", "b.lon", "b.lat")


@query(f"""SELECT a_id, CASE WHEN ea IS NULL THEN ib WHEN eb IS NULL OR ea <= eb + 30 THEN ia ELSE ib END AS b_id FROM (SELECT a_id, min(km) FILTER (odd = 0) AS ea, min(km) FILTER (odd = 1) AS eb, arg_min(b_id, km) FILTER (odd = 0) AS ia, arg_min(b_id, km) FILTER (odd = 1) AS ib
FROM (SELECT a.id AS a_id, b.id AS b_id, b.id % 2 AS odd, {_D} AS km FROM v_probe a, v_site b WHERE {_D} <= 400) GROUP BY 1)""", ("v_probe", "v_site"))
def win15_preferred_nearest(spark, sf):
    """The nearest candidate of the first rank, unless one of the second is more than 30 km nearer."""
    a, b = V.v_probe(spark, sf), V.v_site(spark, sf)
    by_rank = [S.nearest(a, b.where(F.col("id") % 2 == odd), 400.0).select("a_id", F.struct("km", "b_id").alias(name)) for odd, name in ((0, "a"), (1, "b"))]
    g = by_rank[0].join(by_rank[1], "a_id", "full_outer")
    first = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a.km") <= F.col("b.km") + 30))
    return g.select("a_id", F.when(first, F.col("a.b_id")).otherwise(F.col("b.b_id")).alias("b_id"))


@query("""SELECT line_id, floor((x1 + (x2 - x1) * (half - (c - len)) / len) * 1000 + 0.5e0)::BIGINT AS x, floor((y1 + (y2 - y1) * (half - (c - len)) / len) * 1000 + 0.5e0)::BIGINT AS y FROM (SELECT *, max(c) OVER (PARTITION BY line_id) / 2 AS half FROM (
SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM v_seg))) WHERE len > 0 AND c - len < half AND half <= c""", ("v_seg",))
def win17_line_midpoint(spark, sf):
    w = Window.partitionBy("line_id").orderBy("seq")
    s = S.segments(V.v_line(spark, sf)).withColumn("len", F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)))
    s = s.withColumn("c", F.sum("len").over(w)).withColumn("half", F.max("c").over(Window.partitionBy("line_id")) / 2).where("len > 0 and c - len < half and half <= c")
    at = lambda a, b: geo.scaled(F.col(a) + (F.col(b) - F.col(a)) * (F.col("half") - (F.col("c") - F.col("len"))) / F.col("len"))
    return s.select("line_id", at("x1", "x2").alias("x"), at("y1", "y2").alias("y"))


_PLANE = "sqrt(pow((x2 - x1) * cos(radians(y1)) * 111.32e0, 2) + pow((y2 - y1) * 110.574e0, 2))"


@query(f"SELECT line_id, floor((x2 + (x2 - x1) * 5 / km) * 1000 + 0.5e0)::BIGINT AS x, floor((y2 + (y2 - y1) * 5 / km) * 1000 + 0.5e0)::BIGINT AS y FROM (SELECT *, {_PLANE} AS km, row_number() OVER (PARTITION BY line_id ORDER BY seq DESC) AS rn FROM v_seg) WHERE rn = 1 AND km > 0", ("v_seg",))
def geo7_extend_end(spark, sf):
    """Line ends carried on by 5 km in their last direction."""
    last = S.segments(V.v_line(spark, sf)).groupBy("line_id").agg(F.max(F.struct("seq", "x1", "y1", "x2", "y2")).alias("s")).select("line_id", "s.*")
    s = last.withColumn("km", geo.plane_km(*(F.col(c) for c in EDGE[1:]))).where("km > 0")
    on = lambda a, b: geo.scaled(F.col(b) + (F.col(b) - F.col(a)) * 5 / F.col("km"))
    return s.select("line_id", on("x1", "x2").alias("x"), on("y1", "y2").alias("y"))


@query("SELECT id, floor(lon * cos(radians((SELECT avg(lat) FROM v_site))) * 1000 + 0.5e0)::BIGINT AS x, floor(lat * 1000 + 0.5e0)::BIGINT AS y FROM v_site", ("v_site",))
def geo8_equirectangular(spark, sf):
    p = V.v_site(spark, sf)
    mean = p.agg(F.avg("lat").alias("phi"))
    return p.join(F.broadcast(mean)).select("id", geo.scaled(F.col("lon") * F.cos(F.radians("phi"))).alias("x"), geo.scaled(F.col("lat")).alias("y"))  # one row


_RING = """, rp AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS seq, x, y FROM (SELECT line_id, seq, floor(lon / 3) AS x, floor(lat / 3) AS y FROM v_line)),
re AS (SELECT r.line_id, r.seq, r.x AS x1, r.y AS y1, n.x AS x2, n.y AS y2, m AS last FROM rp r JOIN (SELECT line_id, max(seq) AS m FROM rp GROUP BY 1 HAVING max(seq) >= 3) USING (line_id) JOIN rp n ON n.line_id = r.line_id AND n.seq = r.seq % m + 1)"""


def _turn(l: str, m: str, r: str) -> str:  # noqa: E741
    (lx, ly), (mx, my), (rx, ry) = ((f"{s[0]}.x{s[1]}", f"{s[0]}.y{s[1]}") for s in (l, m, r))
    return f"(({my} - {ly}) * ({rx} - {mx}) - ({mx} - {lx}) * ({ry} - {my}))"


def _on(o: str, p: str, s: str) -> str:
    x, y = f"{p[0]}.x{p[1]}", f"{p[0]}.y{p[1]}"
    return f"(abs({o}) <= 1e-9 AND ({x} - {s}.x1) * ({x} - {s}.x2) + ({y} - {s}.y1) * ({y} - {s}.y2) <= 0)"


_TURNS = ", ".join(f"{_turn(f'{s}1', f'{s}2', p)} AS o{k}" for k, (p, s) in enumerate((("b1", "a"), ("b2", "a"), ("a1", "b"), ("a2", "b"))))
_TOUCHES = " OR ".join(f"({c})" for c in (_on("o0", "b1", "a"), _on("o1", "b2", "a"), _on("o2", "a1", "b"), _on("o3", "a2", "b")))


@query(_RING + f""" SELECT line_id, a_seq, b_seq, kind FROM (SELECT line_id, a_seq, b_seq, CASE WHEN (o0 > 0 AND o1 < 0 OR o0 < 0 AND o1 > 0) AND (o2 > 0 AND o3 < 0 OR o2 < 0 AND o3 > 0) THEN 'cross' WHEN touches AND greatest(abs(o0), abs(o1), abs(o2), abs(o3)) <= 1e-9 THEN 'overlap' WHEN touches THEN 'touch' END AS kind
FROM (SELECT a.line_id, a.seq AS a_seq, b.seq AS b_seq, {_TURNS}, ({_TOUCHES}) AS touches FROM re a JOIN re b ON a.line_id = b.line_id AND a.seq + 1 < b.seq AND NOT (a.seq = 1 AND b.seq = b.last))) WHERE kind IS NOT NULL""", ("v_line",))
def spa1_ring_faults(spark, sf):
    """Lines closed to rings on a coarse grid: edges that cross, touch or overlap, but for neighbours."""
    w = Window.partitionBy("line_id")
    p = V.v_line(spark, sf).select("line_id", F.row_number().over(w.orderBy("seq")).alias("seq"), F.floor(F.col("lon") / 3).cast("double").alias("x"), F.floor(F.col("lat") / 3).cast("double").alias("y"))
    o = w.orderBy("seq")
    next_ = lambda c: F.coalesce(F.lead(c).over(o), F.first(c).over(o))
    e = p.select("line_id", "seq", F.count("*").over(w).alias("n"), F.col("x").alias("x1"), F.col("y").alias("y1"), next_("x").alias("x2"), next_("y").alias("y2")).where("n >= 3").drop("n")
    return S.ring_faults(e, "line_id", 4.0).select("line_id", *[F.col(c).cast("long").alias(c) for c in ("a_seq", "b_seq")], "kind")


def _tidy(src: str) -> str:
    """Without repeats: line_id, k, p."""
    return f"(SELECT line_id, k, CASE WHEN len(q) > 1 AND q[1] = q[-1] THEN q[1:len(q) - 1] ELSE q END AS p FROM (SELECT line_id, k, list_filter(p, lambda v, i: i = 1 OR v IS DISTINCT FROM p[i - 1]) AS q FROM {src}))"


_SPIKES = "list_transform(p, lambda v, i: len(p) > 3 AND (v.x - {b}.x) * ({n}.x - v.x) + (v.y - {b}.y) * ({n}.y - v.y) < 0 AND abs((v.x - {b}.x) * ({n}.y - v.y) - (v.y - {b}.y) * ({n}.x - v.x)) / greatest(sqrt(pow(v.x - {b}.x, 2) + pow(v.y - {b}.y, 2)), sqrt(pow({n}.x - v.x, 2) + pow({n}.y - v.y, 2))) <= 0.00001)".format(b="p[CASE WHEN i = 1 THEN len(p) ELSE i - 1 END]", n="p[CASE WHEN i = len(p) THEN 1 ELSE i + 1 END]")
_FIRSTS = "list_transform(s, lambda v, i: v AND (NOT s[CASE WHEN i = 1 THEN len(s) ELSE i - 1 END] OR i = 1 AND len(list_filter(s, lambda u: u)) = len(s)))"
_GOING = f"(SELECT line_id, k, p, list_transform(g, lambda v, i: v AND len(list_filter(g[1:i], lambda u: u)) <= len(p) - 3) AS g FROM (SELECT line_id, k, p, {_FIRSTS} AS g FROM (SELECT line_id, k, p, {_SPIKES} AS s FROM {{src}})))"


@query(f""", raw AS (SELECT line_id, 0 AS k, list({{'x': floor(lon / 3) * 3, 'y': floor(lat / 3) * 3}} ORDER BY seq) AS p FROM v_line GROUP BY 1),
rd(line_id, k, p, again) AS (SELECT line_id, 0, p, true FROM {_tidy('raw')} UNION ALL SELECT line_id, k, p, true FROM {_tidy(f"(SELECT line_id, k + 1 AS k, list_filter(p, lambda v, i: NOT g[i]) AS p FROM {_GOING.format(src='rd')} WHERE len(list_filter(g, lambda u: u)) > 0)")}),
fin AS (SELECT line_id, arg_max(p, k) AS p FROM rd GROUP BY 1),
ar AS (SELECT line_id, len(p) AS n, len(list_distinct(p)) AS places, abs(list_sum(list_transform(p, lambda v, i: radians(p[CASE WHEN i = len(p) THEN 1 ELSE i + 1 END].x - v.x) * (2 + sin(radians(v.y)) + sin(radians(p[CASE WHEN i = len(p) THEN 1 ELSE i + 1 END].y)))))) * (6371.0088e0 * 6371.0088e0 / 2) AS km2 FROM fin)
SELECT line_id, n::BIGINT AS n_kept, CASE WHEN places < 3 THEN 'degenerate' WHEN km2 < 300000 THEN 'small' END AS dropped, CASE WHEN places >= 3 THEN floor(km2 + 0.5e0)::BIGINT END AS km2 FROM ar""", ("v_line",))
def spa2_ring_cleanup(spark, sf):
    """Rings on a coarse grid without repeats and spikes; those of fewer than three places, or too small, are reported."""
    p = V.v_line(spark, sf).select(F.col("line_id").alias("ring"), "seq", (F.floor(F.col("lon") / 3) * 3).cast("double").alias("x"), (F.floor(F.col("lat") / 3) * 3).cast("double").alias("y"))
    rings = V.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ring")).distinct()
    parts = rings.select("ring", F.col("ring").alias("part"), F.lit(False).alias("hole"))
    _, report = R.clean_parts(p, parts, 300_000.0)
    dropped = F.when(F.col("degenerate") > 0, "degenerate").when(F.col("small"), "small")
    return report.select(F.col("part").alias("line_id"), "n_kept", dropped.alias("dropped"), geo.scaled(F.col("km2"), 1.0).alias("km2"))


@query("SELECT a.area_id AS area_a, b.area_id AS area_b, a.x1, a.y1, a.x2, a.y2 FROM v_edge a JOIN v_edge b ON a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1 WHERE a.holder < 2 AND b.holder >= 2", ("v_edge",))
def spa6_edge_between_sides(spark, sf):
    """Edges with one side's area on the left and the other side's on the right."""
    e = V.v_edge(spark, sf)
    a = e.where("holder < 2").select(F.col("area_id").alias("area_a"), "x1", "y1", "x2", "y2")
    b = e.where("holder >= 2").select(F.col("area_id").alias("area_b"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return a.join(b, ["x1", "y1", "x2", "y2"]).select("area_a", "area_b", "x1", "y1", "x2", "y2")


@query(_PT_IN.format(p="v_site") + " SELECT p.id, p.id % 25 AS area_id FROM v_site p ANTI JOIN inside i ON i.id = p.id AND i.area_id = p.id % 25", ("v_site", "v_edge"))
def spa12_label_in_area(spark, sf):
    """Labels that do not lie in the area they name."""
    p = V.v_site(spark, sf)
    return p.select("id", (F.col("id") % 25).alias("area_id")).join(S.containing(p, _edges(spark, sf)), ["id", "area_id"], "left_anti")


@query(", pt AS (SELECT id, CASE WHEN id % 8 = 0 THEN -10 + (id % 5) * 12 + 0.001e0 ELSE lon END AS lon, lat FROM v_site)" + _PT_IN.format(p="pt") + f""", edge AS (SELECT p.id FROM pt p CROSS JOIN v_edge GROUP BY 1 HAVING min({V.seg('p.lon', 'p.lat')}) <= 0.15e0) SELECT p.id, CASE WHEN p.id % 11 = 0 THEN 'label only' WHEN e.id IS NOT NULL THEN 'on boundary' WHEN i.area_id IS NULL THEN 'outside' WHEN i.area_id % 5 = p.id % 5 THEN 'as expected' ELSE 'in ' || i.area_id END AS verdict
FROM pt p LEFT JOIN inside i ON i.id = p.id LEFT JOIN edge e ON e.id = p.id""", ("v_site", "v_edge"))
def spa15_anchor_checks(spark, sf):
    """Anchors against the areas that they are expected in: on a boundary within 0.15 km, outside, as expected, in another;
    some are labels alone and not checked. (Every eighth site is moved next to a boundary.)"""
    p = V.v_site(spark, sf).withColumn("lon", F.when(F.col("id") % 8 == 0, F.lit(-10) + F.col("id") % 5 * 12 + F.lit(0.001)).otherwise(F.col("lon")))
    inside = S.containing(p, _edges(spark, sf))
    edge = S.nearest_edge(p, _edges(spark, sf), 0.15, [])
    verdict = F.when(F.col("id") % 11 == 0, "label only").when(F.col("km").isNotNull(), "on boundary").when(F.col("area_id").isNull(), "outside").when(F.col("area_id") % 5 == F.col("id") % 5, "as expected").otherwise(F.concat(F.lit("in "), F.col("area_id").cast("string")))
    return p.select("id").join(inside, "id", "left").join(edge, "id", "left").select("id", verdict.alias("verdict"))


@query(_PT_IN.format(p="v_probe") + " SELECT p.id, CASE max(CASE WHEN i.area_id % 7 = 0 THEN 2 WHEN i.area_id % 2 = 0 THEN 1 ELSE 0 END) WHEN 2 THEN 'lake' WHEN 1 THEN 'land' ELSE 'sea' END AS surface FROM v_probe p LEFT JOIN inside i ON i.id = p.id GROUP BY 1", ("v_probe", "v_edge"))
def spa17_surface(spark, sf):
    """Lake over land over sea, by the kinds of the areas around a point."""
    p = V.v_probe(spark, sf)
    kind = F.when(F.col("area_id") % 7 == 0, 2).when(F.col("area_id") % 2 == 0, 1).otherwise(0)
    top = p.select("id").join(S.containing(p, _edges(spark, sf)), "id", "left").groupBy("id").agg(F.max(kind).alias("k"))
    return top.select("id", F.when(F.col("k") == 2, "lake").when(F.col("k") == 1, "land").otherwise("sea").alias("surface"))


@query(_PT_IN.format(p="v_site") + " SELECT DISTINCT area_id FROM inside", ("v_site", "v_edge"))
def spa32_area_with_anchor(spark, sf):
    """Areas that hold a site."""
    return S.containing(V.v_site(spark, sf), _edges(spark, sf)).select("area_id").distinct()


_CELLS = ", fr AS (SELECT DISTINCT floor(lon)::BIGINT AS cx, floor(lat)::BIGINT AS cy FROM v_probe), bl AS (SELECT DISTINCT floor(lon)::BIGINT AS bx, floor(lat)::BIGINT AS by_ FROM v_site)"


@query(_CELLS + " SELECT cx, cy, min((cx - bx) * (cx - bx) + (cy - by_) * (cy - by_))::BIGINT AS d2 FROM fr JOIN bl ON abs(cx - bx) <= 4 AND abs(cy - by_) <= 4 GROUP BY 1, 2", ("v_probe", "v_site"))
def grf5_clearance(spark, sf):
    """Squared distance, in cells, from each free cell to the nearest blocked one at most four cells away."""
    at = lambda df: df.select(F.floor("lon").alias("cx"), F.floor("lat").alias("cy")).distinct()
    around = F.sequence(F.lit(-4), F.lit(4))
    reach = at(V.v_site(spark, sf)).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    reach = reach.select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("long").alias("d2"))
    return at(V.v_probe(spark, sf)).join(reach.groupBy("cx", "cy").agg(F.min("d2").alias("d2")), ["cx", "cy"])


_GRID = """, g AS (SELECT DISTINCT floor(lon / 2)::BIGINT AS x, floor(lat / 2)::BIGINT AS y FROM v_probe), st AS (SELECT min(x * 1000 + y) AS node FROM g), o AS (SELECT 1 AS dx, 0 AS dy UNION ALL SELECT -1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT 0, -1 UNION ALL SELECT 1, 1 UNION ALL SELECT 1, -1 UNION ALL SELECT -1, 1 UNION ALL SELECT -1, -1),
e AS (SELECT a.x * 1000 + a.y AS src, b.x * 1000 + b.y AS dst, CASE WHEN dx <> 0 AND dy <> 0 THEN 14 ELSE 10 END AS w FROM g a CROSS JOIN o JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy WHERE (dx = 0 OR dy = 0) OR (EXISTS (SELECT 1 FROM g c WHERE c.x = a.x + dx AND c.y = a.y) AND EXISTS (SELECT 1 FROM g c WHERE c.x = a.x AND c.y = a.y + dy))),
p(node, cost) USING KEY (node) AS (SELECT node, 0 FROM st UNION SELECT n.node, n.cost FROM (SELECT e.dst AS node, min(p.cost + e.w) AS cost FROM p JOIN e ON e.src = p.node GROUP BY 1) n LEFT JOIN recurring.p k ON k.node = n.node WHERE k.cost IS NULL OR n.cost < k.cost)"""


@query(_GRID + " SELECT node::BIGINT AS node, min(cost)::BIGINT AS cost FROM p GROUP BY 1", ("v_probe",))
def grf4_grid_costs(spark, sf):
    """Least costs over free cells in eight directions, corners not cut, from the first cell to all that it reaches."""
    g = G.checkpointed(V.v_probe(spark, sf).select(F.floor(F.col("lon") / 2).alias("x"), F.floor(F.col("lat") / 2).alias("y")).distinct())
    cells = P.stepped(g, F.lit(10.0), F.lit(10.0), F.lit(10.0)).withColumns({c: F.lit(14.0) for c in P.STEPS[3:]})
    start = g.agg(F.min(F.struct("x", "y")).alias("s")).where("s is not null").select(F.lit(0).alias("search"), "s.*", F.lit(0.0).alias("cost"))
    return P.least_costs(cells, start).select((F.col("x") * 1000 + F.col("y")).alias("node"), F.col("cost").cast("long").alias("cost"))
