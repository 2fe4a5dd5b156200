"""Spatial and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogaz.functions import geo
from chronogaz.operators import graph as G
from chronogaz.operators import spatial as S
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

_IN = """, inside AS (SELECT p.id, e.area_id FROM {p} p JOIN v_edge e ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""
_STATUS = _IN.format(p="v_site") + f""", near AS (SELECT p.id, e.area_id FROM v_site p CROSS JOIN v_edge e GROUP BY 1, 2 HAVING min({V.seg('p.lon', 'p.lat')}) <= 25),
status AS (SELECT coalesce(n.area_id, i.area_id) AS area_id, coalesce(n.id, i.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'near' ELSE 'inside' END AS status FROM inside i FULL OUTER JOIN near n ON n.id = i.id AND n.area_id = i.area_id)"""


@query(_IN.format(p="v_probe") + " SELECT id, area_id FROM inside", ("v_probe", "v_edge"))
def jon19_point_in_area(spark, sf):
    return S.containing(V.v_probe(spark, sf), V.v_edge(spark, sf).select("area_id", "x1", "y1", "x2", "y2"))


def _status(spark, sf):
    return S.place_status(V.v_site(spark, sf), V.v_edge(spark, sf).select("area_id", "x1", "y1", "x2", "y2"), 25.0)


@query(_STATUS + " SELECT area_id, id, status FROM status", ("v_site", "v_edge"))
def jon20_place_status(spark, sf):
    return _status(spark, sf)


@query(_STATUS + """ SELECT n_nationkey AS area_id, count(*) FILTER (status = 'inside')::BIGINT AS n_inside, count(*) FILTER (status = 'near')::BIGINT AS n_near, ((SELECT count(*) FROM v_site) - count(status))::BIGINT AS n_outside
FROM nation LEFT JOIN status ON area_id = n_nationkey GROUP BY 1""", ("v_site", "v_edge"))
def jon20_place_status_by_area(spark, sf):
    """For each area: how many sites are inside, near its border or outside."""
    total = V.v_site(spark, sf).agg(F.count("*").alias("total"))
    areas = V.read(spark, sf, "nation").select(F.col("n_nationkey").alias("area_id"))
    g = areas.join(_status(spark, sf), "area_id", "left").groupBy("area_id").agg(F.count_if(F.col("status") == "inside").alias("n_inside"), F.count_if(F.col("status") == "near").alias("n_near"), F.count("status").alias("_n"))
    return g.join(F.broadcast(total)).select("area_id", "n_inside", "n_near", (F.col("total") - F.col("_n")).alias("n_outside"))  # one row


_D = V.hav("a.lon", "a.lat", "b.lon", "b.lat")


@query(f"SELECT a.id AS a_id, b.id AS b_id, floor({_D} * 1000 + 0.5e0)::BIGINT AS m FROM v_site a, v_probe b WHERE {_D} <= 20", ("v_site", "v_probe"))
def jon13_within_distance(spark, sf):
    return S.within_km(V.v_site(spark, sf), V.v_probe(spark, sf), 20.0).select("a_id", "b_id", geo.scaled(F.col("km")).alias("m"))


@query(f"SELECT a_id, b_id, floor(km * 1000 + 0.5e0)::BIGINT AS m FROM (SELECT a.id AS a_id, b.id AS b_id, {_D} AS km, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS rn FROM v_site a, v_probe b WHERE {_D} <= 200) WHERE rn = 1", ("v_site", "v_probe"))
def jon15_nearest(spark, sf):
    return S.nearest(V.v_site(spark, sf), V.v_probe(spark, sf), 200.0).select("a_id", "b_id", geo.scaled(F.col("km")).alias("m"))


_FLAT = "sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) * 111.32e0"


@query(f"SELECT a_id, b_id, floor(km * 1000 + 0.5e0)::BIGINT AS m FROM (SELECT a.id AS a_id, b.id AS b_id, {_FLAT} AS km, row_number() OVER (PARTITION BY a.id ORDER BY {_FLAT}, b.id) AS rn FROM v_site a, v_probe b WHERE {_FLAT} <= 150) WHERE rn = 1", ("v_site", "v_probe"))
def jon16_nearest_flat(spark, sf):
    return S.nearest(V.v_site(spark, sf), V.v_probe(spark, sf), 150.0, geo.flat_degrees_km).select("a_id", "b_id", geo.scaled(F.col("km")).alias("m"))


@query(f"""SELECT id, line_id, seq::BIGINT AS seq, floor(km * 1000 + 0.5e0)::BIGINT AS m, floor((x1 + t * (x2 - x1)) * 10000 + 0.5e0)::BIGINT AS foot_x, floor((y1 + t * (y2 - y1)) * 10000 + 0.5e0)::BIGINT AS foot_y FROM (
SELECT p.id, line_id, seq, x1, y1, x2, y2, {V.seg('p.lon', 'p.lat')} AS km, {V.seg_t('p.lon', 'p.lat')} AS t, row_number() OVER (PARTITION BY p.id ORDER BY {V.seg('p.lon', 'p.lat')}, line_id, seq) AS rn FROM v_site p, v_seg WHERE {V.seg('p.lon', 'p.lat')} <= 60) WHERE rn = 1""", ("v_site", "v_seg"))
def jon17_nearest_segment(spark, sf):
    """The nearest segment of any line, and the foot point on it."""
    near = S.nearest_foot(V.v_site(spark, sf), S.segments(V.v_line(spark, sf)), 60.0, ["line_id", "seq"])
    return near.select("id", "line_id", F.col("seq").cast("long").alias("seq"), geo.scaled(F.col("km")).alias("m"), geo.scaled(F.col("foot_lon"), 10000.0).alias("foot_x"), geo.scaled(F.col("foot_lat"), 10000.0).alias("foot_y"))


@query(f"SELECT line_id, floor(sum({V.hav('x1', 'y1', 'x2', 'y2')}) * 10 + 0.5e0)::BIGINT AS hm FROM v_seg GROUP BY 1", ("v_seg",))
def agg9_line_length(spark, sf):
    s = S.segments(V.v_line(spark, sf))
    return s.groupBy("line_id").agg(geo.scaled(F.sum(geo.haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))), 10.0).alias("hm"))


@query("SELECT area_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM v_edge GROUP BY 1", ("v_edge",))
def agg11_planar_area(spark, sf):
    return S.shoelace(V.v_edge(spark, sf), "area_id")


@query(f"SELECT line_id, seq, floor({V.hav('x1', 'y1', 'x2', 'y2')} + 0.5e0)::BIGINT AS km FROM v_seg WHERE {V.hav('x1', 'y1', 'x2', 'y2')} > 1000", ("v_seg",))
def win6_vertex_jumps(spark, sf):
    km = geo.haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return S.segments(V.v_line(spark, sf)).withColumn("km", km).where("km > 1000").select("line_id", F.col("seq").cast("long"), F.floor(F.col("km") + 0.5).cast("long").alias("km"))


@query("""SELECT line_id, east, min(seq)::BIGINT AS first_seq, count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT line_id, seq, x2 > x1 AS east, CASE WHEN (x2 > x1) IS DISTINCT FROM lag(x2 > x1) OVER (PARTITION BY line_id ORDER BY seq) THEN 1 ELSE 0 END AS fresh FROM v_seg)) GROUP BY line_id, run, east""", ("v_seg",))
def win7_run_lengths(spark, sf):
    w = Window.partitionBy("line_id").orderBy("seq")
    s = S.segments(V.v_line(spark, sf)).withColumn("east", F.col("x2") > F.col("x1"))
    s = s.withColumn("_f", (~F.col("east").eqNullSafe(F.lag("east").over(w))).cast("int")).withColumn("_run", F.sum("_f").over(w))
    return s.groupBy("line_id", "_run", "east").agg(F.min("seq").cast("long").alias("first_seq"), F.count("*").alias("n")).drop("_run")


@query("""SELECT CASE WHEN a.holder <> b.holder THEN 'state' ELSE 'same' END AS style, a.area_id AS area_a, b.area_id AS area_b, count(*)::BIGINT AS n_edges
FROM v_edge a JOIN v_edge b ON a.area_id < b.area_id AND a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1 GROUP BY 1, 2, 3""", ("v_edge",))
def spa5_adjacent_areas(spark, sf):
    pairs = S.adjacency(V.v_edge(spark, sf).select("area_id", "x1", "y1", "x2", "y2")).groupBy("area_a", "area_b").agg(F.count("*").alias("n_edges"))
    h = V.read(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("h"))
    j = pairs.join(h.withColumnRenamed("h", "ha"), F.col("area_a") == F.col("n_nationkey")).drop("n_nationkey").join(h.withColumnRenamed("h", "hb"), F.col("area_b") == F.col("n_nationkey"))
    return j.select(F.when(F.col("ha") != F.col("hb"), "state").otherwise("same").alias("style"), "area_a", "area_b", "n_edges")


@query("""SELECT holder, least(x1, x2) AS xa, least(y1, y2) AS ya, greatest(x1, x2) AS xb, greatest(y1, y2) AS yb FROM v_edge GROUP BY holder, least(x1, x2), least(y1, y2), greatest(x1, x2), greatest(y1, y2) HAVING count(*) = 1""", ("v_edge",))
def spa7_dissolve_by_holder(spark, sf):
    d = S.dissolve(V.v_edge(spark, sf), "holder")
    return d.select("holder", F.least("x1", "x2").alias("xa"), F.least("y1", "y2").alias("ya"), F.greatest("x1", "x2").alias("xb"), F.greatest("y1", "y2").alias("yb"))


@query("""SELECT area_id, seq, k::BIGINT AS k, x1 + k / n * (x2 - x1) AS lon, y1 + k / n * (y2 - y1) AS lat FROM (SELECT *, unnest(range(0, n::BIGINT)) AS k FROM (SELECT *, greatest(1, ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 0.75e0)) AS n FROM v_edge))""", ("v_edge",))
def spa4_densify(spark, sf):
    return S.densify(V.v_edge(spark, sf), ["area_id", "seq"], 0.75)


@query("SELECT id, CASE WHEN (40 - 20) * (lon - (-10)) - (50 - (-10)) * (lat - 20) > 0 THEN 'right' ELSE 'left' END AS side FROM v_site", ("v_site",))
def spa28_half_planes(spark, sf):
    """Which side of the line from (-10, 20) to (50, 40)."""
    cross = (F.col("lon") + 10) * 20 - (F.col("lat") - 20) * 60
    return V.v_site(spark, sf).select("id", F.when(cross > 0, "right").otherwise("left").alias("side"))


@query(f"""SELECT p.id, s.id AS seed, s.id % 4 AS label FROM v_probe p, LATERAL (SELECT b.id FROM v_site b ORDER BY {V.hav('p.lon', 'p.lat', 'b.lon', 'b.lat')}, b.id LIMIT 1) s""", ("v_probe", "v_site"))
def spa13_nearest_seed(spark, sf):
    """Membership in a partition by nearest seed, whatever its distance."""
    got = S.nearest(V.v_probe(spark, sf), V.v_site(spark, sf), 21000.0)
    return got.select(F.col("a_id").alias("id"), F.col("b_id").alias("seed"), (F.col("b_id") % 4).alias("label"))


@query()
def grf1_components(spark, sf):
    """No twin: the transitive closure in SQL is too large; tests hold it against a plain version."""
    return G.connected_components(V.v_graph(spark, sf).select("src", "dst"))


@query(f"""SELECT a, b, min(m)::BIGINT AS m FROM (SELECT n1 AS a, n2 AS b, floor({V.hav('x1', 'y1', 'x2', 'y2')} * 1000 + 0.5e0)::BIGINT AS m FROM (SELECT *, x1 || ',' || y1 AS n1, x2 || ',' || y2 AS n2 FROM v_seg)
UNION ALL SELECT n2, n1, m FROM (SELECT x1 || ',' || y1 AS n1, x2 || ',' || y2 AS n2, floor({V.hav('x1', 'y1', 'x2', 'y2')} * 1000 + 0.5e0)::BIGINT AS m FROM v_seg)) WHERE a <> b GROUP BY 1, 2""", ("v_seg",))
def grf2_road_graph(spark, sf):
    node = lambda x, y: F.concat_ws(",", F.col(x).cast("string"), F.col(y).cast("string"))
    s = S.segments(V.v_line(spark, sf)).select(node("x1", "y1").alias("a"), node("x2", "y2").alias("b"), geo.scaled(geo.haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("m"))
    both = s.unionByName(s.select(F.col("b").alias("a"), F.col("a").alias("b"), "m")).where("a <> b")
    return both.groupBy("a", "b").agg(F.min("m").alias("m"))


_COST = """, e AS (SELECT src, dst, min(weight) AS w FROM (SELECT src, dst, weight FROM v_graph UNION ALL SELECT dst, src, weight FROM v_graph) GROUP BY 1, 2),
p(node, cost) USING KEY (node) AS (SELECT 7::BIGINT, 0::BIGINT UNION SELECT n.node, n.cost FROM (SELECT e.dst AS node, min(p.cost + e.w) AS cost FROM p JOIN e ON e.src = p.node GROUP BY 1) n LEFT JOIN recurring.p k ON k.node = n.node WHERE k.cost IS NULL OR n.cost < k.cost)"""


def _both_ways(spark, sf):
    g = V.v_graph(spark, sf)
    return g.unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


@query(_COST + " SELECT node, cost FROM p", ("v_graph",))
def grf3_shortest_costs(spark, sf):
    """From node 7 to every node that it reaches."""
    return G.shortest_costs(_both_ways(spark, sf), spark.range(7, 8).select(F.col("id").alias("node"))).select("node", "cost")


@query(_COST + " SELECT a.node, any_value(a.cost) AS cost, min(b.node) AS prev FROM p a LEFT JOIN e ON e.dst = a.node AND a.node <> 7 LEFT JOIN p b ON b.node = e.src AND b.cost + e.w = a.cost GROUP BY 1", ("v_graph",))
def grf3_shortest_paths(spark, sf):
    """From node 7 to every node that it reaches, with the node before; of equal costs the least."""
    return G.shortest_costs(_both_ways(spark, sf), spark.range(7, 8).select(F.col("id").alias("node")))


@query(", a(id, ancestor, depth) AS (SELECT id, parent, 1 FROM v_tree WHERE parent IS NOT NULL UNION ALL SELECT a.id, t.parent, a.depth + 1 FROM a JOIN v_tree t ON t.id = a.ancestor WHERE t.parent IS NOT NULL) SELECT id, ancestor::BIGINT AS ancestor, depth::BIGINT AS depth FROM a", ("v_tree",))
def grf8_ancestors(spark, sf):
    return G.ancestors(V.v_tree(spark, sf)).select("id", "ancestor", F.col("depth").cast("long").alias("depth"))


_CYC = "SELECT id, CASE WHEN id % 100 = 7 THEN id + 1 WHEN id % 100 = 8 THEN id + 1 WHEN id % 100 = 9 THEN id - 2 WHEN id % 100 = 20 THEN id ELSE parent END AS parent FROM v_tree"


@query(f", c AS ({_CYC}), w(id, cur, n) AS (SELECT id, parent, 1 FROM c WHERE parent IS NOT NULL UNION ALL SELECT w.id, c.parent, w.n + 1 FROM w JOIN c ON c.id = w.cur WHERE c.parent IS NOT NULL AND w.n < 8 AND w.cur <> w.id) SELECT w.id, min(m.cur)::BIGINT AS cycle FROM w JOIN w m ON m.id = w.id WHERE w.cur = w.id GROUP BY w.id", ("v_tree",))
def grf9_cycles(spark, sf):
    """The tree with cycles of three and of one node put in."""
    k = F.col("id") % 100
    p = F.when(k.isin(7, 8), F.col("id") + 1).when(k == 9, F.col("id") - 2).when(k == 20, F.col("id")).otherwise(F.col("parent"))
    return G.cycle_members(V.v_tree(spark, sf).withColumn("parent", p))
