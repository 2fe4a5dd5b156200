"""Derived views of the driver tables that exercise the operators: points, areas, lines, intervals, a tree, a graph.

Whole-number arithmetic first and one division at the end, so that both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c):
    return F.unix_date(F.col(c).cast("date")).cast("long")


def points(spark, sf_dir, table: str, key: str, a: int, b: int) -> DataFrame:
    k = F.col(key)
    return read(spark, sf_dir, table).select(k.alias("id"), (F.lit(-10.0) + (k * a % 6000) / F.lit(100.0)).alias("lon"), (F.lit(20.0) + (k * b % 3000) / F.lit(100.0)).alias("lat"))


def v_site(spark, sf_dir):
    return points(spark, sf_dir, "supplier", "s_suppkey", 7919, 6101)


def v_probe(spark, sf_dir):
    return points(spark, sf_dir, "customer", "c_custkey", 7433, 5779)


#: A cell's ring of corners and side midpoints, in halves of the cell's sides.
RING = ((0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1))


def v_edge(spark, sf_dir):
    """Edges of the areas: one ring of 8 vertices for each nation on a 5 x 5 grid of 12 x 6 degrees."""
    n = F.col("n_nationkey")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(a[0]).alias("ax"), F.lit(a[1]).alias("ay"), F.lit(b[0]).alias("bx"), F.lit(b[1]).alias("by")) for i, (a, b) in enumerate(zip(RING, RING[1:] + RING[:1]))]))
    x0, y0 = F.lit(-10.0) + (n % 5) * 12, F.lit(20.0) + F.floor(n / 5) * 6
    cells = read(spark, sf_dir, "nation").select(n.alias("area_id"), F.col("n_regionkey").alias("holder"), x0.alias("x0"), y0.alias("y0"), sides.alias("s"))
    return cells.select("area_id", "holder", F.col("s.seq").alias("seq"), (F.col("x0") + F.col("s.ax") * 6).alias("x1"), (F.col("y0") + F.col("s.ay") * 3).alias("y1"), (F.col("x0") + F.col("s.bx") * 6).alias("x2"), (F.col("y0") + F.col("s.by") * 3).alias("y2"))


def _on_map(rows: DataFrame) -> dict:
    return {"lon": F.lit(-10.0) + (rows["l_partkey"] * 31 % 6000) / F.lit(100.0), "lat": F.lit(20.0) + ((rows["l_suppkey"] * 17 + rows["l_partkey"]) % 3000) / F.lit(100.0)}


def v_line(spark, sf_dir):
    """Polylines of orders: their items in order as vertices. Repeats of an item are found where the order puts them, side by
    side, so items are shuffled once, by their line."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    w = Window.partitionBy("line_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    once = li.withColumn("seq", F.dense_rank().over(w)).withColumn("_last", F.lag("seq").over(w)).where("_last is null or _last < seq")
    return once.select("line_id", "seq", *[c.alias(n) for n, c in _on_map(once).items()])


def line_boxes(spark, sf_dir):
    """(line_id, w, e, s, n) of the polylines: repeats and order make no difference to a box, so neither is looked at."""
    li = read(spark, sf_dir, "lineitem")
    at = _on_map(li)
    return li.groupBy(F.col("l_orderkey").alias("line_id")).agg(F.min(at["lon"]).alias("w"), F.max(at["lon"]).alias("e"), F.min(at["lat"]).alias("s"), F.max(at["lat"]).alias("n"))


def v_road(spark, sf_dir):
    """Short roads of three vertices, one for each customer, that start at its point."""
    k = F.col("c_custkey")
    step = lambda a: (k * a % 21 - 10) / F.lit(40.0)
    p = points(spark, sf_dir, "customer", "c_custkey", 7433, 5779)
    at = F.array(F.struct(F.lit(1).alias("seq"), F.col("lon"), F.col("lat")), F.struct(F.lit(2).alias("seq"), (F.col("lon") + F.col("dx1")).alias("lon"), (F.col("lat") + F.col("dy1")).alias("lat")), F.struct(F.lit(3).alias("seq"), (F.col("lon") + F.col("dx1") + F.col("dx2")).alias("lon"), (F.col("lat") + F.col("dy1") + F.col("dy2")).alias("lat")))
    moved = p.withColumnRenamed("id", "c_custkey").withColumns({"dx1": step(37), "dy1": step(53), "dx2": step(41), "dy2": step(59)})
    return moved.select(k.alias("road_id"), F.explode(at).alias("v")).select("road_id", "v.*")


def v_way(spark, sf_dir):
    """Ways between numbered nodes: runs of seven share their inner nodes, every second way is drawn backwards."""
    k = F.col("p_partkey")
    a, b = (k + F.floor(k / 7)).cast("long"), (k + F.floor(k / 7) + 1).cast("long")
    return read(spark, sf_dir, "part").select(k.alias("way_id"), F.when(k % 2 == 0, a).otherwise(b).alias("start"), F.when(k % 2 == 0, b).otherwise(a).alias("end"), (F.col("p_size") % 6 + 2).cast("long").alias("n_vertices"))


def v_place_name(spark, sf_dir):
    """Names of the parts taken as places: of several words, some shared, one a country's, one with a lower-case word."""
    k = F.col("p_partkey")
    word = lambda i: F.initcap(F.split_part("p_name", F.lit(" "), F.lit(i)))
    a, b, n = word(1), word(2), lambda m: (k % m).cast("string")
    main, old, short = F.concat(a, F.lit(" "), b, F.lit(" "), n(97)), F.concat(F.lit("The "), a, F.lit(" of "), b, F.lit(" "), n(89)), F.concat(b, F.lit(" "), k.cast("string"))
    names = F.array(main, old, short, F.concat(F.lit("old "), b), F.when(k % 50 == 0, "Egypt"))
    return read(spark, sf_dir, "part").select(k.alias("place"), F.posexplode(names).alias("kind", "name")).where("name is not null")


def v_story(spark, sf_dir):
    """Documents with sentences that name places, their own among them."""
    d, names = F.col("doc_id"), v_place_name(spark, sf_dir).where("place < 200")
    of = names.groupBy("place").agg(*[F.max(F.when(F.col("kind") == i, F.col("name"))).alias(c) for i, c in enumerate(("main", "old", "short"))])
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", *[((d * m + p) % 200).alias(f"k{i}") for i, (m, p) in enumerate(((7, 0), (13, 5), (29, 1)), 1)])
    for i in (1, 2, 3):
        rows = rows.join(of.select(F.col("place").alias(f"k{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("main", "old", "short")]), f"k{i}")
    lower = F.concat(F.lower(F.substring("old3", 1, 1)), F.expr("substr(old3, 2)"))
    c, t = F.col, F.lit
    said = [F.coalesce("text", t("")), t(". By "), c("main1"), t(", "), c("main2"), t(" and "), c("short2"), t(". From "), lower, t("  to Great "), c("main3"), t(" of "), c("short1"), t(". "), c("old2"), t("’s end. (\"Dear "), c("short3"), t("\") by "), c("main1"), t("'s  "), c("old1"), t(".")]
    return rows.select("doc_id", F.col("k1").alias("place"), F.concat(*said).alias("text"))


def v_period(spark, sf_dir):
    """Intervals of customers between their orders, in days; empty ones dropped."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day("o_orderdate").alias("from"), F.col("o_orderstatus").alias("holder"), F.col("o_orderpriority").alias("note"))
    w = Window.partitionBy("o_custkey").orderBy("from", "o_orderkey")
    rows = o.withColumn("to", F.lead("from").over(w)).where("to > from")
    return rows.select(F.col("o_custkey").alias("area_id"), F.col("o_orderkey").alias("id"), "from", "to", "holder", "note", F.array(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))).alias("sources"))


def v_override(spark, sf_dir):
    """Every seventh order as an override of 45 days, unless it overlaps the one before it on its customer."""
    o = read(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("area_id"), F.col("o_orderkey").alias("id"), (day("o_orderdate") + 10).alias("from"), (day("o_orderdate") + 55).alias("to"))
    w = Window.partitionBy("area_id").orderBy("from", "id")
    return o.withColumn("_p", F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("_p is null or _p <= `from`").select("area_id", "id", "from", "to", F.lit("X").alias("holder"))


def v_tree(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 0, F.floor(k / 10)).alias("parent"))


def v_graph(spark, sf_dir, m: int = 5000):
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % m).alias("src"), (F.col("o_orderkey") % m).alias("dst"), (F.col("o_orderkey") * 31 % 97 + 1).alias("weight")).where("src <> dst")


def v_graph_ids(spark, sf_dir, m: int = 5000):
    """The graph with an id for each edge."""
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % m).alias("src"), (F.col("o_orderkey") % m).alias("dst"), (F.col("o_orderkey") * 31 % 97 + 1).alias("weight"), F.col("o_orderkey").alias("id")).where("src <> dst")


_EDGES = " UNION ALL ".join(f"SELECT {i} AS seq, {a[0]} AS ax, {a[1]} AS ay, {b[0]} AS bx, {b[1]} AS by_" for i, (a, b) in enumerate(zip(RING, RING[1:] + RING[:1])))
ORACLE_VIEWS = {
    "v_site": "SELECT s_suppkey AS id, -10e0 + (s_suppkey * 7919 % 6000) / 100e0 AS lon, 20e0 + (s_suppkey * 6101 % 3000) / 100e0 AS lat FROM supplier",
    "v_probe": "SELECT c_custkey AS id, -10e0 + (c_custkey * 7433 % 6000) / 100e0 AS lon, 20e0 + (c_custkey * 5779 % 3000) / 100e0 AS lat FROM customer",
    "v_edge": f"SELECT n_nationkey AS area_id, n_regionkey AS holder, seq, -10e0 + (n_nationkey % 5) * 12 + ax * 6 AS x1, 20e0 + (n_nationkey // 5) * 6 + ay * 3 AS y1, -10e0 + (n_nationkey % 5) * 12 + bx * 6 AS x2, 20e0 + (n_nationkey // 5) * 6 + by_ * 3 AS y2 FROM nation, ({_EDGES})",
    "v_line": "SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, -10e0 + (l_partkey * 31 % 6000) / 100e0 AS lon, 20e0 + ((l_suppkey * 17 + l_partkey) % 3000) / 100e0 AS lat FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)",
    "v_road": "SELECT road_id, v.seq AS seq, v.lon AS lon, v.lat AS lat FROM (SELECT road_id, unnest([{'seq': 1, 'lon': lon, 'lat': lat}, {'seq': 2, 'lon': lon + dx1, 'lat': lat + dy1}, {'seq': 3, 'lon': lon + dx1 + dx2, 'lat': lat + dy1 + dy2}]) AS v FROM (SELECT c_custkey AS road_id, -10e0 + (c_custkey * 7433 % 6000) / 100e0 AS lon, 20e0 + (c_custkey * 5779 % 3000) / 100e0 AS lat, (c_custkey * 37 % 21 - 10) / 40e0 AS dx1, (c_custkey * 53 % 21 - 10) / 40e0 AS dy1, (c_custkey * 41 % 21 - 10) / 40e0 AS dx2, (c_custkey * 59 % 21 - 10) / 40e0 AS dy2 FROM customer))",
    "v_rseg": "SELECT * FROM (SELECT road_id, seq, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM v_road WINDOW w AS (PARTITION BY road_id ORDER BY seq)) WHERE x2 IS NOT NULL",
    "v_rend": "SELECT road_id, 'start' AS side, max(lon) FILTER (seq = 1) AS lon, max(lat) FILTER (seq = 1) AS lat, max(lon) FILTER (seq = 2) AS before_lon, max(lat) FILTER (seq = 2) AS before_lat FROM v_road GROUP BY 1 UNION ALL SELECT road_id, 'end', max(lon) FILTER (seq = 3), max(lat) FILTER (seq = 3), max(lon) FILTER (seq = 2), max(lat) FILTER (seq = 2) FROM v_road GROUP BY 1",
    "v_way": 'SELECT p_partkey AS way_id, p_partkey + p_partkey // 7 + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS "start", p_partkey + p_partkey // 7 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS "end", (p_size % 6 + 2)::BIGINT AS n_vertices FROM part',
    "v_place_name": "SELECT place, kind, name FROM (SELECT place, unnest([0, 1, 2, 3, 4]) AS kind, unnest([a || ' ' || b || ' ' || (place % 97), 'The ' || a || ' of ' || b || ' ' || (place % 89), b || ' ' || place, 'old ' || b, CASE WHEN place % 50 = 0 THEN 'Egypt' END]) AS name FROM (SELECT p_partkey AS place, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS a, upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS b FROM part)) WHERE name IS NOT NULL",
    "v_place_of": "SELECT place, max(name) FILTER (kind = 0) AS main, max(name) FILTER (kind = 1) AS old, max(name) FILTER (kind = 2) AS short FROM v_place_name WHERE place < 200 GROUP BY 1",
    "v_story": "SELECT doc_id, a.place, coalesce(text, '') || '. By ' || a.main || ', ' || b.main || ' and ' || b.short || '. From ' || lower(substr(c.old, 1, 1)) || substr(c.old, 2) || '  to Great ' || c.main || ' of ' || a.short || '. ' || b.old || '’s end. (\"Dear ' || c.short || '\") by ' || a.main || chr(39) || 's  ' || a.old || '.' AS text FROM documents JOIN v_place_of a ON a.place = doc_id * 7 % 200 JOIN v_place_of b ON b.place = (doc_id * 13 + 5) % 200 JOIN v_place_of c ON c.place = (doc_id * 29 + 1) % 200",
    "v_day": "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS d FROM orders",
    "v_period": "SELECT * FROM (SELECT o_custkey AS area_id, o_orderkey AS id, d AS f, lead(d) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS t, o_orderstatus AS holder, o_orderpriority AS note FROM v_day) WHERE t > f",
    "v_override": "SELECT area_id, id, f, t, 'X' AS holder FROM (SELECT *, max(t) OVER (PARTITION BY area_id ORDER BY f, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT o_custkey AS area_id, o_orderkey AS id, d + 10 AS f, d + 55 AS t FROM v_day WHERE o_orderkey % 7 = 0)) WHERE p IS NULL OR p <= f",
    "v_tree": "SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 10 END AS parent FROM part",
    "v_graph": "SELECT * FROM (SELECT o_custkey % 5000 AS src, o_orderkey % 5000 AS dst, o_orderkey * 31 % 97 + 1 AS weight FROM orders) WHERE src <> dst",
    "v_seg": "SELECT * FROM (SELECT line_id, seq, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM v_line WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL",
}
_NEEDS = {"v_place_of": ("v_place_name",), "v_story": ("v_place_of",), "v_period": ("v_day",), "v_override": ("v_day",), "v_seg": ("v_line",), "v_rseg": ("v_road",), "v_rend": ("v_road",)}


def closure(views: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for v in views:
        for n in (*closure(_NEEDS.get(v, ())), v):
            if n not in out:
                out.append(n)
    return out


def hav(a: str, b: str, c: str, d: str) -> str:
    """Haversine kilometres in the oracle's SQL."""
    return f"(asin(sqrt(least(1e0, pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - ({a})) / 2), 2)))) * (2 * 6371.0088e0))"


def seg_t(px: str, py: str) -> str:
    """Where on the segment x1, y1, x2, y2 the foot of a point lies, in the oracle's SQL."""
    k = f"(cos(radians({py})) * 111.32e0)"
    ax, ay, bx, by = f"((x1 - {px}) * {k})", f"((y1 - {py}) * 110.574e0)", f"((x2 - {px}) * {k})", f"((y2 - {py}) * 110.574e0)"
    n = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    return f"(CASE WHEN {n} > 0 THEN greatest(0e0, least(1e0, -({ax} * ({bx} - {ax}) + {ay} * ({by} - {ay})) / {n})) ELSE 0e0 END)"


def seg(px: str, py: str) -> str:
    """Kilometres from a point to the segment x1, y1, x2, y2, in the oracle's SQL."""
    k = f"(cos(radians({py})) * 111.32e0)"
    ax, ay, bx, by = f"((x1 - {px}) * {k})", f"((y1 - {py}) * 110.574e0)", f"((x2 - {px}) * {k})", f"((y2 - {py}) * 110.574e0)"
    t = seg_t(px, py)
    return f"sqrt(pow({ax} + {t} * ({bx} - {ax}), 2) + pow({ay} + {t} * ({by} - {ay}), 2))"
