"""Records: labels, citations, choices by rank, source arrays, comparison of stored with derived rows, projections."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogaz.functions import text
from chronogaz.operators import textjobs as J
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

#: Earth's radius in metres and the world's width in pixels at zoom 0.
RADIUS, WORLD = 6378137.0, 256.0


@query('SELECT area_id, id, f AS "from", t AS "to", holder, note FROM v_period', ("v_period",))
def prj3_strip_provenance(spark, sf):
    return V.v_period(spark, sf).drop("sources")


@query("SELECT line_id, string_agg(lon::BIGINT || ' ' || lat::BIGINT, ',' ORDER BY seq) AS path, count(*) AS n_points FROM (SELECT line_id, seq, lon, lat, lag(lon) OVER w IS NOT DISTINCT FROM lon AND lag(lat) OVER w IS NOT DISTINCT FROM lat AS same FROM (SELECT line_id, seq, floor(lon) AS lon, floor(lat) AS lat FROM v_line) WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE NOT same GROUP BY 1 HAVING count(*) >= 2", ("v_line",))
def prj4_straight_line(spark, sf):
    w = Window.partitionBy("line_id").orderBy("seq")
    p = V.v_line(spark, sf).select("line_id", "seq", F.floor("lon").alias("lon"), F.floor("lat").alias("lat"))
    p = p.withColumn("same", F.lag("lon").over(w).eqNullSafe(F.col("lon")) & F.lag("lat").over(w).eqNullSafe(F.col("lat"))).where("not same")
    at = F.sort_array(F.collect_list(F.struct("seq", F.concat_ws(" ", "lon", "lat").alias("p"))))
    return p.groupBy("line_id").agg(F.array_join(F.transform(at, lambda x: x.p), ",").alias("path"), F.count("*").alias("n_points")).where("n_points >= 2")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN p_brand END, CASE WHEN p_size % 4 = 1 THEN p_type END, p_name) AS name FROM part")
def prj6_display_name(spark, sf):
    n = F.col("p_size") % 4
    return V.read(spark, sf, "part").select("p_partkey", F.coalesce(F.when(n == 0, F.col("p_brand")), F.when(n == 1, F.col("p_type")), F.col("p_name")).alias("name"))


@query("WITH o AS (SELECT p_partkey AS k, 3 AS lo, 8 AS hi FROM part WHERE p_partkey % 50 = 0) SELECT p_partkey, coalesce(lo, p_size % 5) AS lo, coalesce(hi, p_size % 5 + 6) AS hi FROM part LEFT JOIN o ON k = p_partkey WHERE p_partkey % 12 >= coalesce(lo, p_size % 5) AND p_partkey % 12 < coalesce(hi, p_size % 5 + 6)")
def flt5_zoom_range(spark, sf):
    p = V.read(spark, sf, "part").select("p_partkey", "p_size")
    o = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("k"), F.lit(3).alias("lo"), F.lit(8).alias("hi"))
    rows = p.join(o, F.col("k") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("lo", F.col("p_size") % 5).alias("lo"), F.coalesce("hi", F.col("p_size") % 5 + 6).alias("hi"))
    return rows.where("p_partkey % 12 >= lo and p_partkey % 12 < hi")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 3 THEN 'banned' ELSE 'not listed' END AS message FROM part WHERE p_size % 5 = 3 OR p_size % 5 NOT IN (p_size % 4, p_partkey % 5)")
def flt9_coordinate_source(spark, sf):
    source = lambda n: F.concat(F.lit("w:"), n.cast("string"))
    p = V.read(spark, sf, "part").select("p_partkey", source(F.col("p_size") % 5).alias("own"), F.array(source(F.col("p_size") % 4), source(F.col("p_partkey") % 5)).alias("sources"))
    banned = F.col("own").startswith("w:3")
    return p.where(banned | ~F.array_contains("sources", F.col("own"))).select("p_partkey", F.when(banned, "banned").otherwise("not listed").alias("message"))


@query("SELECT p_partkey FROM part WHERE (p_partkey + 1) % 3 > 0 AND (p_size % 3 < 1 OR (p_partkey + 2) % 3 > 0) AND (p_size % 3 < 2 OR (p_partkey + 3) % 3 > 0)")
def flt10_only_one_kind_of_source(spark, sf):
    one = lambda i: F.when((F.col("p_partkey") + i) % 3 > 0, "wikipedia:").otherwise("doi:")
    sources = F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int") % 3 + 1), one)
    return V.read(spark, sf, "part").where(F.forall(sources, lambda x: x.startswith("wikipedia:"))).select("p_partkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def flt12_hide_represented(spark, sf):
    n, s = V.read(spark, sf, "nation"), V.read(spark, sf, "supplier").where("s_suppkey % 3 = 0")
    linked = F.col("n_nationkey") == F.col("s_nationkey")
    seen = n.where("n_nationkey % 5 = 0").unionByName(n.where("n_nationkey % 5 <> 0").join(s, linked, "left_anti"))
    return seen.select("n_nationkey", "n_name")


@query("SELECT id, area_id FROM v_site, (SELECT area_id, min(x1) - 1.2e0 AS w, max(x1) + 1.2e0 AS e, min(y1) - 1.2e0 AS s, max(y1) + 1.2e0 AS n FROM v_edge GROUP BY 1) WHERE lon BETWEEN w AND e AND lat BETWEEN s AND n", ("v_site", "v_edge"))
def jon26_pin_in_expanded_box(spark, sf):
    """Boxes are dealt to the degree cells that they touch; each pin lies in one cell."""
    box = V.v_edge(spark, sf).groupBy("area_id").agg((F.min("x1") - 1.2).alias("w"), (F.max("x1") + 1.2).alias("e"), (F.min("y1") - 1.2).alias("s"), (F.max("y1") + 1.2).alias("n"))
    box = box.withColumn("cx", F.explode(F.sequence(F.floor("w"), F.floor("e")))).withColumn("cy", F.explode(F.sequence(F.floor("s"), F.floor("n"))))
    pins = V.v_site(spark, sf).withColumns({"cx": F.floor("lon"), "cy": F.floor("lat")})
    return pins.join(box, ["cx", "cy"]).where("lon between w and e and lat between s and n").select("id", "area_id")


@query("SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY place, l_suppkey) AS suppliers FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def agg6_first_seen_order(spark, sf):
    at = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    return V.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(at, lambda x: x.l_suppkey.cast("string"))), ",").alias("suppliers"))


@query("SELECT o_custkey, count_if(o_orderkey % 3 = 0) || ' mapped, ' || count_if(o_orderkey % 3 <> 0) || ' unmapped' AS summary FROM orders GROUP BY 1")
def agg20_summary_text(spark, sf):
    mapped = F.col("o_orderkey") % 3 == 0
    return V.read(spark, sf, "orders").groupBy("o_custkey").agg(F.format_string("%d mapped, %d unmapped", F.count_if(mapped), F.count_if(~mapped)).alias("summary"))


_BAND = "CASE WHEN p_partkey % 97 = 0 THEN 0 WHEN p_size > 45 THEN 1 WHEN p_type LIKE 'STANDARD%' THEN 2 ELSE 3 END"


@query(f"SELECT p_partkey, {_BAND} AS band, row_number() OVER (PARTITION BY p_brand, {_BAND} ORDER BY p_size DESC, p_partkey) AS priority FROM part")
def win12_label_priority(spark, sf):
    p = V.read(spark, sf, "part").withColumn("band", F.expr(_BAND))
    w = Window.partitionBy("p_brand", "band").orderBy(F.desc("p_size"), "p_partkey")
    return p.select("p_partkey", "band", F.row_number().over(w).alias("priority"))


@query("SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size % 2, p_size % 3 DESC, length(p_name), p_retailprice DESC, p_size, p_name, p_partkey) = 1")
def win16_label_choice(spark, sf):
    """The candidate that seven keys put first."""
    n = F.col("p_size")
    w = Window.partitionBy("p_brand", "p_type").orderBy(n % 2, (n % 3).desc(), F.length("p_name"), F.desc("p_retailprice"), n, "p_name", "p_partkey")
    return V.read(spark, sf, "part").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("p_brand", "p_type", "p_partkey")


@query("SELECT l_orderkey, l_suppkey, 'repeated' AS message FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, 'endpoint' FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_custkey = l_suppkey")
def set3_mentioned_once(spark, sf):
    m = V.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    o = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_suppkey"))
    twice = m.where("n > 1").select("l_orderkey", "l_suppkey", F.lit("repeated").alias("message"))
    return twice.unionByName(m.join(o, ["l_orderkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_suppkey", F.lit("endpoint").alias("message")))


@query("SELECT area_id, holder, string_agg(DISTINCT 'o:' || id, ',' ORDER BY 'o:' || id) AS sources FROM v_period GROUP BY 1, 2", ("v_period",))
def set4_union_of_sources(spark, sf):
    one = V.v_period(spark, sf).select("area_id", "holder", F.explode("sources").alias("s")).distinct()
    return one.groupBy("area_id", "holder").agg(F.array_join(F.array_sort(F.collect_list("s")), ",").alias("sources"))


@query(r"SELECT p_partkey, lower(trim(nfc_normalize(p_name))) AS key, trim(regexp_replace(lower(p_type), '\s+', ' ', 'g')) AS spaced FROM part")
def str3_keys(spark, sf):
    return V.read(spark, sf, "part").select("p_partkey", text.key_fold(F.col("p_name")).alias("key"), text.space_fold(F.col("p_type")).alias("spaced"))


@query("""WITH b AS (SELECT p_name AS n FROM part UNION SELECT c_name FROM customer UNION SELECT p_brand FROM part)
SELECT a.n AS one, b.n AS other FROM b a, b WHERE a.n < b.n AND abs(length(a.n) - length(b.n)) <= 1 AND (levenshtein(a.n, b.n) <= 1 OR length(a.n) = length(b.n) AND hamming(a.n, b.n) = 2 AND list_sort(string_split(a.n, '')) = list_sort(string_split(b.n, '')))""")
def str4_one_edit_or_swap(spark, sf):
    """Pairs of names of parts, brands and customers within one edit or one swap of any two places."""
    name = lambda t, c: V.read(spark, sf, t).select(F.col(c).alias("name"))
    return J.near_names(name("part", "p_name").unionByName(name("customer", "c_name")).unionByName(name("part", "p_brand")))


@query("SELECT p_brand, string_agg(n, ', ' ORDER BY n) AS also FROM (SELECT p_brand, min(p_type) AS n FROM part GROUP BY p_brand, lower(p_type)) GROUP BY 1")
def str9_also_known_as(spark, sf):
    one = V.read(spark, sf, "part").groupBy("p_brand", F.lower("p_type").alias("k")).agg(F.min("p_type").alias("n"))
    return one.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("n")), ", ").alias("also"))


@query("SELECT p_partkey, CASE WHEN w <= 330 THEN 330 WHEN w <= 500 THEN 500 WHEN w <= 960 THEN 960 ELSE 1280 END AS width, 'thumb/' || CASE WHEN w <= 330 THEN 330 WHEN w <= 500 THEN 500 WHEN w <= 960 THEN 960 ELSE 1280 END || 'px-' || p_partkey || '.jpg' AS url FROM (SELECT p_partkey, p_size * 30 AS w FROM part)")
def str11_thumbnail(spark, sf):
    """The smallest rung of the width ladder that holds the wanted width."""
    w = F.col("p_size") * 30
    width = F.when(w <= 330, 330).when(w <= 500, 500).when(w <= 960, 960).otherwise(1280)
    return V.read(spark, sf, "part").select("p_partkey", width.alias("width"), F.concat_ws("", F.lit("thumb/"), width, F.lit("px-"), "p_partkey", F.lit(".jpg")).alias("url"))


@query("SELECT p_partkey, p_size * 60 < 1200 AS narrow, p_size * 60 > 2.2e0 * (p_partkey % 700 + 300) AS wide FROM part WHERE p_size * 60 < 1200 OR p_size * 60 > 2.2e0 * (p_partkey % 700 + 300)")
def str14_media_warnings(spark, sf):
    w, h = F.col("p_size") * 60, F.col("p_partkey") % 700 + 300
    return V.read(spark, sf, "part").select("p_partkey", (w < 1200).alias("narrow"), (w > F.lit(2.2).cast("double") * h).alias("wide")).where("narrow or wide")


@query(f"SELECT id, floor((lon + 180) / 360 * {WORLD * 64}e0)::BIGINT AS px, floor((0.5e0 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * {WORLD * 64}e0)::BIGINT AS py FROM v_site", ("v_site",))
def geo9_pixels(spark, sf):
    """Pixels of the world map at zoom 6."""
    pi = math.pi
    y = F.log(F.tan(F.lit(pi / 4) + F.radians("lat") / 2))
    return V.v_site(spark, sf).select("id", F.floor((F.col("lon") + 180) / 360 * (WORLD * 64)).alias("px"), F.floor((F.lit(0.5) - y / (2 * pi)) * (WORLD * 64)).alias("py"))
