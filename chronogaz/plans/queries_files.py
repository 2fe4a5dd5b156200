"""Sources and sinks over the driver tables: written in the shared folder in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronogaz.operators import graph as G
from chronogaz.plans import views as V
from chronogaz.plans.registry import query
from chronogaz.sources import records as R


def _folder(spark) -> str:
    return f"{G.shared_root(spark)}/files/{uuid.uuid4().hex}"


@query("""SELECT 'order-' || o_orderkey || '.json' AS file, CASE WHEN bad THEN NULL ELSE o_orderkey END AS id, CASE WHEN bad THEN NULL ELSE o_orderstatus END AS status, CASE WHEN bad THEN NULL ELSE n END::BIGINT AS n_items, CASE WHEN bad THEN 'not a JSON document of this kind' END AS message
FROM (SELECT *, o_orderkey % 10 = 3 OR o_orderkey % 70 = 5 AS bad FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""")
def src1_records(spark, sf):
    """Every order as a JSON document with a file name, some damaged: records with their file, and violations."""
    n = V.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    k = F.col("o_orderkey")
    o = V.read(spark, sf, "orders").join(n, F.col("l_orderkey") == k, "left")
    body = F.to_json(F.struct(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("n").alias("n_items")))
    damaged = F.when(k % 10 == 3, F.concat(F.lit("{"), body)).when(k % 70 == 5, F.expr("substr(body, 1, length(body) - 1)")).otherwise(F.col("body"))
    out = _folder(spark)
    R.write_packed(o.withColumn("body", body).select(F.concat(F.lit("order-"), k.cast("string"), F.lit(".json")).alias("file"), damaged.alias("document")), out)
    good, bad = R.read_records(spark, out, T.StructType().add("id", "long").add("status", "string").add("n_items", "long"), packed=True)
    rows = good.select("file", "id", "status", "n_items", F.lit(None).cast("string").alias("message"))
    return rows.unionByName(bad.select(F.col("path").alias("file"), "message"), allowMissingColumns=True)


@query("SELECT line_id, seq::BIGINT AS seq, floor(lon * 100 + 0.5e0)::BIGINT AS x, floor(lat * 100 + 0.5e0)::BIGINT AS y FROM v_line", ("v_line",))
def src2_features(spark, sf):
    """Lines written as GeoJSON feature collections and read back to a vertex table."""
    at = F.transform(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))), lambda v: F.array(v["lon"], v["lat"]))
    one = V.v_line(spark, sf).groupBy("line_id").agg(at.alias("c"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("line_id").cast("string").alias("id"), F.struct(F.lit("road").alias("kind")).alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")).alias("geometry"))
    out = _folder(spark)
    # a collection of bounded size for each hash, one to a line; the reader takes several collections to a file
    docs = one.groupBy(F.pmod(F.xxhash64("line_id"), F.lit(512)).alias("b")).agg(F.collect_list(feature).alias("features"))
    docs.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(out)
    v = R.vertices(R.read_features(spark, out, lines=True).withColumn("at", F.col("id").cast("long")))
    scaled = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")
    return v.select(F.col("at").alias("line_id"), (F.col("seq") + 1).cast("long").alias("seq"), scaled("lon").alias("x"), scaled("lat").alias("y"))


@query("SELECT 'Book ' || conv_id % 5 AS book, (conv_id // 5 + 1)::INT AS chapter, (turn + 1)::INT AS verse, any_value(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM conversations WHERE conv_id % 5 <> 4 AND turn % 7 <> 6 AND regexp_matches(text, '\\S') GROUP BY 1, 2, 3")
def src3_corpus(spark, sf):
    """A corpus of one verse to a line, with lines off the pattern, an unknown code, and each line twice."""
    c = V.read(spark, sf, "conversations")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    line = F.concat_ws(" ", F.concat(F.lit("C"), (F.col("conv_id") % 5).cast("string")), F.when(F.col("turn") % 7 == 6, "off the pattern").otherwise(F.concat_ws(":", F.floor(F.col("conv_id") / 5) + 1, F.col("turn") + 1)), text)
    out = _folder(spark)
    c.where(F.col("text").rlike(r"\S")).select(F.explode(F.array(line, line)).alias("value")).write.text(out)
    codes = spark.range(4).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("code"), F.concat(F.lit("Book "), F.col("id").cast("string")).alias("book"))
    return R.read_corpus(spark, out, codes)


@query("SELECT slug, max(n)::BIGINT AS n FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE replace(p_name, ' ', '-') END AS slug, p_size AS n FROM part) WHERE slug IS NOT NULL GROUP BY 1")
def src4_lookup(spark, sf):
    """JSON lines keyed by slug: lines without one go, of a repeated one the largest stays."""
    out = _folder(spark)
    p = V.read(spark, sf, "part").select(F.when(F.col("p_partkey") % 9 != 0, F.translate("p_name", " ", "-")).alias("slug"), F.col("p_size").cast("long").alias("n"))
    p.write.json(out)
    return R.read_lookup(spark, out, p.schema, "slug")


@query("SELECT 'c' || c_custkey AS id, floor(c_acctbal * 100 + 0.5e0)::BIGINT AS cents FROM customer WHERE c_custkey % 7 <> 0")
def src5_sidecars(spark, sf):
    """Cost side-cars keyed in their body; those without a key, in files whose names give none, go."""
    out = _folder(spark)
    c = V.read(spark, sf, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("id"), F.floor(F.col("c_acctbal") * 100 + 0.5).cast("long").alias("cents"))
    c.where("id is not null").write.mode("append").json(out)
    return R.read_sidecars(spark, out, c.schema, "id", multiline=False)


@query("SELECT p_partkey AS id, p_name AS name, p_size::BIGINT AS n FROM part")
def snk1_index(spark, sf):
    """A compact index, written in id order and read back."""
    out = _folder(spark)
    p = V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("n"), "p_type")
    R.write_index(p, out, "id", ["name", "n"])
    return spark.read.schema("id long, name string, n long").json(out)


@query("SELECT c_custkey AS id, c_name AS name, n::BIGINT AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def snk2_payloads(spark, sf):
    """One payload for each key, read back from its bucket."""
    out = _folder(spark)
    n = V.read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = V.read(spark, sf, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "n_orders")
    R.write_payloads(c, out, "id")
    back = spark.read.schema("id long, payload string, bucket int").json(out)
    return back.select("id", F.from_json("payload", "name string, n_orders long").alias("p")).select("id", "p.*")


@query("""SELECT 'shapes' AS layer, area_id AS key, count(*)::BIGINT AS n, string_agg(floor(x1)::BIGINT || ' ' || floor(y1)::BIGINT, ',' ORDER BY seq) AS body FROM v_edge GROUP BY 2
UNION ALL SELECT 'roads', road_id, count(*)::BIGINT, string_agg(floor(lon)::BIGINT || ' ' || floor(lat)::BIGINT, ',' ORDER BY seq) FROM v_road GROUP BY 2
UNION ALL SELECT 'edge', a.area_id, count(*)::BIGINT, string_agg(floor(a.x1)::BIGINT || ' ' || floor(a.y1)::BIGINT, ',' ORDER BY a.seq) FROM v_edge a JOIN v_edge b ON a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1 WHERE a.holder < 2 AND b.holder >= 2 GROUP BY 2
UNION ALL SELECT 'timeline', area_id, count(*)::BIGINT, string_agg(f || ':' || t || ':' || holder, ',' ORDER BY f) FROM v_period GROUP BY 2""", ("v_edge", "v_road", "v_period"))
def snk3_layers(spark, sf):
    """The payloads of four layers - shapes, roads, the edge between two sides, each area's timeline - written side by side
    and read back."""
    point = lambda x, y: F.concat_ws(" ", F.floor(x).cast("string"), F.floor(y).cast("string"))

    def layer(df, key, order, body):
        rows = df.groupBy(F.col(key).cast("long").alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("b")))).alias("v"))
        return rows.select("key", F.size("v").cast("long").alias("n"), F.array_join(F.transform("v", lambda x: x["b"]), ",").alias("body"))

    e = V.v_edge(spark, sf)
    other = e.where("holder >= 2").select(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    layers = {
        "shapes": layer(e, "area_id", "seq", point("x1", "y1")),
        "roads": layer(V.v_road(spark, sf), "road_id", "seq", point("lon", "lat")),
        "edge": layer(e.where("holder < 2").join(other, ["x1", "y1", "x2", "y2"], "left_semi"), "area_id", "seq", point("x1", "y1")),
        "timeline": layer(V.v_period(spark, sf), "area_id", "from", F.concat_ws(":", F.col("from").cast("string"), F.col("to").cast("string"), "holder")),
    }
    out = _folder(spark)
    R.write_layers(layers, out)
    back = None
    for name in layers:
        rows = spark.read.schema("key long, n long, body string").parquet(f"{out}/{name}").select(F.lit(name).alias("layer"), "key", "n", "body")
        back = rows if back is None else back.unionByName(rows)
    return back


@query("SELECT o_orderkey AS route, o_custkey AS owner, coalesce(n, 0)::BIGINT AS n_stages, coalesce(stages, '') AS stages FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_suppkey || '-' || l_partkey, ',' ORDER BY l_linenumber, l_suppkey, l_partkey) AS stages FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def snk4_routes(spark, sf):
    """Route payloads: each route with its stages in order, none as an empty list, written and read back."""
    out = _folder(spark)
    routes = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("route"), F.col("o_custkey").alias("owner"))
    stages = V.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), "l_linenumber", F.col("l_suppkey").alias("stop"), F.col("l_partkey").alias("to"))
    R.write_payloads(R.nested(routes, stages, "route", "stages", ["l_linenumber", "stop", "to"]), out, "route")
    back = spark.read.schema("route long, payload string, bucket int").json(out)
    p = back.select("route", F.from_json("payload", "owner long, stages array<struct<l_linenumber:long,stop:long,to:long>>").alias("p"))
    text = F.array_join(F.transform("p.stages", lambda s: F.concat(s["l_linenumber"].cast("string"), F.lit(":"), s["stop"].cast("string"), F.lit("-"), s["to"].cast("string"))), ",")
    return p.select("route", "p.owner", F.size("p.stages").cast("long").alias("n_stages"), text.alias("stages"))
