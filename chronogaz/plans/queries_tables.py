"""Projections, filters, aggregations, windows, sorts and sink checks over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogaz.functions import geo, text
from chronogaz.operators import graph as G
from chronogaz.operators import rules
from chronogaz.operators.graph import checkpointed
from chronogaz.plans import views as V
from chronogaz.plans.registry import query


@query("SELECT id, floor(lon * 10 + 0.5e0) / 10e0 AS lon, floor(lat * 10 + 0.5e0) / 10e0 AS lat FROM v_site", ("v_site",))
def prj2_round_coordinates(spark, sf):
    return V.v_site(spark, sf).select("id", geo.round_half_up(F.col("lon"), 1).alias("lon"), geo.round_half_up(F.col("lat"), 1).alias("lat"))


@query("SELECT o_orderkey, o_custkey, coalesce(n, 0)::BIGINT AS n_items, coalesce(note, '') AS note FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END AS note FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def prj1_index_projection(spark, sf):
    n = V.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = V.read(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")))
    return o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("note", F.lit("")).alias("note"))


@query("SELECT id FROM v_site WHERE lon BETWEEN -5 AND 30 AND lat BETWEEN 25 AND 40", ("v_site",))
def flt1_inside_bounds(spark, sf):
    return V.v_site(spark, sf).where(geo.inside_bounds(F.col("lon"), F.col("lat"), -5.0, 25.0, 30.0, 40.0)).select("id")


@query("""SELECT line_id, area_id FROM (SELECT line_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM v_line GROUP BY 1) l,
(SELECT area_id, min(x1) AS w2, max(x1) AS e2, min(y1) AS s2, max(y1) AS n2 FROM v_edge GROUP BY 1) WHERE w <= e2 AND w2 <= e AND s <= n2 AND s2 <= n""", ("v_line", "v_edge"))
def flt2_boxes_intersect(spark, sf):
    """Areas are dealt to the 12 x 6 degree cells that they touch, lines to those of their box; a pair is kept in its first
    shared cell. Areas are written, as their size lets Spark send them to the lines."""
    cell = lambda c, size: F.floor(F.col(c) / size)
    cells = lambda df, w, e, s, n: df.withColumn("cx", F.explode(F.sequence(cell(w, 12), cell(e, 12)))).withColumn("cy", F.explode(F.sequence(cell(s, 6), cell(n, 6))))
    a = cells(V.line_boxes(spark, sf), "w", "e", "s", "n")
    b = V.v_edge(spark, sf).groupBy("area_id").agg(F.min("x1").alias("w2"), F.max("x1").alias("e2"), F.min("y1").alias("s2"), F.max("y1").alias("n2"))
    b = checkpointed(cells(b, "w2", "e2", "s2", "n2"))
    first = (F.col("cx") == F.greatest(cell("w", 12), cell("w2", 12))) & (F.col("cy") == F.greatest(cell("s", 6), cell("s2", 6)))
    return a.join(b, ["cx", "cy"]).where(first).where("w <= e2 and w2 <= e and s <= n2 and s2 <= n").select("line_id", "area_id")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'site' ELSE 'town' END AS tier, p_size AS zoom FROM part WHERE CASE p_size % 3 WHEN 0 THEN p_size BETWEEN 4 AND 9 WHEN 1 THEN p_size >= 12 ELSE p_size >= 6 END")
def flt4_zoom_visibility(spark, sf):
    tier = F.when(F.col("p_size") % 3 == 0, "region").when(F.col("p_size") % 3 == 1, "site").otherwise("town")
    seen = F.when(F.col("tier") == "region", F.col("p_size").between(4, 9)).when(F.col("tier") == "site", F.col("p_size") >= 12).otherwise(F.col("p_size") >= 6)
    return V.read(spark, sf, "part").withColumn("tier", tier).where(seen).select("p_partkey", "tier", F.col("p_size").alias("zoom"))


@query("SELECT p_partkey, CASE WHEN p_size > 45 THEN 'major' WHEN p_type LIKE 'STANDARD%' THEN 'area' WHEN p_size % 2 = 0 THEN 'clustered' WHEN p_retailprice > 1000 THEN 'candidate' ELSE 'site' END AS output FROM part")
def flt6_route_to_outputs(spark, sf):
    out = F.when(F.col("p_size") > 45, "major").when(F.col("p_type").startswith("STANDARD"), "area").when(F.col("p_size") % 2 == 0, "clustered").when(F.col("p_retailprice") > 1000, "candidate").otherwise("site")
    return V.read(spark, sf, "part").select("p_partkey", out.alias("output"))


@query("""SELECT 'size-required' AS rule_id, 'error' AS severity, p_partkey::VARCHAR AS path, 'size under 5' AS message FROM part WHERE p_size < 5
UNION ALL SELECT 'brand-form', 'warning', p_partkey::VARCHAR, 'brand ' || p_brand FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]$')
UNION ALL SELECT 'price', 'error', p_partkey::VARCHAR, 'price for type' FROM part WHERE p_type LIKE 'PROMO%' AND p_retailprice > 1500""")
def flt7_conditional_fields(spark, sf):
    p = V.read(spark, sf, "part")
    k = F.col("p_partkey")
    return rules.report(
        rules.violation(p.where("p_size < 5"), "size-required", k, F.lit("size under 5")),
        rules.violation(p.where(~F.col("p_brand").rlike("^Brand#[1-3][0-9]$")), "brand-form", k, F.concat(F.lit("brand "), "p_brand"), "warning"),
        rules.violation(p.where(F.col("p_type").startswith("PROMO") & (F.col("p_retailprice") > 1500)), "price", k, F.lit("price for type")),
    )


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '\\b(red|blue|steel|green)\\b') AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def flt8_name_rule(spark, sf):
    hit = V.read(spark, sf, "part").where(F.col("p_name").rlike(r"\b(red|blue|steel|green)\b"))
    return hit.join(V.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*)::BIGINT AS n, floor(sum(l_quantity) + 0.5e0)::BIGINT AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg1_cost_rollup(spark, sf):
    li = V.read(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus")
    return li.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.floor(F.sum("l_quantity") + 0.5).cast("long").alias("qty"))


@query("SELECT p_name AS key, count(*)::BIGINT AS n, string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS members FROM part GROUP BY p_name HAVING count(*) > 1")
def agg2_duplicate_keys(spark, sf):
    return rules.duplicates(V.read(spark, sf, "part"), F.col("p_name"), "p_partkey")


@query("SELECT p_brand, lower(trim(p_name)) AS name, count(*)::BIGINT AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def agg3_duplicate_labels(spark, sf):
    return V.read(spark, sf, "part").groupBy("p_brand", text.key_fold(F.col("p_name")).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderstatus, o_orderpriority, 'c' || o_custkey % 3, o_orderstatus, 'c' || o_orderkey % 3])), ',') AS ids FROM orders")
def agg5_distinct_sources(spark, sf):
    c = lambda k: F.concat(F.lit("c"), (F.col(k) % 3).cast("string"))
    arrays = F.flatten(F.array(F.array("o_orderstatus", "o_orderpriority"), F.array(c("o_custkey"), F.col("o_orderstatus")), F.array(c("o_orderkey"))))
    return V.read(spark, sf, "orders").select("o_orderkey", F.array_join(F.sort_array(F.array_distinct(arrays)), ",").alias("ids"))


@query("SELECT line_id, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM v_line GROUP BY 1", ("v_line",))
def agg8_extent(spark, sf):
    return V.v_line(spark, sf).groupBy("line_id").agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


_P = "list_element(v, (floor((n - 1) * {}e0) + 1)::BIGINT)"


@query(f"SELECT event_type, n, {_P.format(0.5)} AS p50, {_P.format(0.95)} AS p95, {_P.format(0.99)} AS p99 FROM (SELECT event_type, count(value)::BIGINT AS n, list(value ORDER BY value) AS v FROM events GROUP BY 1)")
def agg14_index_percentiles(spark, sf):
    """The value at index floor((n - 1) * f): equal values are counted first, a running count over ranges finds the index."""
    e = V.read(spark, sf, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    run = G.running(e, "event_type", "value", "c")
    total = run.groupBy("event_type").agg(F.max("upto").alias("n"))
    at = lambda f: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * f), F.col("value")))
    return run.join(total, "event_type").groupBy("event_type", "n").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("SELECT event_type, median(value) AS median, median(value) > 40 AS over FROM events GROUP BY 1")
def agg15_median_gate(spark, sf):
    """The median as the mean of the two middle values, found by running counts, and whether it is over the limit."""
    e = V.read(spark, sf, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    run = G.running(e, "event_type", "value", "c")
    total = run.groupBy("event_type").agg(F.max("upto").alias("n"))
    at = lambda f: F.min(F.when(F.col("upto") > f((F.col("n") - 1) / 2), F.col("value")))
    g = run.join(total, "event_type").groupBy("event_type").agg(at(F.floor).alias("lo"), at(F.ceil).alias("hi"))
    mid = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) / 2)
    every = V.read(spark, sf, "events").select("event_type").distinct()
    return every.join(g, "event_type", "left").select("event_type", mid.alias("median"), (mid > 40).alias("over"))


@query("SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1 UNION ALL SELECT c_name, min(c_custkey) FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1")
def agg19_unambiguous_names(spark, sf):
    n = V.read(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.lit(0).alias("k")).unionByName(V.read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.lit(1).alias("k")))
    return n.groupBy("k", "name").agg(F.min("id").alias("id"), F.max("id").alias("_m")).where("id = _m").select("name", "id")


@query("SELECT l_suppkey, min(l_orderkey)::BIGINT AS first_order, count(DISTINCT l_partkey)::BIGINT AS n_parts, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def agg23_stop_points(spark, sf):
    return V.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first_order"), F.count_distinct("l_partkey").alias("n_parts"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::BIGINT AS rn FROM lineitem) WHERE rn <> l_linenumber")
def win5_sequence_numbers(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return V.read(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w).cast("long")).where("rn <> l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "rn")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 40)::INT DESC, p_retailprice DESC, p_partkey)::BIGINT AS rank FROM part")
def win11_importance_rank(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc(F.col("p_size") > 40), F.desc("p_retailprice"), "p_partkey")
    return V.read(spark, sf, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("rank"))


@query("SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def win14_drop_consecutive(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return V.read(spark, sf, "events").withColumn("p", F.lag("event_type").over(w)).where(~F.col("event_type").eqNullSafe(F.col("p"))).select("event_id", "user_id")


@query("SELECT id, lon, lat FROM v_site ORDER BY lat, lon, id LIMIT 50", ("v_site",))
def srt3_reading_order(spark, sf):
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    return V.v_site(spark, sf).orderBy(y, x, "id").limit(50)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_size DESC, p_partkey LIMIT 200")
def srt5_visible_cap(spark, sf):
    return V.read(spark, sf, "part").orderBy(F.desc("p_size"), "p_partkey").limit(200).select("p_partkey", "p_name")


@query("SELECT o_orderkey, CASE WHEN y < 0 THEN abs(y) || ' BC' ELSE 'AD ' || y END AS year, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN y < 0 THEN 'from ' || abs(y) || ' BC' ELSE 'from AD ' || y END ELSE (CASE WHEN y < 0 THEN abs(y) || ' BC' ELSE 'AD ' || y END) || ' to ' || (CASE WHEN y + 30 < 0 THEN abs(y + 30) || ' BC' ELSE 'AD ' || (y + 30) END) END AS span FROM (SELECT o_orderkey, o_custkey % 200 - 100 AS y FROM orders) WHERE y <> 0 AND y <> -30")
def str6_year_text(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 200 - 100).alias("y")).where("y <> 0 and y <> -30")
    end = F.when(F.col("o_orderkey") % 4 != 0, F.col("y") + 30)
    return o.select("o_orderkey", text.year_text(F.col("y")).alias("year"), text.range_text(F.col("y"), end).alias("span"))
