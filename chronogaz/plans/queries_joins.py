"""Join, set and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogaz.operators import graph as G
from chronogaz.operators import rules
from chronogaz.plans import views as V
from chronogaz.plans.registry import query


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)")
def jon1_missing_parent(spark, sf):
    c = V.read(spark, sf, "customer").where("c_custkey % 10 <> 3")
    return rules.missing_keys(V.read(spark, sf, "orders"), c, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


_CITED = "SELECT doc_id, unnest(['bib:' || (doc_id % 50), 'part:' || (doc_id % 3000)]) AS ref FROM documents"


@query(f"SELECT doc_id, ref FROM ({_CITED}) WHERE ref LIKE 'bib:%' AND substr(ref, 5)::BIGINT NOT IN (SELECT item_id FROM benchmark)")
def jon2_missing_citation(spark, sf):
    refs = _citations(spark, sf).where(F.split_part("ref", F.lit(":"), F.lit(1)) == "bib")
    refs = refs.withColumn("item", F.split_part("ref", F.lit(":"), F.lit(2)).cast("long"))
    return rules.missing_keys(refs, V.read(spark, sf, "benchmark"), "item", "item_id").select("doc_id", "ref")


def _citations(spark, sf):
    """Bracketed, `;`-separated citations at the end of a text (added here: the raw texts hold none)."""
    d = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" [bib:"), (d % 50).cast("string"), F.lit("; part:"), (d % 3000).cast("string"), F.lit("]"))
    docs = V.read(spark, sf, "documents").select("doc_id", text.alias("text"))
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\[((?:bib|part):\d+(?:; (?:bib|part):\d+)*)\]"), F.lit(1)))
    return docs.select("doc_id", found.alias("c")).select("doc_id", F.explode(F.split("c", "; ")).alias("ref"))


@query(_CITED)
def src6_citations(spark, sf):
    return _citations(spark, sf)


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def jon3_resolve_or_fail(spark, sf):
    """A miss fails the job."""
    li, p = V.read(spark, sf, "lineitem"), V.read(spark, sf, "part")
    name = F.when(F.col("p_partkey").isNull(), F.raise_error(F.concat(F.lit("unknown part "), F.col("l_partkey").cast("string"))).cast("string")).otherwise(F.col("p_name"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", name.alias("p_name"), "p_brand")


_STOP = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'location' ELSE 'route-stop' END AS kind, (CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey % 120 END)::BIGINT AS ref_id, (o_orderkey % 5 - 1)::BIGINT AS idx FROM orders"
_DIM = "SELECT 'location' AS kind, c_custkey AS id, [c_name, c_mktsegment, 'n' || c_nationkey] AS cand FROM customer UNION ALL SELECT 'route-stop', s_suppkey, [s_name, 'n' || s_nationkey] FROM supplier"


def _stops(spark, sf):
    o = V.read(spark, sf, "orders")
    even = F.col("o_orderkey") % 2 == 0
    stops = o.select("o_orderkey", F.when(even, "location").otherwise("route-stop").alias("kind"), F.when(even, F.col("o_custkey")).otherwise(F.col("o_orderkey") % 120).alias("id"), (F.col("o_orderkey") % 5 - 1).cast("int").alias("idx"))
    c = V.read(spark, sf, "customer").select(F.lit("location").alias("kind"), F.col("c_custkey").alias("id"), F.array("c_name", "c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("cand"))
    s = V.read(spark, sf, "supplier").select(F.lit("route-stop").alias("kind"), F.col("s_suppkey").alias("id"), F.array("s_name", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("cand"))
    return stops.join(c.unionByName(s), ["kind", "id"], "left")


@query(f"SELECT o_orderkey, d.cand[(greatest(0, least(idx, len(d.cand) - 1)) + 1)::INT] AS stop FROM ({_STOP}) o LEFT JOIN ({_DIM}) d ON d.kind = o.kind AND d.id = o.ref_id")
def jon5_stop_clamped(spark, sf):
    at = F.greatest(F.lit(0), F.least(F.col("idx"), F.size("cand") - 1))
    return _stops(spark, sf).select("o_orderkey", F.get("cand", at).alias("stop"))


@query(f"SELECT o_orderkey, CASE WHEN idx >= 0 THEN d.cand[(idx + 1)::INT] END AS stop FROM ({_STOP}) o LEFT JOIN ({_DIM}) d ON d.kind = o.kind AND d.id = o.ref_id")
def jon5_stop_or_null(spark, sf):
    return _stops(spark, sf).select("o_orderkey", F.when(F.col("idx") >= 0, F.get("cand", F.col("idx"))).alias("stop"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'R' AND k.l_quantity > 45 AND k.l_orderkey = l.l_orderkey AND k.l_partkey = l.l_partkey AND k.l_suppkey = l.l_suppkey)")
def jon6_composite_semi(spark, sf):
    li = V.read(spark, sf, "lineitem")
    return li.join(li.where("l_returnflag = 'R' and l_quantity > 45").select("l_orderkey", "l_partkey", "l_suppkey"), ["l_orderkey", "l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT r.conv_id, count(v.turn)::BIGINT AS n_found, string_agg(v.text, ' ' ORDER BY v.turn) AS passage FROM (SELECT conv_id, conv_id % 3 AS a, conv_id % 3 + 2 AS b FROM (SELECT DISTINCT conv_id FROM conversations)) r
LEFT JOIN conversations v ON v.conv_id = r.conv_id AND v.turn BETWEEN r.a AND r.b GROUP BY r.conv_id""")
def jon7_passage_ranges(spark, sf):
    """Refs start..end become one row for each verse, joined by equality and put together in order."""
    v = V.read(spark, sf, "conversations").select("conv_id", "turn", "text")
    refs = v.select("conv_id").distinct().withColumn("turn", F.explode(F.sequence(F.col("conv_id") % 3, F.col("conv_id") % 3 + 2)))
    got = refs.join(v, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count("text").alias("n_found"), F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", "text")))).alias("p"))
    return got.select("conv_id", "n_found", F.when(F.col("n_found") > 0, F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("passage"))


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE 'o_orderstatus' END AS fields
FROM (SELECT * FROM orders WHERE o_orderkey % 10 <> 1) a FULL OUTER JOIN (SELECT * REPLACE (CASE WHEN o_orderkey % 13 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey % 10 <> 2) b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def jon22_snapshot_diff(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    a = o.where("o_orderkey % 10 <> 1")
    b = o.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")))
    a, b = a.select("o_orderkey", F.struct("o_orderstatus", "o_orderpriority").alias("a")), b.select("o_orderkey", F.struct("o_orderstatus", "o_orderpriority").alias("b"))
    j = a.join(b, "o_orderkey", "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in ("o_orderstatus", "o_orderpriority")]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(fields) > 0, "changed")
    return j.select("o_orderkey", change.alias("change"), F.when(F.col("a").isNull() | F.col("b").isNull(), "").otherwise(F.array_join(fields, ",")).alias("fields")).where("change is not null")


@query("SELECT n_name AS name, 'extra' AS kind FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT r_name, 'missing' FROM region")
def jon24_exact_set(spark, sf):
    """Against the set of the other nations' and all regions' names."""
    n, r = V.read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")), V.read(spark, sf, "region").select(F.col("r_name").alias("name"))
    have, want = n.select("name"), n.where("k % 6 <> 0").select("name").unionByName(r)
    return have.exceptAll(want).withColumn("kind", F.lit("extra")).unionByName(want.exceptAll(have).withColumn("kind", F.lit("missing")))


@query("""SELECT o_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey""")
def jon29_hydrate(spark, sf):
    li = V.read(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("p"))
    o = V.read(spark, sf, "orders").select("o_orderkey")
    parts = F.coalesce(F.transform("p", lambda x: x["l_partkey"].cast("string")), F.array().cast("array<string>"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.array_join(parts, ",").alias("parts"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def set1_base_plus_absent(spark, sf):
    base = V.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    extra = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return base.unionByName(extra.join(base, "id", "left_anti"))


@query("""SELECT l_partkey, min(l_orderkey)::BIGINT AS first_order, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40) GROUP BY l_partkey""")
def set2_mentioned_minus_stops(spark, sf):
    li = V.read(spark, sf, "lineitem")
    left = li.join(li.where("l_returnflag = 'A' and l_quantity > 40").select("l_partkey").distinct(), "l_partkey", "left_anti")
    return left.groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_order"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))


_FLAG = "l_returnflag || l_linestatus"


def _catalogue(spark, sf):
    li = V.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("v"))
    first = li.groupBy("v").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("at"))
    placed = G.positions(first, "at")  # the values' places in first-seen order, by ranges
    return li, placed.select("v", (F.col("pos") - 1).alias("ix"))


@query(f"""SELECT v, (row_number() OVER (ORDER BY pos.a, pos.b, pos.c) - 1)::BIGINT AS ix FROM (SELECT {_FLAG} AS v, min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey)) AS pos FROM lineitem GROUP BY 1)""")
def set5_catalogue(spark, sf):
    return _catalogue(spark, sf)[1]


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'route-1/stage-1' WHEN 'purchase' THEN 'route-2/stage-1' ELSE event_type END AS key FROM events")
def set8_retired_keys(spark, sf):
    old = F.create_map(F.lit("signup"), F.lit("route-1/stage-1"), F.lit("purchase"), F.lit("route-2/stage-1"))
    return V.read(spark, sf, "events").select("event_id", F.coalesce(old[F.col("event_type")], F.col("event_type")).alias("key"))
