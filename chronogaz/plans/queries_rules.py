"""Rules as the records need them: rings, names, passages, sources, mentions, search, chains, histories, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogaz.functions import text as X
from chronogaz.operators import graph as G
from chronogaz.operators import spatial as S
from chronogaz.operators import textjobs as J
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

# -- rings

_RING = "SELECT line_id, seq, CASE WHEN (line_id * 7 + seq) % 97 = 0 THEN 0e0 ELSE lon END AS lon, CASE WHEN (line_id * 7 + seq) % 97 = 0 THEN 0e0 WHEN (line_id + seq) % 101 = 0 THEN 95e0 ELSE lat END AS lat FROM v_line"


def _rings(spark, sf):
    """Lines as rings: every third is closed by its first vertex; some vertices are [0, 0] or out of range."""
    p, k = V.v_line(spark, sf), F.col("line_id") * 7 + F.col("seq")
    bad = p.select("line_id", "seq", F.when(k % 97 == 0, 0.0).otherwise(F.col("lon")).alias("lon"), F.when(k % 97 == 0, 0.0).when((F.col("line_id") + F.col("seq")) % 101 == 0, 95.0).otherwise(F.col("lat")).alias("lat"))
    first = bad.where("seq = 1 and line_id % 3 = 0").select("line_id", F.lit(1000).alias("seq"), "lon", "lat")
    return bad.unionByName(first)


@query(f""", r AS ({_RING} UNION ALL SELECT line_id, 1000, lon, lat FROM ({_RING}) WHERE seq = 1 AND line_id % 3 = 0),
g AS (SELECT line_id, count(*) AS n, arg_min(lon, seq) = arg_max(lon, seq) AND arg_min(lat, seq) = arg_max(lat, seq) AS closed, bool_or(lon = 0 AND lat = 0) AS zero, bool_or(abs(lon) > 180 OR abs(lat) > 90) AS far FROM r GROUP BY 1)
SELECT line_id, array_to_string(list_filter([CASE WHEN n < 4 THEN 'fewer than four points' END, CASE WHEN NOT closed THEN 'not closed' END, CASE WHEN zero THEN 'holds [0, 0]' END, CASE WHEN far THEN 'out of range' END], lambda x: x IS NOT NULL), '; ') AS broken FROM g WHERE n < 4 OR NOT closed OR zero OR far""", ("v_line",))
def flt11_ring_rules(spark, sf):
    """Rings of at least four points, the last equal to the first, none at [0, 0], all in range."""
    p = F.struct("lon", "lat")
    g = _rings(spark, sf).groupBy("line_id").agg(F.count("*").alias("n"), F.min_by(p, "seq").alias("a"), F.max_by(p, "seq").alias("z"), F.bool_or((F.col("lon") == 0) & (F.col("lat") == 0)).alias("zero"), F.bool_or((F.abs("lon") > 180) | (F.abs("lat") > 90)).alias("far"))
    broken = F.array_compact(F.array(F.when(F.col("n") < 4, "fewer than four points"), F.when(F.col("a") != F.col("z"), "not closed"), F.when(F.col("zero"), "holds [0, 0]"), F.when(F.col("far"), "out of range")))
    return g.select("line_id", F.array_join(broken, "; ").alias("broken")).where("broken <> ''")


@query("""SELECT area_id, floor(greatest(0, outer_km2 - coalesce(hole_km2, 0)) + 0.5e0)::BIGINT AS km2 FROM (SELECT area_id, abs(sum(radians(x2 - x1) * (sin(radians(y1)) + sin(radians(y2))))) * 6371.0088e0 * 6371.0088e0 / 2 AS outer_km2 FROM v_edge GROUP BY 1)
LEFT JOIN (SELECT area_id, sum(k) AS hole_km2 FROM (SELECT area_id, s, abs(sum(radians((x2 - x1) * s) * (sin(radians(cy + (y1 - cy) * s)) + sin(radians(cy + (y2 - cy) * s))))) * 6371.0088e0 * 6371.0088e0 / 2 AS k FROM (SELECT *, 20 + (area_id // 5) * 6 + 3e0 AS cy, unnest([0.25e0, 0.5e0, 0.9e0]) AS s FROM v_edge) WHERE area_id % 4 = 0 AND (s < 0.9e0 OR area_id % 8 = 0) GROUP BY area_id, s) GROUP BY 1) USING (area_id)""", ("v_edge",))
def agg10_area_with_holes(spark, sf):
    """Spherical square kilometres of the outer ring less the holes, zero at least. Holes are the area's ring drawn smaller."""
    e = V.v_edge(spark, sf).withColumn("ring", F.lit(0))
    cx, cy = F.lit(-10.0) + (F.col("area_id") % 5) * 12 + 6, F.lit(20.0) + F.floor(F.col("area_id") / 5) * 6 + 3
    s = F.col("s")
    scaled = e.where("area_id % 4 = 0").withColumn("s", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))).where("s < 0.9 or area_id % 8 = 0")
    holes = scaled.select("area_id", (s * 100).cast("int").alias("ring"), *[(c + (F.col(f"{n}{i}") - c) * s).alias(f"{n}{i}") for i in (1, 2) for n, c in (("x", cx), ("y", cy))])
    return S.rings_km2(e.select("area_id", "ring", "x1", "y1", "x2", "y2").unionByName(holes), "area_id").select("area_id", F.floor(F.col("km2") + 0.5).cast("long").alias("km2"))


# -- names

_NAMED = "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper('Place ' || c_custkey // 2) ELSE '  place ' || c_custkey // 2 END AS name FROM customer"


@query(f"SELECT a.id AS a, b.id AS b, lower(trim(a.name)) AS name FROM ({_NAMED}) a JOIN ({_NAMED}) b ON lower(trim(a.name)) = lower(trim(b.name)) AND a.id < b.id WHERE NOT (a.id // 2 % 5 = 0)")
def jon14_same_names(spark, sf):
    """Pairs of places with equal names after trimming and folding, but for the allowed pairs."""
    half = F.floor(F.col("c_custkey") / 2).cast("string")
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper(F.concat(F.lit("Place "), half))).otherwise(F.concat(F.lit("  place "), half))
    p = G.checkpointed(V.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.key_fold(name).alias("name")))  # folded once
    allowed = p.where("floor(id / 2) % 5 = 0").groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
    return J.same_names(p, allowed)


@query("SELECT p_partkey, n || ' / ' || CASE WHEN n[1] = lower(n[1]) THEN upper(n[1]) ELSE lower(n[1]) END || n[2:] AS variants FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN 'la ' || p_name ELSE p_name END AS n FROM part) WHERE regexp_matches(n, '^(The|the|La|la) ') UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 4 > 1 AND NOT regexp_matches(p_name, '^(The|the|La|la) ')")
def str13_name_variants(spark, sf):
    """A name that opens with a connector word stands with it in both cases; others stand alone."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("The "), "p_name")).when(k == 1, F.concat(F.lit("la "), "p_name")).otherwise(F.col("p_name"))
    return V.read(spark, sf, "part").select("p_partkey", F.array_join(X.name_variants(name, ("the", "la")), " / ").alias("variants"))


_Q = ("red", "steel", "brazl", "ste", "blue", "gren")


@query("""SELECT q, id, name, rank::BIGINT AS rank, pos::BIGINT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, pref, f, id) AS pos FROM (
SELECT q, id, name, f, CASE WHEN f = q THEN 0 WHEN starts_with(f, q) OR contains(f, ' ' || q) THEN 1 WHEN length(q) >= 5 AND list_bool_or(list_transform(string_split(f, ' '), lambda x: levenshtein(x, q) <= 1)) THEN 2 END AS rank, CASE WHEN starts_with(f, q) THEN 0 ELSE 1 END AS pref
FROM (SELECT p_partkey AS id, p_name AS name, lower(strip_accents(p_name)) AS f FROM part), (""" + " UNION ALL ".join(f"SELECT '{q}' AS q" for q in _Q) + """)) WHERE rank IS NOT NULL) WHERE pos <= 8""")
def srt1_search_top8(spark, sf):
    """The first eight places of each search: rank, prefix rank, folded title, id."""
    p = V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return J.ranked_search(p, _Q, 8, "id").select("q", "id", "name", "rank", "pos")


# -- passages

_REFS = "SELECT conv_id, conv_id % 3 AS a, conv_id % 3 + 2 AS b FROM (SELECT DISTINCT conv_id FROM conversations)"
_PASSAGE = f"SELECT r.conv_id, count(v.turn) AS n, 3 AS need, min(v.turn) = any_value(r.a) AND max(v.turn) = any_value(r.b) AS tips, string_agg(v.text, ' ' ORDER BY v.turn) AS passage FROM ({_REFS}) r LEFT JOIN {{v}} v ON v.conv_id = r.conv_id AND v.turn BETWEEN r.a AND r.b GROUP BY r.conv_id"


def _passages(spark, sf, verses):
    refs = V.read(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 3).alias("first"), (F.col("conv_id") % 3 + 2).alias("last"))
    return J.passages(refs, verses, "conv_id", "turn", "text")


@query("SELECT conv_id, CASE WHEN n = 0 THEN 'no verse' WHEN n < need AND tips THEN 'missing interior verse' WHEN n < need THEN 'missing end verse' END AS error, CASE WHEN n = need THEN passage END AS passage FROM (" + _PASSAGE.format(v="(SELECT * FROM conversations WHERE (conv_id * 3 + turn) % 11 <> 0)") + ")")
def jon7_passage_or_error(spark, sf):
    """A reference's verses in order; a missing verse, inside or at an end, is an error and gives no passage."""
    v = V.read(spark, sf, "conversations").where("(conv_id * 3 + turn) % 11 <> 0").select("conv_id", "turn", "text")
    return _passages(spark, sf, v).select("conv_id", "error", "passage")


@query("SELECT a.conv_id, a.passage IS DISTINCT FROM b.passage AS stale, CASE WHEN a.passage IS DISTINCT FROM b.passage THEN b.passage END AS fill FROM (" + _PASSAGE.format(v="(SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN upper(text) ELSE text END AS text FROM conversations WHERE conv_id % 13 <> 0)") + ") a JOIN (" + _PASSAGE.format(v="conversations") + ") b USING (conv_id)")
def txt4_stale_text(spark, sf):
    """Stored passages, made from an older snapshot, against the corpus; what must be filled in."""
    v = V.read(spark, sf, "conversations").select("conv_id", "turn", "text")
    old = v.where("conv_id % 13 <> 0").withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.upper("text")).otherwise(F.col("text")))
    stored = _passages(spark, sf, old).select("conv_id", F.col("found").alias("stored"))
    now = _passages(spark, sf, v).select("conv_id", F.col("found").alias("now"))
    stale = ~F.col("stored").eqNullSafe(F.col("now"))
    return stored.join(now, "conv_id").select("conv_id", stale.alias("stale"), F.when(stale, F.col("now")).alias("fill"))


@query("""WITH nm AS (SELECT p_partkey AS place, unnest(string_split(p_name, ' ')) AS name FROM part), pl AS (SELECT doc_id, doc_id % 2000 AS place, lower(strip_accents(coalesce(text, '') || ' ' || CASE WHEN doc_id % 3 = 0 THEN (SELECT p_name FROM part WHERE p_partkey = doc_id % 2000) ELSE '' END)) AS f FROM documents)
SELECT doc_id, place FROM pl WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.place = pl.place AND contains(f, lower(nm.name)))""")
def txt5_no_name_in_passage(spark, sf):
    """Passages that hold none of their own place's names, as substrings of the folded text. (A third of the texts get
    their place's name put in, as the driver's texts name no part.)"""
    names = V.read(spark, sf, "part").select(F.col("p_partkey").alias("place"), "p_name", F.split("p_name", " ").alias("names"))
    d = V.read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2000).alias("place"), "text").join(names, "place", "left")
    own = F.when(F.col("doc_id") % 3 == 0, F.coalesce("p_name", F.lit(""))).otherwise("")
    return J.without_names(d.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), own)), "text", "names").select("doc_id", "place")


# -- records

_ALLOWED = "('STANDARD', 'SMALL', 'MEDIUM')"


@query(f"""SELECT p_partkey::VARCHAR AS path, unnest(list_filter([CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'required: name' END, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[1-3][1-5]$') THEN 'pattern: brand' END, CASE WHEN p_size NOT BETWEEN 1 AND 40 THEN 'range: size' END, CASE WHEN split_part(p_type, ' ', 1) NOT IN {_ALLOWED} THEN 'enum: type' END], lambda x: x IS NOT NULL)) AS message FROM part""")
def txt9_record_rules(spark, sf):
    """Required, pattern, range and enum rules in one pass; each break is a violation."""
    rules = {
        "required: name": F.col("p_name").isNull() | (F.trim("p_name") == ""),
        "pattern: brand": ~F.col("p_brand").rlike("^Brand#[1-3][1-5]$"),
        "range: size": ~F.col("p_size").between(1, 40),
        "enum: type": ~F.split_part("p_type", F.lit(" "), F.lit(1)).isin("STANDARD", "SMALL", "MEDIUM"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in rules.items()]))
    return V.read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.explode(broken).alias("message"))


_SRC = "SELECT o_orderkey AS id, unnest(['bib:' || o_orderkey % 50, 'part:' || o_orderkey % 2500, 'verse:' || o_orderkey % 900 || ':' || o_orderkey % 9, CASE o_orderkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'blog:' || o_orderkey ELSE 'bib:' END]) AS source FROM orders"


@query(f"""SELECT id, source, message FROM (SELECT id, source, CASE WHEN NOT regexp_matches(source, '^[a-z]+:[0-9]+(:[0-9]+)?$') THEN 'not a source' WHEN p NOT IN ('bib', 'part', 'verse') THEN 'unknown kind'
WHEN p = 'bib' AND TRY_CAST(v AS BIGINT) NOT IN (SELECT item_id FROM benchmark) THEN 'no such record' WHEN p = 'part' AND TRY_CAST(v AS BIGINT) NOT IN (SELECT p_partkey FROM part) THEN 'no such record' WHEN p = 'verse' AND v NOT IN (SELECT conv_id || ':' || turn FROM conversations) THEN 'no such verse' END AS message
FROM (SELECT id, source, split_part(source, ':', 1) AS p, substr(source, length(split_part(source, ':', 1)) + 2) AS v FROM ({_SRC}))) WHERE message IS NOT NULL""")
def txt10_source_rules(spark, sf):
    """Sources by grammar, kind, and whether the record or verse that they name exists."""
    k = F.col("o_orderkey")
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    s = lambda c: c.cast("string")
    odd = F.when(k % 4 == 0, "web").when(k % 4 == 1, text("blog:", s(k))).otherwise("bib:")
    rows = V.read(spark, sf, "orders").select(k.alias("id"), F.explode(F.array(text("bib:", s(k % 50)), text("part:", s(k % 2500)), text("verse:", s(k % 900), ":", s(k % 9)), odd)).alias("source"))
    known = V.read(spark, sf, "benchmark").select(text("bib:", s(F.col("item_id"))).alias("source")).unionByName(V.read(spark, sf, "part").select(text("part:", s(F.col("p_partkey"))).alias("source")))
    known = known.unionByName(V.read(spark, sf, "conversations").select(text("verse:", s(F.col("conv_id")), ":", s(F.col("turn"))).alias("source"))).distinct().withColumn("there", F.lit(True))
    kind = F.split_part("source", F.lit(":"), F.lit(1))
    message = F.when(~F.col("source").rlike("^[a-z]+:[0-9]+(:[0-9]+)?$"), "not a source").when(~kind.isin("bib", "part", "verse"), "unknown kind").when(F.col("there").isNull(), F.when(kind == "verse", "no such verse").otherwise("no such record"))
    return rows.join(known, "source", "left").select("id", "source", message.alias("message")).where("message is not null")


_STOP = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'location' WHEN 1 THEN 'route-stop' ELSE 'port' END AS kind, (CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey % 120 END)::BIGINT AS ref_id, (o_orderkey % 5 - 1)::BIGINT AS idx FROM orders"
_DIM = "SELECT 'location' AS kind, c_custkey AS id, 3 AS n FROM customer UNION ALL SELECT 'route-stop', s_suppkey, 2 FROM supplier"


@query(f"SELECT o_orderkey, CASE WHEN o.kind = 'port' THEN 'unknown kind port' WHEN d.id IS NULL THEN 'no ' || o.kind || ' ' || ref_id ELSE 'candidate ' || idx || ' of ' || n END AS message FROM ({_STOP}) o LEFT JOIN ({_DIM}) d ON d.kind = o.kind AND d.id = o.ref_id WHERE d.id IS NULL OR idx < 0 OR idx >= n")
def jon5_stop_errors(spark, sf):
    """The third policy for a stop's reference: each unknown kind, missing record and wrong candidate index is an error."""
    k = F.col("o_orderkey")
    stops = V.read(spark, sf, "orders").select("o_orderkey", F.when(k % 3 == 0, "location").when(k % 3 == 1, "route-stop").otherwise("port").alias("kind"), F.when(k % 3 == 0, F.col("o_custkey")).otherwise(k % 120).alias("id"), (k % 5 - 1).alias("idx"))
    dim = lambda kind, t, key, n: V.read(spark, sf, t).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.lit(n).alias("n"))
    j = stops.join(dim("location", "customer", "c_custkey", 3).unionByName(dim("route-stop", "supplier", "s_suppkey", 2)), ["kind", "id"], "left")
    message = F.when(F.col("kind") == "port", "unknown kind port").when(F.col("n").isNull(), F.concat_ws(" ", F.lit("no"), "kind", F.col("id").cast("string"))).when((F.col("idx") < 0) | (F.col("idx") >= F.col("n")), F.concat_ws(" ", F.lit("candidate"), F.col("idx").cast("string"), F.lit("of"), F.col("n").cast("string")))
    return j.select("o_orderkey", message.alias("message")).where("message is not null")


_CODED = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus AS v FROM lineitem"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 50 = 7 THEN NULL ELSE v END AS v, CASE WHEN l_orderkey % 50 = 7 THEN 'no entry ' || (ix + 100) END AS error FROM ({_CODED}) JOIN (SELECT v, (row_number() OVER (ORDER BY a, b, c) - 1)::BIGINT AS ix FROM (SELECT v, p.a AS a, p.b AS b, p.c AS c FROM (SELECT v, min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey)) AS p FROM ({_CODED}) GROUP BY 1))) USING (v)""")
def set6_expand_catalogue(spark, sf):
    """Rows of catalogue indexes back to values; an index without an entry is reported. (Some are made wrong here.)"""
    from chronogaz.plans.queries_joins import _catalogue

    _, cat = _catalogue(spark, sf)
    li = V.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("v"))
    coded = li.join(cat, "v").withColumn("ix", F.col("ix") + F.when(F.col("l_orderkey") % 50 == 7, 100).otherwise(0)).drop("v")
    error = F.when(F.col("v").isNull(), F.concat(F.lit("no entry "), F.col("ix").cast("string")))
    return coded.join(cat, "ix", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v", error.alias("error"))


# -- trees and graphs

_UP = ", a(id, ancestor, depth) AS (SELECT id, parent, 1 FROM {t} WHERE parent IS NOT NULL UNION ALL SELECT a.id, t.parent, a.depth + 1 FROM a JOIN {t} t ON t.id = a.ancestor WHERE t.parent IS NOT NULL)"


@query(_UP.format(t="v_tree") + " SELECT id, arg_min(ancestor, depth) AS nearest, min(depth)::BIGINT AS depth FROM a WHERE ancestor % 3 = 0 GROUP BY 1", ("v_tree",))
def grf8_nearest_of_a_type(spark, sf):
    """The nearest ancestor of a type (here: a number divisible by three)."""
    a = G.ancestors(V.v_tree(spark, sf)).where("ancestor % 3 = 0")
    return a.groupBy("id").agg(F.min_by("ancestor", "depth").alias("nearest"), F.min("depth").cast("long").alias("depth"))


@query(", cut AS (SELECT id, CASE WHEN id % 100 = 55 THEN NULL ELSE parent END AS parent FROM v_tree)" + _UP.format(t="cut") + " SELECT id, coalesce(arg_max(ancestor, depth), id) AS top FROM cut LEFT JOIN a USING (id) GROUP BY id HAVING coalesce(arg_max(ancestor, depth), id) <> 0", ("v_tree",))
def grf9_chains_off_the_root(spark, sf):
    """Nodes whose chain of parents does not end at the root, and where it ends."""
    t = V.v_tree(spark, sf).withColumn("parent", F.when(F.col("id") % 100 != 55, F.col("parent")))
    top = G.ancestors(t).groupBy("id").agg(F.max_by("ancestor", "depth").alias("top"))
    return t.select("id").join(top, "id", "left").select("id", F.coalesce("top", "id").alias("top")).where("top <> 0")


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey)::BIGINT AS pos FROM part")
def srt4_stable_order(spark, sf):
    """An output in id order with each row's place: ranges of ids, counted, then numbered inside; no single task sorts all."""
    return G.positions(V.read(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")


@query()
def grf3_traced_paths(spark, sf):
    """From node 7 to every fiftieth node: the nodes in order with the edge that leads to each. No twin; tests hold Dijkstra."""
    g = V.v_graph_ids(spark, sf)
    return G.traced_paths(g, spark.range(7, 8).select(F.col("id").alias("node")), V.v_graph(spark, sf).select(F.col("dst").alias("node")).where("node % 50 = 0").distinct())


@query()
def tmp1_history_with_sources(spark, sf):
    """Base periods with overrides laid one after the other, merged after each, sources united. No twin: each override
    meets what the one before left; tests hold it against a loop."""
    from chronogaz.operators import temporal as T

    over = V.v_override(spark, sf).withColumn("sources", F.array(F.concat(F.lit("x:"), F.col("id").cast("string"))))
    base = V.v_period(spark, sf).select("area_id", "from", "to", "holder", "sources")
    return T.history(base, over, "area_id").withColumn("sources", F.array_join("sources", ","))
