"""Places and stops: candidates, anchors, citations, indexes, stored against derived histories, holders, names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogaz.functions import text as X
from chronogaz.operators import graph as G
from chronogaz.operators import spatial as S
from chronogaz.plans import views as V
from chronogaz.plans.registry import query
from chronogaz.sources import records as R


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def src7_optional_layers(spark, sf):
    """A layer that is there and one that is not: the missing one is an empty frame of its schema."""
    schema = V.read(spark, sf, "region").schema
    there, absent = R.optional_layer(spark, f"{sf}/region.parquet", schema), R.optional_layer(spark, f"{sf}/no-such-layer.parquet", schema)
    return there.unionByName(absent).select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


@query("SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_candidates, coalesce(bool_or(l_quantity >= 49), false) AS disputed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def flt15_disputed_stops(spark, sf):
    """Stops with any candidate of disputed confidence; a stop without candidates is not disputed."""
    confidence = F.when(F.col("l_quantity") >= 49, "disputed").when(F.col("l_quantity") >= 25, "likely").otherwise("certain")
    c = V.read(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_partkey").alias("label"), confidence.alias("confidence")).alias("c")).groupBy("l_orderkey").agg(F.collect_list("c").alias("candidates"))
    o = V.read(spark, sf, "orders").select("o_orderkey").join(c, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    own = F.coalesce("candidates", F.array().cast(c.schema["candidates"].dataType))
    return o.select("o_orderkey", F.size(own).cast("long").alias("n_candidates"), F.exists(own, lambda x: x["confidence"] == "disputed").alias("disputed"))


_CANDS = "SELECT id, lon, lat, 1 + id % 3 AS n FROM v_site"


@query(f"SELECT o_orderkey, CASE WHEN b.n = 1 THEN b.lon WHEN a.n = 1 THEN a.lon ELSE coalesce(b.lon, a.lon) END AS lon, CASE WHEN b.n = 1 THEN b.lat WHEN a.n = 1 THEN a.lat ELSE coalesce(b.lat, a.lat) END AS lat FROM orders LEFT JOIN ({_CANDS}) a ON a.id = o_custkey % 120 LEFT JOIN ({_CANDS}) b ON b.id = o_orderkey % 130", ("v_site",))
def prj5_stage_anchor(spark, sf):
    """The end of a stage with one site, the destination first; else the destination, else the start."""
    s = V.v_site(spark, sf).withColumn("n", 1 + F.col("id") % 3)
    a, b = s.toDF("a", "alon", "alat", "an"), s.toDF("b", "blon", "blat", "bn")
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(a, F.col("a") == F.col("o_custkey") % 120, "left").join(b, F.col("b") == F.col("o_orderkey") % 130, "left")
    pick = lambda c: F.when(F.col("bn") == 1, F.col(f"b{c}")).when(F.col("an") == 1, F.col(f"a{c}")).otherwise(F.coalesce(f"b{c}", f"a{c}")).alias(c)
    return o.select("o_orderkey", pick("lon"), pick("lat"))


#: Kinds of sources: label and address; `{}` stands for the value. Our own choice of addresses.
KINDS = [
    ("bib", "Bibliography {}", "/bibliography#{}"), ("doi", "DOI {}", "https://doi.org/{}"), ("isbn", "ISBN {}", "https://books.example.org/{}"), ("osm", "OpenStreetMap {}", "https://osm.example.org/{}"),
    ("wikidata", "Wikidata {}", "https://wikidata.example.org/Q{}"), ("wikipedia", "Wikipedia: {}", "https://wiki.example.org/{}"), ("pleiades", "Pleiades {}", "https://pleiades.example.org/{}"), ("openbible", "OpenBible {}", "https://openbible.example.org/{}"),
    ("awmc", "AWMC {}", "https://awmc.example.org/{}"), ("ne", "Natural Earth {}", "https://ne.example.org/{}"), ("geonames", "GeoNames {}", "https://geonames.example.org/{}"), ("scripture", "Passage {}", "/passage/{}"), ("url", "Web page {}", "https://{}"),
]
_KIND = ", ".join(f"({i}, '{p}', '{a}', '{b}')" for i, (p, a, b) in enumerate(KINDS))


@query(f"SELECT id, cite, CASE WHEN prefix = 'bib' AND entry IS NOT NULL THEN entry WHEN prefix IS NULL THEN cite ELSE replace(label, '{{}}', val) END AS label, replace(url, '{{}}', val) AS url FROM (SELECT o_orderkey AS id, coalesce(prefix, 'odd') || ':' || o_orderkey % 60 AS cite, prefix, label, url, (o_orderkey % 60)::VARCHAR AS val, o_orderkey % 60 AS n FROM orders LEFT JOIN (VALUES {_KIND}) k(i, prefix, label, url) ON i = o_orderkey % 14) LEFT JOIN (SELECT item_id, 'Entry ' || item_id AS entry FROM benchmark) ON prefix = 'bib' AND item_id = n")
def str8_citations(spark, sf):
    """Label and address of a citation by its kind, of thirteen; a bibliography entry gives its own label, an unknown kind
    stays as it is."""
    kinds = spark.createDataFrame([(i, *k) for i, k in enumerate(KINDS)], "i int, prefix string, label string, url string")
    o = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 14).cast("int").alias("i"), (F.col("o_orderkey") % 60).alias("n"))
    names = o.join(F.broadcast(kinds.select("i", "prefix")), "i", "left").select("id", "n", F.concat_ws(":", F.coalesce("prefix", F.lit("odd")), F.col("n").cast("string")).alias("cite"))  # thirteen kinds
    entries = V.read(spark, sf, "benchmark").select(F.concat(F.lit("bib:"), F.col("item_id").cast("string")).alias("cite"), F.concat(F.lit("Entry "), F.col("item_id").cast("string")).alias("entry"))
    split = names.withColumns({"prefix": F.split_part("cite", F.lit(":"), F.lit(1)), "value": F.split_part("cite", F.lit(":"), F.lit(2))})
    j = split.join(F.broadcast(kinds.drop("i")), "prefix", "left").join(entries, "cite", "left")
    fill = lambda c: F.replace(F.col(c), F.lit("{}"), F.url_encode("value"))
    return j.select("id", "cite", F.when(F.col("label").isNull(), F.col("cite")).otherwise(F.coalesce("entry", fill("label"))).alias("label"), fill("url").alias("url"))


@query("SELECT p.id, road_id, seq::BIGINT AS seq FROM v_site p JOIN v_rseg ON floor(least(x1, x2) / 0.5e0) <= floor(lon / 0.5e0) + 1 AND floor(greatest(x1, x2) / 0.5e0) >= floor(lon / 0.5e0) - 1 AND floor(least(y1, y2) / 0.5e0) <= floor(lat / 0.5e0) + 1 AND floor(greatest(y1, y2) / 0.5e0) >= floor(lat / 0.5e0) - 1", ("v_site", "v_rseg"))
def jon18_segment_index(spark, sf):
    """The segments that the grid index gives for each point: those whose box touches its cell or one beside it."""
    seg = S.segments(V.v_road(spark, sf), "road_id")
    return S.in_cell_reach(V.v_site(spark, sf), seg, 0.5).select("id", "road_id", F.col("seq").cast("long").alias("seq"))


_DER = "SELECT area_id, row_number() OVER (PARTITION BY area_id ORDER BY f, id) AS pos, id, f, t, holder, ['o:' || id, 'b:' || id % 7] AS sources FROM v_period"
_STO = "SELECT area_id, row_number() OVER (PARTITION BY area_id ORDER BY f, id) AS pos, CASE WHEN id % 17 = 0 THEN f + 1 ELSE f END AS f, t, CASE WHEN id % 11 = 0 THEN '?' ELSE holder END AS holder, CASE WHEN id % 5 = 0 THEN ['b:' || id % 7, 'o:' || id] WHEN id % 19 = 0 THEN ['o:' || id] ELSE ['o:' || id, 'b:' || id % 7] END AS sources FROM v_period WHERE id % 23 <> 0"
_DIFF = f"SELECT coalesce(d.area_id, s.area_id) AS area_id, coalesce(d.pos, s.pos)::BIGINT AS pos, CASE WHEN s.pos IS NULL THEN 'missing' WHEN d.pos IS NULL THEN 'extra' ELSE array_to_string(list_filter([CASE WHEN d.f <> s.f OR d.t <> s.t THEN 'years' END, CASE WHEN d.holder <> s.holder THEN 'holder' END, CASE WHEN list_sort(d.sources) <> list_sort(s.sources) THEN 'sources' END], lambda x: x IS NOT NULL), ',') END AS difference FROM ({_DER}) d FULL OUTER JOIN ({_STO}) s ON s.area_id = d.area_id AND s.pos = d.pos"


def _histories(spark, sf):
    """(derived, stored): the stored copy has rows missing, years and holders changed, sources in another order or fewer."""
    p = V.v_period(spark, sf).withColumn("b", F.concat(F.lit("b:"), (F.col("id") % 7).cast("string")))
    o, b, k = F.element_at("sources", 1), F.col("b"), F.col("id")
    pos = F.row_number().over(Window.partitionBy("area_id").orderBy("from", "id"))
    derived = p.select("area_id", pos.alias("pos"), "id", "from", "to", "holder", F.array(o, b).alias("sources"))
    old = p.where(k % 23 != 0)
    stored = old.select("area_id", pos.alias("pos"), F.when(k % 17 == 0, F.col("from") + 1).otherwise(F.col("from")).alias("from"), "to", F.when(k % 11 == 0, "?").otherwise(F.col("holder")).alias("holder"), F.when(k % 5 == 0, F.array(b, o)).when(k % 19 == 0, F.array(o)).otherwise(F.array(o, b)).alias("sources"))
    return derived, stored


def _differences(spark, sf):
    derived, stored = _histories(spark, sf)
    body = lambda n: F.struct("from", "to", "holder", F.array_sort("sources").alias("sources")).alias(n)
    j = derived.select("area_id", "pos", body("d")).join(stored.select("area_id", "pos", body("s")), ["area_id", "pos"], "full_outer")
    parts = F.array_compact(F.array(F.when((F.col("d.from") != F.col("s.from")) | (F.col("d.to") != F.col("s.to")), "years"), F.when(~F.col("d.holder").eqNullSafe(F.col("s.holder")), "holder"), F.when(F.col("d.sources") != F.col("s.sources"), "sources")))
    kind = F.when(F.col("s").isNull(), "missing").when(F.col("d").isNull(), "extra").otherwise(F.array_join(parts, ","))
    return j.select("area_id", F.col("pos").cast("long").alias("pos"), kind.alias("difference")).where("difference <> ''")


@query(f"SELECT * FROM ({_DIFF}) WHERE difference <> ''", ("v_period",))
def jon23_stored_against_derived(spark, sf):
    """Stored against derived histories, place by place; the order of sources does not count."""
    return _differences(spark, sf)


@query(f'SELECT area_id, pos::BIGINT AS pos, f AS "from", t AS "to", holder, array_to_string(sources, \',\') AS sources FROM ({_DER}) WHERE area_id IN (SELECT area_id FROM ({_DIFF}) WHERE difference <> \'\')', ("v_period",))
def tmp3_changed_histories(spark, sf):
    """The histories to write back: those of areas that differ anywhere, whole."""
    derived, _ = _histories(spark, sf)
    changed = _differences(spark, sf).select("area_id").distinct()
    return derived.join(changed, "area_id", "left_semi").select("area_id", F.col("pos").cast("long").alias("pos"), "from", "to", "holder", F.array_join("sources", ",").alias("sources"))


_STOPS = ", stops AS (SELECT DISTINCT year(o_orderdate::DATE)::BIGINT AS y, date_diff('day', DATE '1970-01-01', make_date(year(o_orderdate::DATE)::BIGINT, 7, 1))::BIGINT AS d FROM orders)"


@query(_STOPS + " SELECT y, p.area_id, p.id, holder, e.name AS entity, coalesce(e.side, false) AS on_side, f > s AS known_start FROM stops JOIN v_period p ON f <= d AND d < t JOIN (SELECT area_id, min(f) AS s FROM v_period GROUP BY 1) b ON b.area_id = p.area_id LEFT JOIN (VALUES ('F', 'First realm', true), ('O', 'Other realm', false)) e(k, name, side) ON e.k = holder", ("v_period",))
def jon25_holder_at_stop(spark, sf):
    """Area, period and entity at each stop; a holder without an entity is kept with none."""
    from chronogaz.plans.queries_lines import _at_stops

    entities = spark.createDataFrame([("F", "First realm", True), ("O", "Other realm", False)], "holder string, entity string, side boolean")
    rows = _at_stops(spark, sf).join(entities, "holder", "left")
    return rows.select("y", "area_id", "id", "holder", "entity", F.coalesce("side", F.lit(False)).alias("on_side"), "known_start")


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, 0 AS kind FROM part UNION ALL SELECT p_partkey, p_type, 1 FROM part UNION ALL SELECT p_partkey, p_brand, 1 FROM part),
r AS (SELECT id, name, kind, CASE WHEN lower(name) = 'steel' THEN 0 WHEN starts_with(lower(name), 'st') OR contains(lower(name), ' st') THEN 1 END AS rank, CASE WHEN starts_with(lower(name), 'st') THEN 0 ELSE 1 END AS pref FROM n)
SELECT id, name, rank::BIGINT AS rank FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, pref, kind, name) = 1""")
def txt2_best_name(spark, sf):
    """Of each place's names the one that answers a search best: rank, prefix rank, title before alternates, name."""
    p = V.read(spark, sf, "part")
    names = p.select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.col(c).alias("name"), F.lit(k).alias("kind")) for c, k in (("p_name", 0), ("p_type", 1), ("p_brand", 1))])).alias("n")).select("id", "n.*")
    f = X.search_fold(F.col("name"))
    rank = F.when(f == "steel", 0).when(f.startswith("st") | F.contains(f, F.lit(" st")), 1)
    rows = names.withColumns({"rank": rank, "pref": F.when(f.startswith("st"), 0).otherwise(1)}).where("rank is not null")
    best = rows.groupBy("id").agg(F.min(F.struct("rank", "pref", "kind", "name")).alias("m"))
    return best.select("id", F.col("m.name").alias("name"), F.col("m.rank").cast("long").alias("rank"))


_Q3 = ("ste", "pol", "ed ", "small p")


@query("SELECT p_partkey, q, strpos(f, q)::BIGINT AS starts, substr(name, strpos(f, q)::BIGINT, length(q)) AS marked FROM (SELECT p_partkey, p_type || ' Évora' AS name, lower(strip_accents(p_type || ' Évora')) AS f FROM part), (" + " UNION ALL ".join(f"SELECT '{q}' AS q" for q in (*_Q3, "evo")) + ") WHERE contains(f, q)")
def txt3_highlight(spark, sf):
    """Where each search stands in a name, and the original letters there; the fold keeps every letter's place."""
    name = F.concat("p_type", F.lit(" Évora"))
    p = V.read(spark, sf, "part").select("p_partkey", name.alias("name"), X.search_fold(name).alias("f"), F.explode(F.array(*[F.lit(q) for q in (*_Q3, "evo")])).alias("q"))
    hit = p.withColumn("starts", F.expr("locate(q, f)").cast("long")).where("starts > 0")
    return hit.select("p_partkey", "q", "starts", F.substr("name", F.col("starts").cast("int"), F.length("q")).alias("marked"))


_CELL = ", cell AS (SELECT x::BIGINT AS cx, y::BIGINT AS cy, x + 0.5e0 AS lon, y + 0.5e0 AS lat FROM range(-10, 60) a(x), range(15, 60) b(y))"


@query(_CELL + ", a AS (SELECT cx, cy, e.area_id FROM cell JOIN v_edge e ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) SELECT min(cx * 1000 + cy)::BIGINT AS piece, count(*)::BIGINT AS n_cells, floor(sum(radians(1e0) * (sin(radians(cy + 1)) - sin(radians(cy)))) * 6371.0088e0 * 6371.0088e0 + 0.5e0)::BIGINT AS km2, bool_or(EXISTS (SELECT 1 FROM v_site WHERE id % 9 = 4 AND floor(lon) = cx AND floor(lat) = cy)) AS explained FROM a WHERE area_id % 7 = 0 GROUP BY area_id", ("v_edge", "v_site"))
def spa9_uncovered_pieces(spark, sf):
    """Connected pieces of the domain that no listed area covers, with their size and whether a listed point explains them.
    Areas end on whole degrees, so cells of a degree are exact here; finer ones come from the refined cover."""
    e = V.v_edge(spark, sf).select("area_id", "x1", "y1", "x2", "y2")
    gaps = S.cover(e, 1.0).select("cx", "cy").distinct().join(S.cover(e.where("area_id % 7 <> 0"), 1.0).select("cx", "cy").distinct(), ["cx", "cy"], "left_anti")
    gaps = G.checkpointed(gaps.withColumn("node", F.col("cx") * 1000 + F.col("cy")))
    steps = gaps.select(F.col("node").alias("src"), F.explode(F.array(F.col("node"), F.col("node") + 1, F.col("node") + 1000)).alias("dst"))
    linked = G.connected_components(steps.join(gaps.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    listed = V.v_site(spark, sf).where("id % 9 = 4").select(F.floor("lon").alias("cx"), F.floor("lat").alias("cy"), F.lit(True).alias("listed")).distinct()
    km2 = F.radians(F.lit(1.0)) * (F.sin(F.radians(F.col("cy") + 1)) - F.sin(F.radians("cy"))) * 6371.0088**2
    rows = gaps.join(linked, "node").join(listed, ["cx", "cy"], "left")
    g = rows.groupBy(F.col("component").alias("piece")).agg(F.count("*").alias("n_cells"), F.floor(F.sum(km2) + 0.5).cast("long").alias("km2"), F.bool_or(F.coalesce("listed", F.lit(False))).alias("explained"))
    return g
