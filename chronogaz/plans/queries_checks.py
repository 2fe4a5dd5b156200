"""Checks and choices in the form that the records need: outputs and budgets, references, limits, orders, parts, masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogaz.functions import geo
from chronogaz.functions import text as X
from chronogaz.operators import audit as A
from chronogaz.operators import network as N
from chronogaz.operators import spatial as S
from chronogaz.operators import textjobs as J
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

# -- outputs

_BUDGET = 60_000


@query(f"SELECT 'source=' || coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS output, bytes, true AS smaller, bytes > {_BUDGET} AS over FROM (SELECT source, sum(strlen(replace(coalesce(text, ''), chr(10), ' ')) + 1)::BIGINT AS bytes FROM documents GROUP BY 1)")
def snk5_size_budget(spark, sf):
    """Outputs of a layer, one for each source, written as gzip and listed: bytes, whether gzip is smaller, budget."""
    from chronogaz.plans.queries_files import _folder

    out = _folder(spark)
    d = V.read(spark, sf, "documents").select("source", F.translate(F.coalesce("text", F.lit("")), "\n", " ").alias("value"))
    d.write.partitionBy("source").option("compression", "gzip").text(out)
    name = F.regexp_extract("path", r"/(source=[^/]*)/", 1)
    gz = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).groupBy(name.alias("output")).agg(F.sum("length").alias("gz"))
    plain = d.groupBy(F.concat(F.lit("source="), F.coalesce("source", F.lit("__HIVE_DEFAULT_PARTITION__"))).alias("output")).agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    return plain.join(gz, "output", "left").select("output", "bytes", (F.col("gz") < F.col("bytes")).alias("smaller"), (F.col("bytes") > _BUDGET).alias("over"))


@query("SELECT count(*)::BIGINT AS n_files, max(n)::BIGINT AS largest, arg_max(doc_id, n * 1000000000 - doc_id) AS largest_id, count(*) <= 20000 AS few, max(n) <= 26214400 AS small, count(*) FILTER (n > 26214400)::BIGINT AS n_over FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)")
def snk6_tree_limits(spark, sf):
    """At most 20,000 files, none of over 25 MiB."""
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    limit = 25 << 20
    return V.read(spark, sf, "documents").agg(F.count("*").alias("n_files"), F.max(n).alias("largest"), F.max_by("doc_id", n * 1000000000 - F.col("doc_id")).alias("largest_id"), (F.count("*") <= 20000).alias("few"), (F.max(n) <= limit).alias("small"), F.count_if(n > limit).alias("n_over"))


_HASH = "SELECT doc_id, sha256(coalesce(text, '')) AS actual FROM documents"


@query(f"SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'not declared' ELSE 'declared ' || substr(declared, 1, 8) || ', is ' || substr(actual, 1, 8) END AS message FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN sha256('old ' || doc_id) ELSE actual END AS declared FROM ({_HASH})) WHERE doc_id % 9 = 0 OR declared <> actual UNION ALL SELECT -doc_id - 1, 'no such file' FROM documents WHERE doc_id % 50 = 3")
def snk7_checksums(spark, sf):
    """Snapshots against the hashes that a manifest declares: undeclared, different, and declared but not there."""
    d = V.read(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("actual"))
    stale = F.sha2(F.concat(F.lit("old "), F.col("doc_id").cast("string")), 256)
    manifest = d.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, stale).otherwise(F.col("actual")).alias("declared"))
    manifest = manifest.unionByName(d.where("doc_id % 50 = 3").select((-F.col("doc_id") - 1).alias("id"), F.lit("x").alias("declared")))
    j = d.join(manifest, F.col("doc_id") == F.col("id"), "full_outer")
    message = F.when(F.col("doc_id").isNull(), "no such file").when(F.col("id").isNull(), "not declared").when(F.col("declared") != F.col("actual"), F.concat(F.lit("declared "), F.substring("declared", 1, 8), F.lit(", is "), F.substring("actual", 1, 8)))
    return j.select(F.coalesce("doc_id", "id").alias("doc_id"), message.alias("message")).where("message is not null")


_PATH = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '../media/' WHEN 1 THEN 'other/' ELSE 'media/' END || doc_id || '.webp' AS path, strlen(coalesce(text, '')) * 16 AS size FROM documents"


@query(f"SELECT doc_id, CASE WHEN path LIKE '../%' OR path NOT LIKE 'media/%' THEN 'outside the media root' WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'no such file' ELSE 'over 400 KiB' END AS message FROM ({_PATH}) WHERE path NOT LIKE 'media/%' OR doc_id NOT IN (SELECT doc_id FROM labels) OR size > 409600")
def flt14_hosted_files(spark, sf):
    """Hosted files: under the media root, in the listing, 400 KiB at most."""
    k = F.col("doc_id")
    d = V.read(spark, sf, "documents").select("doc_id", F.concat(F.when(k % 6 == 0, "../media/").when(k % 6 == 1, "other/").otherwise("media/"), k.cast("string"), F.lit(".webp")).alias("path"), (F.octet_length(F.coalesce("text", F.lit(""))) * 16).alias("size"))
    there = V.read(spark, sf, "labels").select("doc_id", F.lit(True).alias("there")).distinct()
    message = F.when(~F.col("path").startswith("media/"), "outside the media root").when(F.col("there").isNull(), "no such file").when(F.col("size") > 400 << 10, "over 400 KiB")
    return d.join(there, "doc_id", "left").select("doc_id", message.alias("message")).where("message is not null")


# -- references

@query("SELECT o_custkey, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL) AS resolved, string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (s_suppkey IS NULL) AS unresolved FROM (SELECT DISTINCT o_custkey, o_orderkey % 150 AS k FROM orders) LEFT JOIN supplier ON s_suppkey = k AND s_suppkey % 3 <> 0 GROUP BY 1")
def jon4_resolve_or_report(spark, sf):
    """What resolves and, in a list of its own, what does not."""
    s = V.read(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("site"))
    o = V.read(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 150).alias("k")).distinct().join(s, F.col("site") == F.col("k"), "left").groupBy("o_custkey")
    both = o.agg(*[F.array_sort(F.collect_list(F.when(c, F.col("k")))).alias(n) for n, c in (("resolved", F.col("site").isNotNull()), ("unresolved", F.col("site").isNull()))])
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return both.select("o_custkey", text("resolved"), text("unresolved"))


_FOLD = "lower(replace(replace({}, 'File:', ''), ' ', '_'))"


@query(f"""WITH d AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'File:' || upper(p_name) ELSE replace(p_name, ' ', '_') END AS file, p_size % 7 AS old FROM part), k AS (SELECT {_FOLD.format('p_name')} AS f, max(p_size) AS size FROM part WHERE p_partkey % 4 <> 1 AND p_size < 40 GROUP BY 1)
SELECT id, size, size IS NULL AS missed FROM d LEFT JOIN k ON f = {_FOLD.format('file')} WHERE size IS NULL OR size <> old""")
def jon28_fill_from_lookup(spark, sf):
    """Sizes filled by folded file name: distinct names are looked up, misses reported, unchanged rows left out."""
    fold = lambda c: F.lower(F.translate(F.regexp_replace(c, "File:", ""), " ", "_"))
    p = V.read(spark, sf, "part")
    d = p.select(F.col("p_partkey").alias("id"), fold(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("File:"), F.upper("p_name"))).otherwise(F.translate("p_name", " ", "_"))).alias("f"), (F.col("p_size") % 7).alias("old"))
    k = p.where("p_partkey % 4 <> 1 and p_size < 40").groupBy(fold("p_name").alias("f")).agg(F.max("p_size").alias("size"))
    got = d.select("f").distinct().join(k, "f", "left")
    return d.join(got, "f").where(~F.col("size").eqNullSafe(F.col("old"))).select("id", "size", F.col("size").isNull().alias("missed"))


_LIM = "CASE WHEN o_custkey % 10 = 0 THEN 'major' ELSE 'standard' END"


@query(f"SELECT o_custkey, class, n, CASE WHEN class = 'standard' AND n > 3 THEN 'error' WHEN class = 'major' AND n > 7 THEN 'error' ELSE 'warning' END AS severity FROM (SELECT o_custkey, {_LIM} AS class, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2) WHERE (class = 'standard' AND n > 3) OR (class = 'major' AND (n > 7 OR n < 4))")
def agg4_count_limits(spark, sf):
    """Up to three for a standard record, four to seven for a major one; too few is a warning."""
    c = V.read(spark, sf, "orders").where("o_orderkey % 3 = 0").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("class", F.when(F.col("o_custkey") % 10 == 0, "major").otherwise("standard"))
    top, low = F.when(F.col("class") == "major", 7).otherwise(3), F.when(F.col("class") == "major", 4).otherwise(0)
    severity = F.when(F.col("n") > top, "error").when(F.col("n") < low, "warning")
    return c.select("o_custkey", "class", "n", severity.alias("severity")).where("severity is not null")


_BOOKS = "(SELECT * FROM (VALUES ('system', 0), ('user', 1), ('assistant', 2)) b(role, ix))"


@query(f"SELECT role AS book, any_value(ix) AS ix, count(*)::BIGINT AS n, string_agg(conv_id || ':' || turn, ' ' ORDER BY conv_id, turn) AS passages FROM conversations JOIN {_BOOKS} USING (role) WHERE turn % 3 = 0 GROUP BY 1")
def agg7_group_passages(spark, sf):
    """Passages by book, in the canon's order of books, chapters and verses; a book's passages are one bounded list."""
    c = V.read(spark, sf, "conversations").where("turn % 3 = 0").join(_books(spark), "role")
    g = c.groupBy(F.col("role").alias("book"), "ix").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("conv_id", "turn"))).alias("p"))
    return g.select("book", "ix", "n", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["conv_id"].cast("string"), x["turn"].cast("string"))), " ").alias("passages"))


def _books(spark):
    return spark.createDataFrame([("system", 0), ("user", 1), ("assistant", 2)], "role string, ix int")


@query(f"SELECT row_number() OVER (ORDER BY ix, conv_id, turn)::BIGINT AS pos, role, conv_id, turn FROM conversations JOIN {_BOOKS} USING (role) QUALIFY pos <= 200")
def srt2_canonical_order(spark, sf):
    """The first 200 passages in the canon's order: book index, chapter, verse."""
    top = V.read(spark, sf, "conversations").join(_books(spark), "role").select("ix", "role", "conv_id", "turn").orderBy("ix", "conv_id", "turn").limit(200)
    return top.select(F.row_number().over(Window.orderBy("ix", "conv_id", "turn")).cast("long").alias("pos"), "role", "conv_id", "turn")  # 200 rows


_KM = V.hav("x1", "y1", "x2", "y2")


@query(f"SELECT floor(sum(km) + 0.5e0)::BIGINT AS all_km, floor(sum(km) FILTER (kept) + 0.5e0)::BIGINT AS kept_km, floor(sum(km) FILTER (kept AND known) + 0.5e0)::BIGINT AS known_km, floor(sum(km) FILTER (NOT kept) + 0.5e0)::BIGINT AS excluded_km, count(DISTINCT road_id) FILTER (NOT kept)::BIGINT AS n_excluded FROM (SELECT road_id, {_KM} AS km, road_id % 11 <> 0 AS kept, road_id % 4 = 0 AS known FROM v_rseg)", ("v_rseg",))
def agg13_road_totals(spark, sf):
    """Kilometres of roads kept, of those known, and of those excluded."""
    s = S.segments(V.v_road(spark, sf), "road_id").withColumn("km", geo.haversine_km(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    kept, known = F.col("road_id") % 11 != 0, F.col("road_id") % 4 == 0
    per = s.groupBy("road_id").agg(F.sum("km").alias("km"))
    total = lambda c, n: F.floor(F.sum(F.when(c, F.col("km"))) + 0.5).cast("long").alias(n)
    return per.agg(total(F.lit(True), "all_km"), total(kept, "kept_km"), total(kept & known, "known_km"), total(~kept, "excluded_km"), F.count_if(~kept).alias("n_excluded"))


@query("""WITH r AS (SELECT user_id AS test, count(*) AS runs, count(*) FILTER (event_type = 'error' OR event_id % 5 = 0) AS bad, floor(sum(value) * 100 + 0.5e0)::BIGINT AS took FROM events GROUP BY 1)
SELECT 'failed' AS list, test, bad::BIGINT AS n, 0::BIGINT AS pos FROM r WHERE bad = runs UNION ALL SELECT 'flaky', test, bad::BIGINT, 0::BIGINT FROM r WHERE bad > 0 AND bad < runs UNION ALL SELECT 'slowest', test, took, pos FROM (SELECT *, row_number() OVER (ORDER BY took DESC, test)::BIGINT AS pos FROM r) WHERE pos <= 10""")
def agg16_flaky_failed_slowest(spark, sf):
    """Tests that failed in all their runs, that failed in some, and the ten slowest by summed duration."""
    e = V.read(spark, sf, "events")
    bad = F.coalesce(F.col("event_type") == "error", F.lit(False)) | (F.col("event_id") % 5 == 0)
    r = e.groupBy(F.col("user_id").alias("test")).agg(F.count("*").alias("runs"), F.count_if(bad).alias("bad"), geo.scaled(F.sum("value"), 100.0).alias("took"))
    named = lambda df, name, n: df.select(F.lit(name).alias("list"), "test", F.col(n).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"))
    slow = r.orderBy(F.desc("took"), "test").limit(10).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("took"), "test")).cast("long"))  # ten rows
    return named(r.where("bad = runs"), "failed", "bad").unionByName(named(r.where("bad > 0 and bad < runs"), "flaky", "bad")).unionByName(slow.select(F.lit("slowest").alias("list"), "test", F.col("took").alias("n"), "pos"))


_KM2 = "abs(sum(radians(x2 - x1) * (sin(radians(y1)) + sin(radians(y2))))) * 6371.0088e0 * 6371.0088e0 / 2"


@query(f"SELECT area_id, n_parts, km2 BETWEEN 400000 AND 800000 AS in_range, abs(km2 / target - 1) <= 0.01e0 AS on_target, n_parts <= 1 + area_id % 2 AS few_parts FROM (SELECT area_id, {_KM2} AS km2 FROM v_edge GROUP BY 1) JOIN (SELECT n_nationkey AS area_id, 1 + n_nationkey % 3 AS n_parts, (700000 - 20000 * (n_nationkey // 5)) * (1 + (n_nationkey % 4) * 0.004e0) AS target FROM nation) USING (area_id)", ("v_edge",))
def agg21_area_sanity(spark, sf):
    """Each area's size within its range, within one per cent of its target, in as many parts as allowed."""
    k = F.col("n_nationkey")
    want = V.read(spark, sf, "nation").select(k.alias("area_id"), (1 + k % 3).alias("n_parts"), ((700000 - 20000 * F.floor(k / 5)) * (1 + (k % 4) * F.lit(0.004))).alias("target"))
    j = S.sphere_km2(V.v_edge(spark, sf), "area_id").join(want, "area_id")
    return j.select("area_id", "n_parts", F.col("km2").between(400000, 800000).alias("in_range"), (F.abs(F.col("km2") / F.col("target") - 1) <= 0.01).alias("on_target"), (F.col("n_parts") <= 1 + F.col("area_id") % 2).alias("few_parts"))


@query(f"SELECT area_id, floor(km2 + 0.5e0)::BIGINT AS observed, expected::BIGINT AS expected, abs(km2 / expected - 1) > 0.3e0 AS flagged FROM (SELECT area_id, {_KM2} AS km2 FROM v_edge GROUP BY 1) JOIN (SELECT n_nationkey AS area_id, 400000 + n_nationkey % 7 * 100000 AS expected FROM nation) USING (area_id)", ("v_edge",))
def agg22_observed_expected(spark, sf):
    """Each face's area against what is expected, flagged beyond 30 per cent."""
    want = V.read(spark, sf, "nation").select(F.col("n_nationkey").alias("area_id"), (400000 + F.col("n_nationkey") % 7 * 100000).cast("long").alias("expected"))
    j = S.sphere_km2(V.v_edge(spark, sf), "area_id").join(want, "area_id")
    return j.select("area_id", F.floor(F.col("km2") + 0.5).cast("long").alias("observed"), "expected", (F.abs(F.col("km2") / F.col("expected") - 1) > 0.3).alias("flagged"))


# -- lines

@query(f"""SELECT line_id, min(seq)::BIGINT AS first_seq, max(seq)::BIGINT AS last_seq, count(*)::BIGINT AS n_points, floor(sum(CASE WHEN fresh = 0 THEN km ELSE 0 END) * 1000 + 0.5e0)::BIGINT AS m FROM (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY seq) AS run FROM (
SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 THEN 0 ELSE 1 END AS fresh, coalesce({V.hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0) AS km FROM (SELECT line_id, seq, lon / 1000 AS lon, lat / 1000 AS lat FROM v_line WHERE (line_id + seq) % 4 <> 0) WINDOW w AS (PARTITION BY line_id ORDER BY seq)))
GROUP BY line_id, run HAVING count(*) >= 2 AND sum(CASE WHEN fresh = 0 THEN km ELSE 0 END) >= 3""", ("v_line",))
def win9_split_at_excluded(spark, sf):
    """Pieces between excluded points, of two points and three kilometres at least; lines at a thousandth of their size."""
    w = Window.partitionBy("line_id").orderBy("seq")
    p = V.v_line(spark, sf).where("(line_id + seq) % 4 <> 0").select("line_id", "seq", (F.col("lon") / 1000).alias("lon"), (F.col("lat") / 1000).alias("lat"))
    km = geo.haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    p = p.withColumns({"fresh": F.when(F.lag("seq").over(w) == F.col("seq") - 1, 0).otherwise(1), "km": km}).withColumn("run", F.sum("fresh").over(w))
    own = F.sum(F.when(F.col("fresh") == 0, F.col("km")).otherwise(0.0))
    g = p.groupBy("line_id", "run").agg(F.min("seq").cast("long").alias("first_seq"), F.max("seq").cast("long").alias("last_seq"), F.count("*").alias("n_points"), own.alias("km"))
    return g.where("n_points >= 2 and km >= 3").select("line_id", "first_seq", "last_seq", "n_points", geo.scaled(F.col("km")).alias("m"))


_VIA = "SELECT line_id, CASE WHEN line_id % 5 = 0 THEN 5 - seq ELSE seq END AS place, lon + CASE WHEN line_id % 7 = 0 AND seq = 3 THEN 0.001e0 ELSE 0e0 END AS vx, lat AS vy FROM v_line WHERE seq IN (2, 3)"


@query(f"""WITH RECURSIVE {', '.join(f'{n} AS ({V.ORACLE_VIEWS[n]})' for n in ('v_line',))}, via AS ({_VIA}), a AS (SELECT v.line_id, min(seq) AS pos FROM via v LEFT JOIN v_line p ON p.line_id = v.line_id AND {V.hav('p.lon', 'p.lat', 'vx', 'vy')} * 1000 <= 1 WHERE place = 2 GROUP BY 1),
b AS (SELECT v.line_id, min(seq) AS pos FROM via v LEFT JOIN a ON a.line_id = v.line_id LEFT JOIN v_line p ON p.line_id = v.line_id AND p.seq >= coalesce(a.pos, 1) AND {V.hav('p.lon', 'p.lat', 'vx', 'vy')} * 1000 <= 1 WHERE place = 3 GROUP BY 1)
SELECT line_id, a.pos::BIGINT AS first_at, b.pos::BIGINT AS second_at, a.pos IS NOT NULL AND b.pos IS NOT NULL AS passed FROM a JOIN b USING (line_id)""")
def win13_passed_in_order(spark, sf):
    """Lines through a list of two places in order: a vertex within a metre of each, the second not before the first."""
    p = V.v_line(spark, sf)
    back = F.col("line_id") % 5 == 0
    via = p.where("seq in (2, 3)").select("line_id", F.when(back, 5 - F.col("seq")).otherwise(F.col("seq")).alias("place"), (F.col("lon") + F.when((F.col("line_id") % 7 == 0) & (F.col("seq") == 3), 0.001).otherwise(0.0)).alias("vx"), F.col("lat").alias("vy"))
    return N.passed_in_order(p, via, "line_id", 2, 3)


@query("""WITH b AS (SELECT p_partkey, p_brand, p_size, lower(p_type) AS t FROM part), g AS (SELECT p_brand, t, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) AS n FROM b GROUP BY 1, 2) SELECT p_partkey, p_brand, 'union-' || n AS shape FROM b JOIN g USING (p_brand, t)""")
def set7_geometry_registry(spark, sf):
    """Equal shapes of a layer have one id, numbered by first use."""
    b = V.read(spark, sf, "part").select("p_partkey", "p_brand", F.lower("p_type").alias("t"))
    first = b.groupBy("p_brand", "t").agg(F.min("p_partkey").alias("first"))
    named = first.select("p_brand", "t", F.concat(F.lit("union-"), F.row_number().over(Window.partitionBy("p_brand").orderBy("first")).cast("string")).alias("shape"))
    return b.join(named, ["p_brand", "t"]).select("p_partkey", "p_brand", "shape")


@query("""WITH p AS (SELECT n_nationkey AS area_id, part, (part * 37 + n_nationkey * 11) % 60 / 10e0 + 0.1e0 AS side FROM nation, range(0, 4) r(part)), k AS (SELECT *, side * side AS size, row_number() OVER (PARTITION BY area_id ORDER BY side DESC, part) AS n FROM p)
SELECT area_id, part, n = 1 AS largest, size >= 1 AS large_enough, CASE WHEN n = 1 THEN 'kept' WHEN size < 1 THEN 'dropped: small' ELSE 'dropped: not the largest' END AS outcome FROM k""")
def srt6_largest_part(spark, sf):
    """Each area's largest part by its area; the parts that go are reported with the reason."""
    part = F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>"))
    side = (F.col("part") * 37 + F.col("area_id") * 11) % 60 / F.lit(10.0) + 0.1
    p = V.read(spark, sf, "nation").select(F.col("n_nationkey").alias("area_id"), part.alias("part")).withColumn("side", side)
    corners = ((0, 0), (1, 0), (1, 1), (0, 1))
    edges = p.withColumn("c", F.explode(F.array(*[F.struct(F.lit(a[0]).alias("ax"), F.lit(a[1]).alias("ay"), F.lit(b[0]).alias("bx"), F.lit(b[1]).alias("by")) for a, b in zip(corners, corners[1:] + corners[:1])])))
    flat = edges.select(F.struct("area_id", "part").alias("id"), *[(F.col(f"c.{s}") * F.col("side")).alias(n) for s, n in (("ax", "x1"), ("ay", "y1"), ("bx", "x2"), ("by", "y2"))])
    size = S.shoelace(flat, "id").select("id.area_id", "id.part", "area")
    w = Window.partitionBy("area_id").orderBy(F.desc("area"), "part")
    k = size.withColumn("n", F.row_number().over(w))
    outcome = F.when(F.col("n") == 1, "kept").when(F.col("area") < 1, "dropped: small").otherwise("dropped: not the largest")
    return k.select("area_id", "part", (F.col("n") == 1).alias("largest"), (F.col("area") >= 1).alias("large_enough"), outcome.alias("outcome"))


# -- text

_REF = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Mark' WHEN 1 THEN '1 John' WHEN 2 THEN 'Song of Songs' WHEN 3 THEN 'Nobody' ELSE 'mark' END || ' ' || p_size || ':' || (p_partkey % 30 + 1) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || (p_partkey % 40) END AS ref FROM part"


@query(f"SELECT p_partkey, code, chapter, v1 AS first_verse, coalesce(v2, v1) AS last_verse, CASE WHEN book = '' THEN 'not a reference' WHEN code IS NULL THEN 'unknown book' WHEN coalesce(v2, v1) < v1 THEN 'ends before it starts' ELSE 'ok' END AS verdict FROM (SELECT p_partkey, regexp_extract(ref, '^((?:[1-3] )?[A-Z][A-Za-z ]*) ([0-9]+):([0-9]+)(?:-([0-9]+))?$', 1) AS book, TRY_CAST(regexp_extract(ref, '^((?:[1-3] )?[A-Z][A-Za-z ]*) ([0-9]+):([0-9]+)(?:-([0-9]+))?$', 2) AS BIGINT) AS chapter, TRY_CAST(regexp_extract(ref, '^((?:[1-3] )?[A-Z][A-Za-z ]*) ([0-9]+):([0-9]+)(?:-([0-9]+))?$', 3) AS BIGINT) AS v1, TRY_CAST(regexp_extract(ref, '^((?:[1-3] )?[A-Z][A-Za-z ]*) ([0-9]+):([0-9]+)(?:-([0-9]+))?$', 4) AS BIGINT) AS v2 FROM ({_REF})) LEFT JOIN (VALUES ('Mark', 'MRK'), ('1 John', '1JN'), ('Song of Songs', 'SNG')) b(name, code) ON name = book")
def str5_reference_grammar(spark, sf):
    """`Book C:V[-V]` against a list of books: numbered and many-word names, a range that does not end before it starts."""
    k = F.col("p_partkey")
    book = F.when(k % 5 == 0, "Mark").when(k % 5 == 1, "1 John").when(k % 5 == 2, "Song of Songs").when(k % 5 == 3, "Nobody").otherwise("mark")
    ref = F.concat(book, F.lit(" "), F.col("p_size").cast("string"), F.lit(":"), (k % 30 + 1).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("-"), (k % 40).cast("string"))))
    books = spark.createDataFrame([("Mark", "MRK"), ("1 John", "1JN"), ("Song of Songs", "SNG")], "book string, code string")
    return J.references(V.read(spark, sf, "part").select("p_partkey", ref.alias("ref")), "ref", books)


@query("""SELECT id, CASE WHEN len(l) = 0 THEN NULL WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS label FROM (SELECT id, list_sort(list_filter(list_distinct(c), lambda x: NOT regexp_matches(name, '(^|[^A-Za-z])' || x || '([^A-Za-z]|$)'))) AS l FROM (
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'Old town, ' || a.n_name WHEN s_suppkey % 4 = 1 THEN a.n_name || 'shire' ELSE s_name END AS name, list_sort(list_distinct([a.n_name, b.n_name, c.n_name, a.n_name])) AS c FROM supplier JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = s_suppkey % 25 JOIN nation c ON c.n_nationkey = s_suppkey % 3))""")
def str7_location_label(spark, sf):
    """Distinct countries, without those that the name holds as whole words: "A, B and C". (list order: by name.)"""
    n = V.read(spark, sf, "nation")
    s = V.read(spark, sf, "supplier")
    named = lambda c, key: n.select(F.col("n_nationkey").alias(f"k{c}"), F.col("n_name").alias(c))
    j = s.join(named("a", 0), F.col("ka") == F.col("s_nationkey")).join(named("b", 0), F.col("kb") == F.col("s_suppkey") % 25).join(named("c", 0), F.col("kc") == F.col("s_suppkey") % 3)
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Old town, "), "a")).when(k == 1, F.concat("a", F.lit("shire"))).otherwise(F.col("s_name"))
    return j.select(F.col("s_suppkey").alias("id"), X.country_label(name, F.sort_array(F.array("a", "b", "c", "a"))).alias("label"))


@query("SELECT p_partkey, CASE WHEN substr(md5(file), 1, 1) <> h1 OR substr(md5(file), 1, 2) <> h2 THEN 'hash folders' WHEN file <> page THEN 'page names another file' ELSE 'ok' END AS verdict FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '_é.jpg' AS file, substr(md5(replace(p_name, ' ', '_') || '_é.jpg'), 1, 1) AS h1, CASE WHEN p_partkey % 6 = 0 THEN 'zz' ELSE substr(md5(replace(p_name, ' ', '_') || '_é.jpg'), 1, 2) END AS h2, CASE WHEN p_partkey % 5 = 0 THEN 'Other.jpg' ELSE replace(p_name, ' ', '_') || '_é.jpg' END AS page FROM part)")
def str10_media_url(spark, sf):
    """A media URL's file name, decoded: the hash folders that it must lie in, and the page that must name it."""
    f = F.concat(F.translate("p_name", " ", "_"), F.lit("_é.jpg"))
    h = F.md5(f.cast("binary"))
    two = F.when(F.col("p_partkey") % 6 == 0, "zz").otherwise(F.substring(h, 1, 2))
    url = F.concat_ws("/", F.lit("https://media.example.org"), F.substring(h, 1, 1), two, F.url_encode(f))
    page = F.concat(F.lit("https://pages.example.org/File:"), F.url_encode(F.when(F.col("p_partkey") % 5 == 0, F.lit("Other.jpg")).otherwise(f)))
    return V.read(spark, sf, "part").select("p_partkey", X.media_verdict(url, page).alias("verdict"))


# -- masks and outlines

_GEO3 = "SELECT id, radians(lon) * 6378137e0 AS x, ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137e0 AS y FROM v_site"


@query(f"SELECT id, floor(x)::BIGINT AS x, floor(y)::BIGINT AS y, floor(degrees(x / 6378137e0) * 1e6 + 0.5e0)::BIGINT AS lon, floor(degrees(2 * atan(exp(y / 6378137e0)) - pi() / 2) * 1e6 + 0.5e0)::BIGINT AS lat, floor(1e6 * ({6371.0088 * 1000 / 6378137!r}e0 / cosh(y / 6378137e0)))::BIGINT AS scale_ppm FROM ({_GEO3})", ("v_site",))
def geo3_mercator(spark, sf):
    """Forward, back again, and the ground scale on the mean sphere."""
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    p = V.v_site(spark, sf).select("id", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
    return p.select("id", F.floor("x").alias("x"), F.floor("y").alias("y"), geo.scaled(lon, 1e6).alias("lon"), geo.scaled(lat, 1e6).alias("lat"), F.floor(geo.ground_scale(F.col("y")) * 1e6).alias("scale_ppm"))


def _mask_twin() -> str:
    from chronogaz.plans import queries_audit as Q

    return Q._PIECES + f" SELECT line_id, floor(sum(km) * 10 + 0.5e0)::BIGINT AS before_hm, floor(coalesce(sum(km) FILTER (surface = 'land'), 0) * 10 + 0.5e0)::BIGINT AS kept_hm, floor((sum(km) - coalesce(sum(km) FILTER (surface = 'land'), 0)) * 10 + 0.5e0)::BIGINT AS removed_hm FROM piece GROUP BY 1 HAVING coalesce(sum(km) FILTER (surface = 'land'), 0) >= 0.1e0"


@query(_mask_twin(), ("v_seg", "v_edge"))
def spa26_cut_to_mask(spark, sf):
    """Lines cut to a mask of polygons: kilometres before, kept and removed; lines left with under 0.1 km go."""
    from chronogaz.plans import queries_audit as Q

    p = A.split_at_shores(*Q._given(spark, sf)).groupBy("line_id")
    kept = F.coalesce(F.sum(F.when(F.col("surface") == "land", F.col("km"))), F.lit(0.0))
    g = p.agg(F.sum("km").alias("b"), kept.alias("k")).where("k >= 0.1")
    return g.select("line_id", geo.scaled(F.col("b"), 10.0).alias("before_hm"), geo.scaled(F.col("k"), 10.0).alias("kept_hm"), geo.scaled(F.col("b") - F.col("k"), 10.0).alias("removed_hm"))
