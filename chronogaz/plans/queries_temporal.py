"""Temporal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogaz.operators import temporal as T
from chronogaz.plans import views as V
from chronogaz.plans.registry import query

_ISLAND = """SELECT *, sum(fresh) OVER (PARTITION BY area_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN lag(t) OVER w = f AND {same} THEN 0 ELSE 1 END AS fresh FROM v_period WINDOW w AS (PARTITION BY area_id ORDER BY f, t))"""
_BOTH = "lag(holder) OVER w IS NOT DISTINCT FROM holder AND lag(note) OVER w IS NOT DISTINCT FROM note"


@query(f"""SELECT area_id, holder, note, min(f) AS "from", max(t) AS "to", string_agg('o:' || id, ',' ORDER BY 'o:' || id) AS sources FROM ({_ISLAND.format(same=_BOTH)}) GROUP BY area_id, holder, note, island""", ("v_period",))
def win1_merge_periods(spark, sf):
    return T.merge_touching(V.v_period(spark, sf), ["area_id"], ["holder", "note"]).withColumn("sources", F.array_join("sources", ","))


@query("""
, c AS (SELECT *, greatest(9400, coalesce(max(t) OVER (PARTITION BY area_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9400)) AS cur FROM v_period)
SELECT area_id, 'gap' AS kind, cur::BIGINT AS "from", f AS "to" FROM c WHERE f > cur
UNION ALL SELECT area_id, 'overlap', f, cur::BIGINT FROM c WHERE f < cur
UNION ALL SELECT area_id, 'gap', e, 11000 FROM (SELECT area_id, greatest(9400, max(t))::BIGINT AS e FROM v_period GROUP BY area_id) WHERE e < 11000""", ("v_period",))
def win2_coverage(spark, sf):
    return T.coverage(V.v_period(spark, sf).select("area_id", "from", "to"), ["area_id"], F.lit(9400).cast("long"), F.lit(11000).cast("long"))


@query(f"SELECT area_id, id FROM (SELECT *, lag(t) OVER w = f AND {_BOTH} AS hit FROM v_period WINDOW w AS (PARTITION BY area_id ORDER BY f, t)) WHERE hit", ("v_period",))
def win3_adjacent_same_state(spark, sf):
    return T.adjacent_same(V.v_period(spark, sf), ["area_id"], ["holder", "note"]).select("area_id", "id")


@query("""
, pp AS (SELECT f, lag(t) OVER w = f AS meets, lag(holder) OVER w IS DISTINCT FROM holder OR lag(note) OVER w IS DISTINCT FROM note AS differs FROM v_period WINDOW w AS (PARTITION BY area_id ORDER BY f, t)),
st AS (SELECT DISTINCT d + o_orderkey % 3 AS stop FROM v_day)
SELECT stop, count(f)::BIGINT AS n_meeting, coalesce(bool_or(differs), false) AS changes FROM st LEFT JOIN pp ON f = stop AND meets GROUP BY 1""", ("v_period",))
def win3_stops_with_change(spark, sf):
    """Stops, and whether the state of any area changes there."""
    stops = V.read(spark, sf, "orders").select((V.day("o_orderdate") + F.col("o_orderkey") % 3).alias("stop"))
    return T.stop_changes(V.v_period(spark, sf), ["area_id"], ["holder", "note"], stops)


@query(f"SELECT area_id, id, min(f) OVER (PARTITION BY area_id, island) AS run_from, max(t) OVER (PARTITION BY area_id, island) AS run_to FROM ({_ISLAND.format(same='lag(holder) OVER w IS NOT DISTINCT FROM holder')})", ("v_period",))
def win4_holder_runs(spark, sf):
    return T.holder_runs(V.v_period(spark, sf), ["area_id"], "holder").select("area_id", "id", "run_from", "run_to")


def _as_of(spark, sf, or_first):
    e = V.read(spark, sf, "events")
    left, right = (e.where(F.col("event_type") == k).select("event_id", "user_id", "ts") for k in ("purchase", "signup"))
    return T.as_of(left, right, "user_id", "ts", "event_id", "event_id", or_first).select("event_id", "user_id", F.col("matched").alias("signup_id"))


_ASOF = "SELECT p.event_id, p.user_id, {} AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p"
_LAST = "(SELECT s.event_id FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts <= p.ts ORDER BY s.ts DESC, s.event_id DESC LIMIT 1)"
_FIRST = "(SELECT s.event_id FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id ORDER BY s.ts, s.event_id LIMIT 1)"


@query(_ASOF.format(_LAST))
def jon8_as_of(spark, sf):
    return _as_of(spark, sf, False)


@query(_ASOF.format(f"coalesce({_LAST}, {_FIRST})"))
def jon9_as_of_or_first(spark, sf):
    return _as_of(spark, sf, True)


@query("""SELECT c.c_custkey AS area_id, p.holder, p.id FROM customer c LEFT JOIN v_period p ON p.area_id = c.c_custkey AND p.f <= 10000 AND 10000 < p.t""", ("v_period",))
def jon10_holder_at(spark, sf):
    pts = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("area_id"), F.lit(10000).cast("long").alias("at"))
    return T.holder_at(pts, V.v_period(spark, sf), "area_id", "at", 365).select(pts["area_id"], "holder", "id")


_WIDE = "SELECT o_custkey AS k, o_orderkey AS id, d AS f, d + 90 AS t FROM v_day"


@query(f"SELECT a.k AS area_id, a.id AS a_id, b.id AS b_id FROM ({_WIDE}) a JOIN ({_WIDE}) b ON a.k = b.k AND a.id < b.id AND a.f < b.t AND b.f < a.t", ("v_day",))
def jon11_interval_overlaps(spark, sf):
    o = V.read(spark, sf, "orders").select(F.col("o_custkey").alias("area_id"), "o_orderkey", V.day("o_orderdate").alias("f"))
    a, b = (o.select("area_id", F.col("o_orderkey").alias(f"{s}_id"), F.col("f").alias(f"{s}_from"), (F.col("f") + 90).alias(f"{s}_to")) for s in "ab")
    return T.overlaps(a, b, "area_id", 180).where("a_id < b_id").select("area_id", "a_id", "b_id")


_SPLIT = """
, hit AS (SELECT p.area_id, p.id, p.f, p.t, p.holder, o.f AS of_, o.t AS ot FROM v_period p LEFT JOIN v_override o ON o.area_id = p.area_id AND o.f < p.t AND p.f < o.t),
cut AS (SELECT DISTINCT area_id, id, f, t, holder, unnest([f, t, greatest(f, coalesce(of_, f)), least(t, coalesce(ot, t))]) AS c FROM hit),
piece AS (SELECT area_id, id, holder, c AS f, lead(c) OVER (PARTITION BY area_id, id ORDER BY c) AS t FROM cut),
laid AS (SELECT p.area_id, p.f, p.t, CASE WHEN o.id IS NULL THEN p.holder ELSE 'X' END AS holder FROM piece p LEFT JOIN v_override o ON o.area_id = p.area_id AND o.f <= p.f AND p.t <= o.t WHERE p.t IS NOT NULL)
"""


@query(_SPLIT + 'SELECT area_id, f AS "from", t AS "to", holder FROM laid', ("v_period", "v_override"))
def jon12_override_split(spark, sf):
    return T.override(V.v_period(spark, sf).select("area_id", "from", "to", "holder"), V.v_override(spark, sf), "area_id")


@query(_SPLIT + """SELECT area_id, holder, min(f) AS "from", max(t) AS "to" FROM (SELECT *, sum(fresh) OVER (PARTITION BY area_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN lag(t) OVER w = f AND lag(holder) OVER w = holder THEN 0 ELSE 1 END AS fresh FROM laid WINDOW w AS (PARTITION BY area_id ORDER BY f))) GROUP BY area_id, holder, island""", ("v_period", "v_override"))
def tmp1_derived_history(spark, sf):
    return T.merge_touching(T.override(V.v_period(spark, sf).select("area_id", "from", "to", "holder"), V.v_override(spark, sf), "area_id"), ["area_id"], ["holder"])


@query("""SELECT id, CASE WHEN holder IS NULL THEN 'Unknown holder' WHEN note LIKE '1%' THEN holder || ' (' || note || ')' ELSE holder END AS label FROM v_period""", ("v_period",))
def tmp2_holder_label(spark, sf):
    label = F.when(F.col("holder").isNull(), "Unknown holder").when(F.col("note").startswith("1"), F.concat("holder", F.lit(" ("), "note", F.lit(")"))).otherwise(F.col("holder"))
    return V.v_period(spark, sf).select("id", label.alias("label"))


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN d >= d + o_orderkey % 5 - 2 THEN 'order' END, CASE WHEN d < 9400 THEN 'range' END, CASE WHEN o_orderkey % 11 = 0 THEN 'year0' END], lambda x: x IS NOT NULL), ',') AS broken
FROM v_day WHERE d >= d + o_orderkey % 5 - 2 OR d < 9400 OR o_orderkey % 11 = 0""", ("v_day",))
def tmp4_interval_rules(spark, sf):
    o = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), V.day("o_orderdate").alias("f")).withColumn("t", F.col("f") + F.col("id") % 5 - 2).withColumn("year", F.col("id") % 11)
    rules = F.array_compact(F.array(F.when(F.col("f") >= F.col("t"), "order"), F.when(F.col("f") < 9400, "range"), F.when(F.col("year") == 0, "year0")))
    return o.select("id", F.array_join(rules, ",").alias("broken")).where("broken <> ''")
