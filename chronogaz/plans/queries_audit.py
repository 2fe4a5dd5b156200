"""Lines over land and water: split, audited, totals, nearest shore, passes; the twins measure every pair."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogaz.functions import geo
from chronogaz.operators import audit as A
from chronogaz.operators import gridpath as P
from chronogaz.operators import spatial as S
from chronogaz.plans import views as V
from chronogaz.plans.registry import query


def _mx(c: str) -> str:
    return f"(radians({c}) * 6378137e0)"


def _my(c: str) -> str:
    return f"(ln(tan(radians({c}) / 2 + pi() / 4)) * 6378137e0)"


def _rhumb(x1: str, y1: str, x2: str, y2: str) -> str:
    """Kilometres of a Mercator segment along the rhumb line."""
    p = lambda y: f"(2 * atan(exp({y} / 6378137e0)) - pi() / 2)"
    psi = f"(ln(tan({p(y2)} / 2 + pi() / 4) / tan({p(y1)} / 2 + pi() / 4)))"
    q = f"(CASE WHEN abs({psi}) > 1e-12 THEN ({p(y2)} - {p(y1)}) / {psi} ELSE cos({p(y1)}) END)"
    return f"(sqrt(pow({p(y2)} - {p(y1)}, 2) + pow({q} * ({x2} - {x1}) / 6378137e0, 2)) * 6371.0088e0)"


def _cross(a: str, b: str) -> tuple[str, str]:
    den = f"nullif(({a}.x2 - {a}.x1) * ({b}.y2 - {b}.y1) - ({a}.y2 - {a}.y1) * ({b}.x2 - {b}.x1), 0)"
    return tuple(f"((({b}.x1 - {a}.x1) * ({s}.y2 - {s}.y1) - ({b}.y1 - {a}.y1) * ({s}.x2 - {s}.x1)) / {den})" for s in (b, a))


_T, _U = _cross("s", "c")
_BOX = "greatest(s.x1, s.x2) >= least(c.x1, c.x2) AND least(s.x1, s.x2) <= greatest(c.x1, c.x2) AND greatest(s.y1, s.y2) >= least(c.y1, c.y2) AND least(s.y1, s.y2) <= greatest(c.y1, c.y2)"
_FLAT = f""", mseg AS (SELECT line_id, seq, {_mx('x1')} AS x1, {_my('y1')} AS y1, {_mx('x2')} AS x2, {_my('y2')} AS y2 FROM v_seg),
shore AS (SELECT area_id, CASE WHEN area_id % 7 = 0 THEN 'lake' ELSE 'land' END AS kind, {_mx('x1')} AS x1, {_my('y1')} AS y1, {_mx('x2')} AS x2, {_my('y2')} AS y2 FROM v_edge WHERE area_id % 7 = 0 OR area_id % 2 = 0)"""
_PIECES = _FLAT + f""", met AS (SELECT line_id, seq, {_T} AS t FROM mseg s JOIN shore c ON {_BOX} WHERE {_T} BETWEEN 0 AND 1 AND {_U} BETWEEN 0 AND 1),
cuts AS (SELECT line_id, seq, t FROM met UNION SELECT line_id, seq, 0e0 FROM mseg UNION SELECT line_id, seq, 1e0 FROM mseg),
part AS (SELECT * FROM (SELECT line_id, seq, t AS t0, lead(t) OVER (PARTITION BY line_id, seq ORDER BY t) AS t1 FROM cuts) WHERE t1 - t0 > 1e-9),
mid AS (SELECT p.*, x1 + (x2 - x1) * ((t0 + t1) / 2) AS lon, y1 + (y2 - y1) * ((t0 + t1) / 2) AS lat, {_rhumb('(x1 + (x2 - x1) * t0)', '(y1 + (y2 - y1) * t0)', '(x1 + (x2 - x1) * t1)', '(y1 + (y2 - y1) * t1)')} AS km FROM part p JOIN mseg USING (line_id, seq)),
kinds AS (SELECT line_id, seq, t0, min(kind) AS kind FROM (SELECT m.line_id, m.seq, m.t0, kind, area_id FROM mid m JOIN shore ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL),
piece AS (SELECT m.line_id, m.seq, m.t0, m.t1, m.km, coalesce(kind, 'sea') AS surface FROM mid m LEFT JOIN kinds USING (line_id, seq, t0))"""


def _given(spark, sf):
    segs = A.projected(S.segments(V.v_line(spark, sf)))
    e = V.v_edge(spark, sf).where("area_id % 7 = 0 or area_id % 2 = 0").withColumn("kind", F.when(F.col("area_id") % 7 == 0, "lake").otherwise("land"))
    return segs, A.projected(e.select("area_id", "kind", "x1", "y1", "x2", "y2"))


@query(_PIECES + " SELECT line_id, seq::BIGINT AS seq, surface, count(*)::BIGINT AS n, floor(sum(km) * 10 + 0.5e0)::BIGINT AS hm FROM piece GROUP BY 1, 2, 3", ("v_seg", "v_edge"))
def spa18_pieces_by_surface(spark, sf):
    """Segments cut at shores: pieces and their length over each surface."""
    p = A.split_at_shores(*_given(spark, sf)).groupBy("line_id", F.col("seq").cast("long").alias("seq"), "surface")
    return p.agg(F.count("*").alias("n"), geo.scaled(F.sum("km"), 10.0).alias("hm"))


#: Mercator metres of a cell of the grid, its box in degrees, and how far and how much steps are dearer off the shore.
CELL_M, BOX, WITHIN_KM, WEIGHT = 200_000, (-10, 20, 50, 50), 300, 4
_MOVES = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]


def _ground(y: str) -> str:
    return f"({6371.0088 * 1000 / 6378137!r}e0 / cosh(({y}) / 6378137e0))"


_KM = f"{CELL_M / 1000!r}e0"
_STEP = "CASE WHEN {m}.dy = 0 THEN {c}.level * {m}.unit WHEN {m}.dy > 0 THEN {c}.up * {m}.unit ELSE {c}.down * {m}.unit END"
_CELLS = f""", moves AS (SELECT * FROM (VALUES {', '.join(f"({i}, {j}, {2 ** 0.5 if i and j else float(bool(i or j))!r}e0)" for i, j in _MOVES)}) AS v(dx, dy, unit)),
gx AS (SELECT unnest(range(floor({_mx(str(BOX[0]))} / {CELL_M})::BIGINT, floor({_mx(str(BOX[2]))} / {CELL_M})::BIGINT + 1)) AS x), gy AS (SELECT unnest(range(floor({_my(str(BOX[1]))} / {CELL_M})::BIGINT, floor({_my(str(BOX[3]))} / {CELL_M})::BIGINT + 1)) AS y),
gc AS (SELECT x, y, (x + 0.5e0) * {CELL_M} AS cx, (y + 0.5e0) * {CELL_M} AS cy FROM gx, gy),
gk AS (SELECT x, y, min(kind) AS kind FROM (SELECT x, y, kind, area_id FROM gc JOIN shore ON (y1 > cy) <> (y2 > cy) AND cx < x1 + (cy - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL),
gs AS (SELECT x, y, coalesce(kind, 'sea') AS surface, {_ground('cy')} * {_KM} AS level, {_ground(f'cy - {CELL_M / 2!r}e0')} * {_KM} AS up, {_ground(f'cy + {CELL_M / 2!r}e0')} * {_KM} AS down FROM gc LEFT JOIN gk USING (x, y))"""
_NET = """, ge AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, """ + _STEP.format(m="m", c="b") + """ AS w FROM gw a CROSS JOIN moves m JOIN gw b ON b.x = a.x + m.dx AND b.y = a.y + m.dy WHERE unit > 0 AND (dx = 0 OR dy = 0 OR (EXISTS (SELECT 1 FROM gw c WHERE c.x = a.x + dx AND c.y = a.y) AND EXISTS (SELECT 1 FROM gw c WHERE c.x = a.x AND c.y = a.y + dy))))"""
_BASE = _CELLS + ", gw AS (SELECT * FROM gs WHERE surface <> 'land')" + _NET + f""", en AS (SELECT line_id, {_mx('x1')} AS x1, {_my('y1')} AS y1, {_mx('x2')} AS x2, {_my('y2')} AS y2 FROM (SELECT line_id, arg_min(lon, seq) AS x1, arg_min(lat, seq) AS y1, arg_max(lon, seq) AS x2, arg_max(lat, seq) AS y2 FROM v_line GROUP BY 1 HAVING count(*) > 1)),
ec AS (SELECT line_id, floor(x1 / {CELL_M})::BIGINT AS sx, floor(y1 / {CELL_M})::BIGINT AS sy, floor(x2 / {CELL_M})::BIGINT AS tx, floor(y2 / {CELL_M})::BIGINT AS ty, {_rhumb('x1', 'y1', 'x2', 'y2')} AS direct FROM en JOIN orders ON o_orderkey = line_id AND o_orderstatus = 'F'),
gp(sx, sy, x, y, cost) USING KEY (sx, sy, x, y) AS (SELECT sx, sy, g.x, g.y, {_STEP.format(m='m', c='g')} FROM (SELECT DISTINCT sx, sy FROM ec) CROSS JOIN moves m JOIN gw g ON g.x = sx + m.dx AND g.y = sy + m.dy
  UNION SELECT n.sx, n.sy, n.x, n.y, n.cost FROM (SELECT sx, sy, bx AS x, by_ AS y, min(cost + w) AS cost FROM gp JOIN ge ON ax = gp.x AND ay = gp.y GROUP BY ALL) n LEFT JOIN recurring.gp k ON k.sx = n.sx AND k.sy = n.sy AND k.x = n.x AND k.y = n.y WHERE k.cost IS NULL OR n.cost < k.cost),
bl AS (SELECT line_id, greatest(min(cost + ({_STEP.format(m='m', c='g')})), any_value(direct)) AS baseline_km FROM ec CROSS JOIN moves m JOIN gw g ON g.x = tx + m.dx AND g.y = ty + m.dy JOIN gp ON gp.sx = ec.sx AND gp.sy = ec.sy AND gp.x = g.x AND gp.y = g.y GROUP BY 1)"""
_STAGES = _BASE + """, stage AS (SELECT o_orderkey AS line_id, CASE o_orderstatus WHEN 'F' THEN 'sea' WHEN 'O' THEN 'land' ELSE 'unknown' END AS mode, CASE WHEN o_orderkey % 9 = 0 THEN 'unstated' WHEN o_orderstatus = 'F' THEN 'sea' WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'road' WHEN 1 THEN 'straight' ELSE 'shortest' END ELSE 'unknown' END AS method,
CASE WHEN o_orderkey % 10 = 0 THEN 11e0 ELSE 0e0 END AS from_off_m, CASE WHEN o_orderkey % 14 = 0 THEN 2e0 ELSE 0.5e0 END AS to_off_m, o_orderkey % 5 = 0 AS reason, o_orderkey % 4 <> 0 AS recorded, baseline_km
FROM orders JOIN (SELECT DISTINCT line_id AS l FROM en) ON l = o_orderkey LEFT JOIN bl ON bl.line_id = o_orderkey)"""
_AUDIT = _PIECES + _STAGES + f""", pr AS (SELECT *, CASE WHEN mode = 'sea' THEN surface = 'land' ELSE surface <> 'land' END AS bad FROM piece JOIN stage USING (line_id) WHERE mode <> 'unknown'),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY seq, t0 ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN bad IS DISTINCT FROM lag(bad) OVER (PARTITION BY line_id ORDER BY seq, t0) THEN 1 ELSE 0 END AS fresh FROM pr)),
rs AS (SELECT *, max(run) OVER (PARTITION BY line_id) AS last FROM (SELECT line_id, run, bad, sum(km) AS km FROM rn GROUP BY ALL)),
ms AS (SELECT line_id, sum(km) AS length_km, coalesce(sum(km) FILTER (bad AND run = 1), 0) AS start_km, coalesce(sum(km) FILTER (bad AND run = last AND run > 1), 0) AS end_km, coalesce(sum(km) FILTER (bad AND run > 1 AND run < last), 0) AS crossing_km FROM rs GROUP BY 1),
tu AS (SELECT line_id, seq, {_rhumb('x1', 'y1', 'x2', 'y2')} AS km, x2 - x1 AS dx, y2 - y1 AS dy FROM mseg),
tw AS (SELECT line_id, seq, km, atan2(lag(dx) OVER w * dy - lag(dy) OVER w * dx, lag(dx) OVER w * dx + lag(dy) OVER w * dy) AS t1, atan2(dx * lead(dy) OVER w - dy * lead(dx) OVER w, dx * lead(dx) OVER w + dy * lead(dy) OVER w) AS t2 FROM tu WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
st AS (SELECT line_id, count(*)::BIGINT AS steps FROM tw WHERE km < 2 AND t1 * t2 < 0 AND abs(t1) > radians(20e0) AND abs(t2) > radians(20e0) GROUP BY 1),
au AS (SELECT g.line_id, mode, method, length_km, coalesce(start_km, 0) AS start_km, coalesce(end_km, 0) AS end_km, coalesce(crossing_km, 0) AS crossing_km, coalesce(steps, 0) AS steps, CASE WHEN mode = 'sea' THEN length_km / nullif(baseline_km, 0) END AS ratio, baseline_km, n_vertices, from_off_m, to_off_m, reason, recorded
FROM stage g JOIN (SELECT line_id, count(*) AS n_vertices FROM v_line GROUP BY 1) USING (line_id) LEFT JOIN ms USING (line_id) LEFT JOIN st USING (line_id)),
fl AS (SELECT *, array_to_string(list_filter([CASE WHEN from_off_m > 1 THEN 'starts off its stop' END, CASE WHEN to_off_m > 1 THEN 'ends off its stop' END,
CASE WHEN NOT CASE mode WHEN 'unknown' THEN method = 'unknown' WHEN 'sea' THEN method = 'sea' ELSE method IN ('road', 'straight', 'shortest') END THEN 'method ' || method END,
CASE WHEN mode = 'unknown' AND n_vertices <> 2 THEN 'path not known, but not straight' END, CASE WHEN method = 'straight' AND n_vertices <> 2 THEN 'recorded as straight, but has vertices' END, CASE WHEN mode <> 'unknown' AND crossing_km > 0 THEN 'crosses ' || w END,
CASE WHEN mode <> 'unknown' AND start_km > lim THEN 'start: too far over ' || w END, CASE WHEN mode <> 'unknown' AND start_km > 0 AND NOT recorded THEN 'start: ' || CASE WHEN start_km > 3 THEN 'approach' ELSE 'connector' END || ' not recorded' END,
CASE WHEN mode <> 'unknown' AND end_km > lim THEN 'end: too far over ' || w END, CASE WHEN mode <> 'unknown' AND end_km > 0 AND NOT recorded THEN 'end: ' || CASE WHEN end_km > 3 THEN 'approach' ELSE 'connector' END || ' not recorded' END,
CASE WHEN mode <> 'unknown' AND steps > 0 THEN 'staircase' END, CASE WHEN mode = 'sea' AND baseline_km IS NULL THEN 'no path over water' END, CASE WHEN mode = 'sea' AND ratio > 1.25e0 AND NOT reason THEN 'detour without a reason' END], lambda x: x IS NOT NULL), '; ') AS failures
FROM (SELECT *, CASE WHEN mode = 'sea' THEN 'land' ELSE 'water' END AS w, CASE WHEN mode = 'sea' THEN 30 ELSE 3 END AS lim FROM au))"""


def _box() -> tuple[float, float, float, float]:
    """The grid's box in Mercator metres."""
    y = lambda lat: math.log(math.tan(math.radians(lat) / 2 + math.pi / 4)) * geo.MERCATOR_M
    return math.radians(BOX[0]) * geo.MERCATOR_M, y(BOX[1]), math.radians(BOX[2]) * geo.MERCATOR_M, y(BOX[3])


def _audited(spark, sf):
    segs, shores = _given(spark, sf)
    o, k = V.read(spark, sf, "orders"), F.col("o_orderkey")
    status = F.col("o_orderstatus")
    mode = F.when(status == "F", "sea").when(status == "O", "land").otherwise("unknown")
    method = F.when(k % 9 == 0, "unstated").when(status == "F", "sea").when(status == "O", F.when(k % 3 == 0, "road").when(k % 3 == 1, "straight").otherwise("shortest")).otherwise("unknown")
    ends = V.v_line(spark, sf).groupBy("line_id").agg(F.min(F.struct("seq", "lon", "lat")).alias("a"), F.max(F.struct("seq", "lon", "lat")).alias("z")).where("a.seq < z.seq")
    ends = A.projected(ends.select("line_id", F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("z.lon").alias("x2"), F.col("z.lat").alias("y2")))
    by_sea = ends.join(o.where(status == "F").select(k.alias("line_id")), "line_id", "left_semi")
    baselines = ends.select("line_id").join(A.water_baselines(by_sea, shores, _box(), CELL_M), "line_id", "left")
    stages = o.select(k.alias("line_id"), mode.alias("mode"), method.alias("method"), F.when(k % 10 == 0, 11.0).otherwise(0.0).alias("from_off_m"), F.when(k % 14 == 0, 2.0).otherwise(0.5).alias("to_off_m"), (k % 5 == 0).alias("reason"), (k % 4 != 0).alias("recorded"))
    return A.audit(segs, shores, stages.join(baselines, "line_id"))


_HM = ", ".join(f"floor({c} * 10 + 0.5e0)::BIGINT AS {c[:-3]}_hm" for c in ("length_km", "start_km", "end_km", "crossing_km"))


@query(_AUDIT + f" SELECT line_id, mode, method, {_HM}, steps, floor(ratio * 1000 + 0.5e0)::BIGINT AS ratio, failures FROM fl", ("v_seg", "v_edge"))
def spa19_line_audit(spark, sf):
    """Every line against the rules of its mode: connectors, wrong surface, ends, method, steps, detours."""
    rows = _audited(spark, sf)
    hm = [geo.scaled(F.col(c), 10.0).alias(f"{c[:-3]}_hm") for c in ("length_km", "start_km", "end_km", "crossing_km")]
    return rows.select("line_id", "mode", "method", *hm, F.col("steps").cast("long").alias("steps"), geo.scaled(F.col("ratio")).alias("ratio"), F.array_join("failures", "; ").alias("failures"))


@query(_AUDIT + """ SELECT count(*)::BIGINT AS n_lines, count(*) FILTER (failures <> '')::BIGINT AS n_failing, count(*) FILTER (mode = 'sea')::BIGINT AS n_sea, count(*) FILTER (mode = 'land')::BIGINT AS n_land, count(*) FILTER (mode = 'unknown')::BIGINT AS n_unknown,
floor(coalesce(sum(crossing_km) FILTER (mode = 'sea'), 0) + 0.5e0)::BIGINT AS sea_over_land_km, floor(coalesce(sum(crossing_km) FILTER (mode = 'land'), 0) + 0.5e0)::BIGINT AS land_over_water_km, sum((start_km > 3)::INT + (end_km > 3)::INT)::BIGINT AS n_long_connectors,
floor(max(greatest(start_km, end_km)) * 10 + 0.5e0)::BIGINT AS largest_connector_hm, floor(max(greatest(CASE WHEN start_km <= 3 THEN start_km ELSE 0 END, CASE WHEN end_km <= 3 THEN end_km ELSE 0 END)) * 10 + 0.5e0)::BIGINT AS largest_within_hm,
floor(max(ratio) * 1000 + 0.5e0)::BIGINT AS worst_ratio, (SELECT line_id FROM fl WHERE ratio IS NOT NULL ORDER BY ratio DESC, line_id LIMIT 1) AS worst_line, sum(steps)::BIGINT AS n_steps FROM fl""", ("v_seg", "v_edge"))
def agg12_audit_totals(spark, sf):
    t = A.totals(_audited(spark, sf))
    whole = lambda c, k, name: geo.scaled(F.col(c), k).alias(name)
    return t.select("n_lines", "n_failing", "n_sea", "n_land", "n_unknown", whole("sea_over_land_km", 1.0, "sea_over_land_km"), whole("land_over_water_km", 1.0, "land_over_water_km"), F.col("n_long_connectors").cast("long").alias("n_long_connectors"), whole("largest_connector_km", 10.0, "largest_connector_hm"), whole("largest_within_km", 10.0, "largest_within_hm"), whole("worst_ratio", 1000.0, "worst_ratio"), "worst_line", F.col("n_steps").cast("long").alias("n_steps"))


def _seg_km(a: str, b: str) -> str:
    """Ground kilometres between two Mercator segments, in the oracle's SQL."""
    t, u = _cross(a, b)

    def one(px: str, py: str, s: str, fixed: int | None = None) -> str:
        ex, ey = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
        n = f"({ex} * {ex} + {ey} * {ey})"
        k = f"(CASE WHEN {n} > 0 THEN greatest(0e0, least(1e0, (({px} - {s}.x1) * {ex} + ({py} - {s}.y1) * {ey}) / {n})) ELSE 0e0 END)"
        at = k if fixed is None else f"{fixed}e0"
        return f"sqrt(pow({px} - {s}.x1 - {k} * {ex}, 2) + pow({py} - {s}.y1 - {k} * {ey}, 2)) * ({6371.0088 * 1000 / 6378137!r}e0 / cosh(({a}.y1 + ({a}.y2 - {a}.y1) * {at}) / 6378137e0)) / 1000"

    apart = f"least({one(f'{b}.x1', f'{b}.y1', a)}, {one(f'{b}.x2', f'{b}.y2', a)}, {one(f'{a}.x1', f'{a}.y1', b, 0)}, {one(f'{a}.x2', f'{a}.y2', b, 1)})"
    return f"(CASE WHEN coalesce({t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1, false) THEN 0e0 ELSE {apart} END)"


def _near_box(m: int) -> str:
    return f"greatest(s.x1, s.x2) >= least(c.x1, c.x2) - {m} AND least(s.x1, s.x2) <= greatest(c.x1, c.x2) + {m} AND greatest(s.y1, s.y2) >= least(c.y1, c.y2) - {m} AND least(s.y1, s.y2) <= greatest(c.y1, c.y2) + {m}"


@query(_FLAT + f""", ln AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY seq) - len AS before, sum(len) OVER (PARTITION BY line_id) AS total FROM (SELECT *, {_rhumb('x1', 'y1', 'x2', 'y2')} AS len FROM mseg) WHERE len > 0),
az AS (SELECT *, greatest(0e0, (6 - before) / len) AS a, least(1e0, (total - 6 - before) / len) AS z FROM ln),
s AS (SELECT line_id, x1 + (x2 - x1) * a AS x1, y1 + (y2 - y1) * a AS y1, x1 + (x2 - x1) * z AS x2, y1 + (y2 - y1) * z AS y2 FROM az WHERE a < z),
nr AS (SELECT line_id, min({_seg_km('s', 'c')}) AS km FROM s JOIN shore c ON {_near_box(20000)} GROUP BY 1)
SELECT line_id, floor(least(4, coalesce(km, 4)) * 1000 + 0.5e0)::BIGINT AS m FROM (SELECT DISTINCT line_id FROM mseg) LEFT JOIN nr USING (line_id)""", ("v_seg", "v_edge"))
def spa21_nearest_shore(spark, sf):
    """How near each line comes to a shore, six kilometres from its ends on, up to four kilometres."""
    segs, shores = _given(spark, sf)
    skips = segs.select("line_id").distinct().select("line_id", F.lit(6.0).alias("start_km"), F.lit(6.0).alias("end_km"))
    return A.nearest_shore(segs, shores.select("x1", "y1", "x2", "y2"), skips).select("line_id", geo.scaled(F.col("km")).alias("m"))


@query(_FLAT + f""", isl AS (SELECT area_id AS key, x1, y1, x2, y2 FROM shore WHERE area_id % 7 = 0), gate AS (SELECT id AS key, {_mx('lon')} AS x1, {_my('lat')} AS y1, {_mx('lon')} AS x2, {_my('lat + 0.5')} AS y2 FROM v_site WHERE id % 10 = 1)
SELECT line_id, kind, key, min(seq)::BIGINT AS at FROM (SELECT line_id, 'point' AS kind, id AS key, seq FROM v_site p JOIN v_seg ON {V.seg('p.lon', 'p.lat')} <= 5
UNION ALL SELECT line_id, 'island', c.key, seq FROM mseg s JOIN isl c ON {_near_box(40000)} WHERE {_seg_km('s', 'c')} <= 10
UNION ALL SELECT line_id, 'gate', c.key, seq FROM mseg s JOIN gate c ON {_BOX} WHERE {_T} BETWEEN 0 AND 1 AND {_U} BETWEEN 0 AND 1) GROUP BY 1, 2, 3""", ("v_seg", "v_edge", "v_site"))
def spa20_passes(spark, sf):
    """Where each line first passes a site, an island's shore, or a gate that goes half a degree north of a site."""
    site = V.v_site(spark, sf)
    islands = V.v_edge(spark, sf).where("area_id % 7 = 0").select(F.col("area_id").cast("long").alias("key"), "x1", "y1", "x2", "y2")
    gates = site.where("id % 10 = 1").select(F.col("id").alias("key"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), (F.col("lat") + 0.5).alias("y2"))
    return A.passes(S.segments(V.v_line(spark, sf)), site, islands, gates)


_PEN = f""", blocked AS (SELECT x, y FROM gs WHERE surface = 'land'), gd AS (SELECT g.x, g.y, min((g.x - b.x) * (g.x - b.x) + (g.y - b.y) * (g.y - b.y)) AS d2 FROM gs g JOIN blocked b ON (g.x - b.x) * (g.x - b.x) + (g.y - b.y) * (g.y - b.y) <= 4 WHERE surface <> 'land' GROUP BY ALL),
gw AS (SELECT x, y, level * raised AS level, up * raised AS up, down * raised AS down FROM (SELECT gs.*, 1 + greatest(0e0, {WITHIN_KM}e0 - coalesce(sqrt(d2) * level, {WITHIN_KM}e0)) / {WITHIN_KM}e0 * {WEIGHT}e0 AS raised FROM gs LEFT JOIN gd USING (x, y) WHERE surface <> 'land'))"""
_ISLANDS = f""", shore AS (SELECT area_id, 'land' AS kind, {_mx('x1')} AS x1, {_my('y1')} AS y1, {_mx('x2')} AS x2, {_my('y2')} AS y2 FROM v_edge WHERE area_id IN (6, 8, 16, 18))"""
_WAYS = _ISLANDS + _CELLS + _PEN + _NET + f""", mid AS (SELECT area_id, floor({_mx('(min(x1) + max(x1)) / 2')} / {CELL_M})::BIGINT AS x, floor({_my('(min(y1) + max(y1)) / 2')} / {CELL_M})::BIGINT AS y FROM v_edge GROUP BY 1),
task AS (SELECT s_suppkey AS search, floor({_mx('lon')} / {CELL_M})::BIGINT AS sx, floor({_my('lat')} / {CELL_M})::BIGINT AS sy, m.x AS mx, m.y AS my, t.x AS tx, t.y AS ty FROM supplier JOIN v_site ON id = s_suppkey JOIN mid m ON m.area_id = s_nationkey JOIN mid t ON t.area_id = (s_nationkey + 6) % 25),
gp(search, x, y, layer, cost, mx, my) USING KEY (search, x, y, layer) AS (SELECT search, g.x, g.y, CASE WHEN (g.x - mx) * (g.x - mx) + (g.y - my) * (g.y - my) <= 4 THEN 1 ELSE 0 END, {_STEP.format(m='m', c='g')}, mx, my FROM task CROSS JOIN moves m JOIN gw g ON g.x = sx + m.dx AND g.y = sy + m.dy
  UNION SELECT n.search, n.x, n.y, n.layer, n.cost, n.mx, n.my FROM (SELECT search, bx AS x, by_ AS y, CASE WHEN layer = 1 OR (bx - mx) * (bx - mx) + (by_ - my) * (by_ - my) <= 4 THEN 1 ELSE 0 END AS layer, min(cost + w) AS cost, mx, my FROM gp JOIN ge ON ax = gp.x AND ay = gp.y GROUP BY ALL) n
  LEFT JOIN recurring.gp k ON k.search = n.search AND k.x = n.x AND k.y = n.y AND k.layer = n.layer WHERE k.cost IS NULL OR n.cost < k.cost)
SELECT t.search, floor(min(cost + ({_STEP.format(m='m', c='g')})) * 10 + 0.5e0)::BIGINT AS total_hm, true AS traced FROM task t CROSS JOIN moves m JOIN gw g ON g.x = tx + m.dx AND g.y = ty + m.dy JOIN gp ON gp.search = t.search AND gp.x = g.x AND gp.y = g.y AND layer = 1 GROUP BY 1"""


@query(_WAYS, ("v_edge", "v_site"))
def grf4_ways_through_targets(spark, sf):
    """Least-cost ways over water around four islands from each site past the middle of its nation's area to the middle of another one, dearer
    near land; each way is traced back, and its own steps must sum to its cost. Sites in one cell with one nation are one search: searches are
    bounded by the grid and the nations, not by the sites."""
    shores = A.projected(V.v_edge(spark, sf).where("area_id in (6, 8, 16, 18)").select("area_id", F.lit("land").alias("kind"), "x1", "y1", "x2", "y2"))
    all_ = A.water_cells(shores, _box(), CELL_M, ("sea", "lake", "land")).transform(P.checkpointed)
    free, blocked = all_.where("surface <> 'land'"), all_.where("surface = 'land'")
    steps = P.checkpointed(A.grid_steps(free.select("x", "y"), CELL_M, P.clearance(free, blocked, 2), float(WITHIN_KM), float(WEIGHT)))
    middle = V.v_edge(spark, sf).groupBy("area_id").agg(((F.min("x1") + F.max("x1")) / 2).alias("lon"), ((F.min("y1") + F.max("y1")) / 2).alias("lat"))
    middle = middle.select("area_id", *[c.alias(n) for c, n in zip(geo.mercator(F.col("lon"), F.col("lat")), ("px", "py"))])
    site = V.v_site(spark, sf).select("id", *[c.alias(n) for c, n in zip(geo.mercator(F.col("lon"), F.col("lat")), ("px", "py"))])
    own = V.read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").alias("one")).join(site, "id")
    at = [F.floor(F.col(c) / CELL_M).cast("long") for c in ("px", "py")]
    own = P.checkpointed(own.withColumn("search", ((at[0] + 32768) * 65536 + at[1] + 32768) * 64 + F.col("one")))
    of = P.checkpointed(own.groupBy("search", "one", ((F.col("one") + 6) % 25).alias("two")).agg(F.min("px").alias("sx"), F.min("py").alias("sy")))
    sources = A.joinable(of.select("search", F.col("sx").alias("px"), F.col("sy").alias("py")), steps, CELL_M)
    of = of.drop("sx", "sy")
    past = of.join(middle, of["one"] == middle["area_id"]).select("search", F.floor(F.col("px") / CELL_M).alias("x"), F.floor(F.col("py") / CELL_M).alias("y"))
    disc = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]))
    targets = past.select("search", F.lit(0).alias("layer"), disc.alias("c")).select("search", "layer", "c.*")
    states = P.least_costs(steps, sources, targets)
    goals = A.joinable(of.join(middle, of["two"] == middle["area_id"]).select("search", F.lit(0).cast("long").alias("goal"), F.lit(1).cast("long").alias("layer"), "px", "py"), steps, CELL_M)
    reached = P.checkpointed(P.ends(states, goals))
    w = Window.partitionBy("search").orderBy("back")
    cells = P.traced(states, reached).withColumns({"fx": F.lead("x").over(w), "fy": F.lead("y").over(w)})
    up, aside = F.col("y") - F.col("fy"), F.col("x") != F.col("fx")
    step = F.when(up == 0, F.col("level")).when(up > 0, F.when(aside, F.col("diagonal_up")).otherwise(F.col("up"))).otherwise(F.when(aside, F.col("diagonal_down")).otherwise(F.col("down")))
    walked = cells.join(steps, ["x", "y"]).groupBy("search").agg(F.sum(F.when(F.col("fx").isNotNull(), step).otherwise(0.0)).alias("walked"), F.max_by(F.struct("x", "y"), "back").alias("first"))
    joined = walked.join(sources.withColumnsRenamed({"x": "ax", "y": "ay", "cost": "a_cost", "search": "_s"}), (F.col("search") == F.col("_s")) & (F.col("first.x") == F.col("ax")) & (F.col("first.y") == F.col("ay")))
    final = reached.join(goals.select("search", "x", "y", F.col("cost").alias("z_cost")), ["search", "x", "y"]).join(joined.select("search", "walked", "a_cost"), "search")
    told = P.checkpointed(final.select("search", geo.scaled(F.col("total"), 10.0).alias("total_hm"), (F.abs(F.col("walked") + F.col("a_cost") + F.col("z_cost") - F.col("total")) < 1e-6).alias("traced")))
    return own.select("id", "search").join(told, "search").select(F.col("id").alias("search"), "total_hm", "traced")
