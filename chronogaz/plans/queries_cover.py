"""Cover and cut: cells of areas, overlap, gaps, provenance of outlines, lines against masks, simplification."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogaz.operators import spatial as S
from chronogaz.plans import views as V
from chronogaz.plans.registry import query



def _edges(spark, sf):
    return V.v_edge(spark, sf).select("area_id", "x1", "y1", "x2", "y2")


@query(f""", smp AS (SELECT area_id, seq, k, x1 + k / n * (x2 - x1) AS lon, y1 + k / n * (y2 - y1) AS lat FROM (SELECT *, unnest(range(0, n::BIGINT)) AS k FROM (SELECT *, greatest(1, ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 1.5e0)) AS n FROM v_edge)))
SELECT area_id, count(*)::BIGINT AS n_samples, count(*) FILTER (hit)::BIGINT AS n_near, bool_and(hit) AS proven FROM (SELECT area_id, EXISTS (SELECT 1 FROM v_seg WHERE {V.seg('s.lon', 's.lat')} <= 5) AS hit FROM smp s) GROUP BY 1""", ("v_edge", "v_seg"))
def spa16_outline_provenance(spark, sf):
    """Samples of an outline that lie within 5 km of a permitted line; proven if all do."""
    s = S.densify(V.v_edge(spark, sf), ["area_id", "seq"], 1.5)
    s = s.withColumn("id", F.col("area_id").cast("long") * 1000000 + F.col("seq") * 10000 + F.col("k"))
    seg = S.segments(V.v_line(spark, sf)).select("x1", "y1", "x2", "y2")
    hit = S.nearest_edge(s, seg, 5.0, []).select("id", F.lit(True).alias("_hit"))
    g = s.join(hit, "id", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).groupBy("area_id")
    return g.agg(F.count("*").alias("n_samples"), F.count_if("hit").alias("n_near"), F.bool_and("hit").alias("proven"))


@query(""", three AS (SELECT line_id, seq, lon, lat FROM (SELECT *, max(seq) OVER (PARTITION BY line_id) AS n FROM v_line) WHERE n >= 3 AND seq IN (1, (n + 1) // 2, n)),
land AS (SELECT line_id, three.seq FROM three JOIN v_edge e ON (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) WHERE area_id % 2 = 0 GROUP BY line_id, three.seq, area_id HAVING count(*) % 2 = 1)
SELECT line_id, count(*)::BIGINT AS n_land FROM land GROUP BY 1 HAVING count(*) >= 2""", ("v_line", "v_edge"))
def spa24_lines_on_land(spark, sf):
    """Lines with at least two of three samples (first, middle, last vertex) on land."""
    p = V.v_line(spark, sf)
    n = p.groupBy("line_id").agg(F.max("seq").alias("n")).where("n >= 3")
    three = p.join(n, "line_id").where("seq = 1 or seq = n or seq = (n + 1) div 2").withColumn("id", F.struct("line_id", "seq"))
    land = S.containing(three, _edges(spark, sf).where("area_id % 2 = 0"))
    return land.groupBy(F.col("id.line_id").alias("line_id")).agg(F.count("*").alias("n_land")).where("n_land >= 2")


@query("""SELECT area_id, CASE WHEN min(least(x1, x2)) <= -10 OR max(greatest(x1, x2)) >= 50 OR min(least(y1, y2)) <= 20 OR max(greatest(y1, y2)) >= 50 THEN 'beyond' WHEN area_id IN (SELECT a.area_id FROM v_edge a JOIN v_edge b ON a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1 WHERE b.holder = 2) THEN 'enclosed' ELSE 'island' END AS class FROM v_edge GROUP BY 1""", ("v_edge",))
def spa25_outside_land(spark, sf):
    """Areas that touch the frame, that share a border with a holder's land, or neither."""
    e = V.v_edge(spark, sf)
    box = e.groupBy("area_id").agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("n"))
    own = e.where("holder = 2").select(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    border = e.join(own, ["x1", "y1", "x2", "y2"], "left_semi").select("area_id", F.lit(True).alias("_b")).distinct()
    frame = (F.col("w") <= -10) | (F.col("e") >= 50) | (F.col("s") <= 20) | (F.col("n") >= 50)
    return box.join(border, "area_id", "left").select("area_id", F.when(frame, "beyond").when(F.col("_b"), "enclosed").otherwise("island").alias("class"))


@query()
def spa3_simplified_lines(spark, sf):
    """Vertices that line simplification at 3 degrees keeps. No twin: recursive; tests hold it against a plain version."""
    return S.simplify(V.v_line(spark, sf), 3.0).select("line_id", F.col("seq").cast("long").alias("seq"))
