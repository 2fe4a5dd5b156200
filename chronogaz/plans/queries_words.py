"""Text and checks: highlights, mention dictionary and choice, citations, labels, record rules, run figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogaz.operators import textjobs as J
from chronogaz.plans import views as V
from chronogaz.plans.registry import query


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Partly done' END AS status_label, CASE WHEN o_totalprice >= 250000 THEN 'certain' WHEN o_totalprice >= 100000 THEN 'likely' ELSE 'disputed' END AS confidence_label FROM orders")
def str12_labels(spark, sf):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return V.read(spark, sf, "orders").select("o_orderkey", F.when(status == "F", "Finished").when(status == "O", "Open").otherwise("Partly done").alias("status_label"), F.when(price >= 250000, "certain").when(price >= 100000, "likely").otherwise("disputed").alias("confidence_label"))


@query("""SELECT event_type, count(*)::BIGINT AS n, max(value) AS worst, max(value) FILTER (rn = floor((m - 1) * 0.95e0) + 1) AS p95, count(*) FILTER (value > 50)::BIGINT AS n_long FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1""")
def agg24_frame_summary(spark, sf):
    """Count, p95 by index, worst and number of long frames. Equal values are counted before they are ranked."""
    e = V.read(spark, sf, "events").select("event_type", "value")
    v = e.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    return J.index_quantile(v, "event_type", "value", "n", 0.95, 50)
