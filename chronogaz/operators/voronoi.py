"""Lines between the areas nearest to each seed: bisectors cut by half-planes.

A seed's area is bounded by bisectors with the seeds about it and by the box. Each is a line with a parameter, and each
other seed cuts it to one side, so what is left is the least of the upper bounds and the greatest of the lower ones: an
aggregate. Seeds farther off than twice the farthest corner of the area cannot cut it; a seed whose corners reach farther
than half the radius searched waits for the next round with twice the radius.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogaz.operators.graph import checkpointed
from chronogaz.operators.spatial import cell, cell_span

#: The first radius, in mean distances of seeds.
FIRST = 4.0
#: Shortest piece of a line, as a share of the distance of its two seeds (or of the box's side).
LEAST = 1e-9


def bisectors(seeds: DataFrame, box: tuple[float, float, float, float], first: float = FIRST) -> DataFrame:
    """(id, x, y) in a plane and a box (west, south, east, north) -> (a, b, x1, y1, x2, y2), a < b: the piece of the line
    between a and b that parts their areas inside the box. Seeds at one place are one, the least id's; those outside the
    box are left out."""
    w, s, e, n = box
    inside = seeds.where(F.col("x").between(w, e) & F.col("y").between(s, n)).groupBy("x", "y").agg(F.min("id").alias("id"))
    points = checkpointed(inside.select("id", "x", "y"))
    count = points.count()
    radius, far = first * math.sqrt((e - w) * (n - s) / max(1, count)), 2 * math.hypot(e - w, n - s)
    left, out = points, None
    while True:
        sides = checkpointed(_pieces(left, points, box, radius))
        reach = F.greatest(*[F.hypot(F.col(f"x{i}") - F.col("ax"), F.col(f"y{i}") - F.col("ay")) for i in (1, 2)])
        done = sides.groupBy("a").agg(F.max(reach).alias("reach")).where(F.lit(radius >= far) | (F.col("reach") * 2 <= radius)).select("a")
        got = sides.where("b is not null and a < b").join(done, "a", "left_semi").select("a", "b", "x1", "y1", "x2", "y2")
        out = got if out is None else out.unionByName(got)
        left = left.join(done, left["id"] == done["a"], "left_anti")
        if radius >= far or left.isEmpty():
            return out
        left, radius = checkpointed(left), radius * 2


def _pieces(seeds: DataFrame, points: DataFrame, box: tuple[float, float, float, float], radius: float) -> DataFrame:
    """(a, ax, ay, b, x1, y1, x2, y2): sides of each seed's area among the points within the radius; b is null at the box."""
    w, s, e, n = box
    span = lambda c: cell_span(F.col(c) - radius, F.col(c) + radius, radius)
    mine = seeds.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    dealt = mine.withColumn("_cx", span("ax")).withColumn("_cy", span("ay"))
    others = points.select(F.col("id").alias("c"), F.col("x").alias("cx"), F.col("y").alias("cy"), cell(F.col("x"), radius).alias("_cx"), cell(F.col("y"), radius).alias("_cy"))
    near = dealt.join(others, ["_cx", "_cy"]).where("a <> c").where(F.hypot(F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")) <= radius)
    near = checkpointed(near.select("a", "ax", "ay", "c", "cx", "cy"))
    # a line: a point m, a direction d and the range of its parameter inside the box
    line = near.select("a", "ax", "ay", F.col("c").alias("b"), ((F.col("ax") + F.col("cx")) / 2).alias("mx"), ((F.col("ay") + F.col("cy")) / 2).alias("my"), (F.col("ay") - F.col("cy")).alias("dx"), (F.col("cx") - F.col("ax")).alias("dy"))
    none = F.lit(None).cast(points.schema["id"].dataType)
    rim = F.explode(F.array(*[F.struct(F.lit(float(v[0])).alias("mx"), F.lit(float(v[1])).alias("my"), F.lit(float(v[2])).alias("dx"), F.lit(float(v[3])).alias("dy")) for v in ((w, s, e - w, 0), (e, s, 0, n - s), (e, n, w - e, 0), (w, n, 0, s - n))]))
    rims = mine.select("a", "ax", "ay", none.alias("b"), rim.alias("r")).select("a", "ax", "ay", "b", "r.*")
    ts = lambda m, d, lo, hi: (F.when(F.col(d) != 0, F.least((F.lit(lo) - F.col(m)) / F.col(d), (F.lit(hi) - F.col(m)) / F.col(d))), F.when(F.col(d) != 0, F.greatest((F.lit(lo) - F.col(m)) / F.col(d), (F.lit(hi) - F.col(m)) / F.col(d))))
    (x0, x1), (y0, y1) = ts("mx", "dx", w, e), ts("my", "dy", s, n)
    lines = line.unionByName(rims).withColumns({"t0": F.greatest(x0, y0), "t1": F.least(x1, y1), "k": F.struct("b", "mx", "my")})
    cuts = near.select(F.col("a").alias("of"), "c", "cx", "cy")
    met = lines.join(cuts, (F.col("a") == F.col("of")) & (F.col("b").isNull() | (F.col("c") != F.col("b"))), "left")
    ox, oy = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    slope = (F.col("dx") * ox + F.col("dy") * oy) * 2
    room = F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy") - F.col("ax") * F.col("ax") - F.col("ay") * F.col("ay") - (F.col("mx") * ox + F.col("my") * oy) * 2
    one = lambda c: F.first(c).alias(c)
    kept = met.groupBy("a", "k").agg(
        *[one(c) for c in ("ax", "ay", "dx", "dy", "t0", "t1")],
        F.max(F.when(slope < 0, room / slope)).alias("lo"), F.min(F.when(slope > 0, room / slope)).alias("hi"), F.max(F.coalesce((slope == 0) & (room < 0), F.lit(False))).alias("off"),
    )
    kept = kept.withColumns({"t0": F.greatest("t0", "lo"), "t1": F.least("t1", "hi")}).where(~F.col("off") & (F.col("t1") - F.col("t0") > LEAST))
    at = lambda c, t: F.col(f"k.m{c}") + F.col(f"d{c}") * F.col(t)
    return kept.select("a", "ax", "ay", F.col("k.b").alias("b"), at("x", "t0").alias("x1"), at("y", "t0").alias("y1"), at("x", "t1").alias("x2"), at("y", "t1").alias("y2"))
