"""Lines that meet: intersections, rays, loose ends, gaps, slices, chains and stitches.

Lines are edge tables (line id, seq, x1, y1, x2, y2); each job deals edges to the cells that they pass and joins by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogaz.functions import geo
from chronogaz.operators import spatial as S
from chronogaz.operators.graph import checkpointed, connected_components

#: Kilometres: no gap below, no join above; how far a loose end is carried on; how near a line must be to hold an end.
GAP_MIN_KM, GAP_MAX_KM, EXTEND_KM, LOOSE_KM = 0.2, 4.0, 30.0, 0.1


def line_ends(vertices: DataFrame, line: str) -> DataFrame:
    """(line, side, lon, lat, before_lon, before_lat): both ends of each line with the vertex before."""
    w = Window.partitionBy(line)
    ranked = vertices.withColumns({"a": F.row_number().over(w.orderBy("seq")), "z": F.row_number().over(w.orderBy(F.desc("seq")))})
    pick = lambda n, c: F.max(F.when(F.col(n) == 1, F.col(c))), lambda n, c: F.max(F.when(F.col(n) == 2, F.col(c)))
    one = ranked.groupBy(line).agg(*[f(n, c).alias(f"{n}{i}_{c}") for n in "az" for i, f in enumerate(pick) for c in ("lon", "lat")])
    end = lambda n, side: F.struct(F.lit(side).alias("side"), *[F.col(f"{n}{i}_{c}").alias(("before_" if i else "") + c) for i in (0, 1) for c in ("lon", "lat")])
    return one.select(line, F.explode(F.array(end("a", "start"), end("z", "end"))).alias("e")).select(line, "e.*").where("before_lon is not null")


def shapes(segs: DataFrame, line: str) -> DataFrame:
    """Segments that lie alike, once: (x1 .. y2, held: array of (line, seq)). Work on pairs of places does not grow with the
    lines that repeat them; a row for each line comes back at the end, by explode. An array takes some 16 bytes a line."""
    return segs.groupBy("x1", "y1", "x2", "y2").agg(F.collect_list(F.struct(line, "seq")).alias("held"))


def crossings_of_lines(segs: DataFrame, line: str, size: float) -> DataFrame:
    """Pairs of segments of different lines that cross or touch, once each: (a, a_seq, b, b_seq, x, y), a < b.

    Shapes meet, then the lines that have them. Both orders of two shapes are found, as x and y are reckoned on a."""
    s = checkpointed(shapes(segs, line).withColumn("shape", F.monotonically_increasing_id()))
    edges = s.select("shape", "x1", "y1", "x2", "y2")
    met = checkpointed(crossings(edges, edges, size).select("a_shape", "b_shape", "x", "y"))
    left, right = (s.select(F.col("shape").alias(f"{n}_shape"), F.col("held").alias(f"{n}_held")) for n in "ab")
    both = met.join(left, "a_shape").join(right, "b_shape").select("x", "y", F.explode("a_held").alias("a"), "b_held")
    both = both.select("x", "y", F.col(f"a.{line}").alias("a"), F.col("a.seq").alias("a_seq"), F.explode("b_held").alias("b"))
    return both.where(F.col("a") < F.col(f"b.{line}")).select("a", "a_seq", F.col(f"b.{line}").alias("b"), F.col("b.seq").alias("b_seq"), "x", "y")


def crossings(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Edges of a (a_line, a_seq, ax1 .. ay2) and b (b_...) that cross or touch, once each, with the point x, y and t on a."""
    left = S.passed_cells(a, size).select("_cx", "_cy", *[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = S.passed_cells(b, size).select("_cx", "_cy", *[F.col(c).alias(f"b_{c}") for c in b.columns])
    t, u = crossing_parameters("a_", "b_")
    met = left.join(right, ["_cx", "_cy"]).drop("_cx", "_cy").withColumns({"t": t, "u": u}).where("t between 0 and 1 and u between 0 and 1")
    met = met.dropDuplicates([c for c in met.columns if c not in ("t", "u")])
    at = lambda c: F.col(f"a_{c}1") + F.col("t") * (F.col(f"a_{c}2") - F.col(f"a_{c}1"))
    return met.withColumns({"x": at("x"), "y": at("y")})


def crossing_parameters(a: str, b: str) -> tuple[Column, Column]:
    """Where the segments with these column prefixes cross: t on the first and u on the second; null if parallel."""
    c = lambda p, n: F.col(p + n)
    rx, ry, sx, sy = c(a, "x2") - c(a, "x1"), c(a, "y2") - c(a, "y1"), c(b, "x2") - c(b, "x1"), c(b, "y2") - c(b, "y1")
    qx, qy, den = c(b, "x1") - c(a, "x1"), c(b, "y1") - c(a, "y1"), F.nullif(rx * sy - ry * sx, F.lit(0.0))
    return (qx * sy - qy * sx) / den, (qx * ry - qy * rx) / den


def ray_hits(ends: DataFrame, segs: DataFrame, line: str, reach_km: float = EXTEND_KM) -> DataFrame:
    """The nearest segment of another line that each end's last direction, carried on, meets within reach:
    (line, side, target, target_seq, km, hit_lon, hit_lat). The plane is about the end.

    Ends that lie and look alike are one ray, segments that lie alike one shape with its least line and the least of the
    others: a line's answer is its ray's nearest target or, where that is itself, the nearest of another line."""
    ray = ["lon", "lat", "before_lon", "before_lat"]
    k = F.cos(F.radians("lat")) * geo.DEG_LON_KM
    dx, dy = (F.col("lon") - F.col("before_lon")) * k, (F.col("lat") - F.col("before_lat")) * geo.DEG_LAT_KM
    rays = ends.select(*ray).distinct().withColumns({"dx": dx, "dy": dy}).withColumn("n", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).where("n > 0")
    reach = reach_km * 1.01
    rays = rays.withColumns({"x1": F.col("lon"), "y1": F.col("lat"), "x2": F.col("lon") + F.col("dx") / F.col("n") * reach / k, "y2": F.col("lat") + F.col("dy") / F.col("n") * reach / geo.DEG_LAT_KM})
    a = S.passed_cells(rays, 0.25)
    own = segs.groupBy("x1", "y1", "x2", "y2", line).agg(F.min("seq").alias("seq"))
    least = Window.partitionBy("x1", "y1", "x2", "y2").orderBy(line)
    two = checkpointed(own.withColumn("_n", F.row_number().over(least)).where("_n <= 2").groupBy("x1", "y1", "x2", "y2").agg(F.array_sort(F.collect_list(F.struct(F.col(line).alias("target"), F.col("seq").alias("target_seq")))).alias("held")))
    b = S.passed_cells(two, 0.25).select("_cx", "_cy", "held", *[F.col(c).alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")])
    both = a.join(b, ["_cx", "_cy"])
    px, py = (F.col("sx1") - F.col("lon")) * k, (F.col("sy1") - F.col("lat")) * geo.DEG_LAT_KM
    ex, ey = (F.col("sx2") - F.col("sx1")) * k, (F.col("sy2") - F.col("sy1")) * geo.DEG_LAT_KM
    rx, ry = F.col("dx") / F.col("n"), F.col("dy") / F.col("n")
    cross = rx * ey - ry * ex
    hit = both.withColumn("cross", cross).where("abs(cross) >= 1e-9").withColumns({"km": (px * ey - py * ex) / F.col("cross"), "u": (px * ry - py * rx) / F.col("cross")})
    hit = hit.where((F.col("km") > 0) & (F.col("km") <= reach_km) & F.col("u").between(0, 1))
    at = lambda c: F.col(f"s{c}1") + F.col("u") * (F.col(f"s{c}2") - F.col(f"s{c}1"))
    hit = hit.select(*ray, "km", at("x").alias("hit_lon"), at("y").alias("hit_lat"), F.explode("held").alias("h"))
    # of each target its nearest segment, then the two nearest targets
    best = hit.groupBy(*ray, "h.target").agg(F.min(F.struct("km", "h.target", "h.target_seq", "hit_lon", "hit_lat")).alias("m"))
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy(*ray).orderBy("m"))).where("_n <= 2")
    pick = lambda n: F.max(F.when(F.col("_n") == n, F.col("m"))).alias(f"m{n}")
    best = checkpointed(best.groupBy(*ray).agg(pick(1), pick(2)))
    m = F.when(F.col("m1.target") != F.col(line), F.col("m1")).otherwise(F.col("m2"))
    return ends.select(line, "side", *ray).join(best, ray).select(line, "side", m.alias("m")).where("m is not null").select(line, "side", "m.*")


def loose_ends(ends: DataFrame, segs: DataFrame, line: str, near_km: float = LOOSE_KM) -> DataFrame:
    """Ends without another line within near_km."""
    held = segs.groupBy("x1", "y1", "x2", "y2").agg(F.min(line).alias("_least"), F.max(line).alias("_most"))
    near = S.near_edges(ends.select("lon", "lat").distinct().withColumn("id", F.struct("lon", "lat")), checkpointed(held), near_km)
    # a place is held by the lines from the least to the largest one near it: an end there is loose if they are none but its own
    near = checkpointed(near.groupBy("lon", "lat").agg(F.min("_least").alias("_least"), F.max("_most").alias("_most")))
    rows = ends.join(near, ["lon", "lat"], "left").where((F.coalesce("_least", line) == F.col(line)) & (F.coalesce("_most", line) == F.col(line)))
    return rows.select(*ends.columns)


def _off_others(ends: DataFrame, segs: DataFrame, line: str) -> DataFrame:
    """Ends that are no vertex of another line, found by equal coordinates: where many lines meet in a place there is no gap, and
    its ends need not be held against each other."""
    vertex = segs.select(line, F.explode(F.array(*[F.struct(F.col(f"x{i}").alias("lon"), F.col(f"y{i}").alias("lat")) for i in (1, 2)])).alias("v"))
    held = vertex.groupBy("v.lon", "v.lat").agg(F.min(line).alias("_a"), F.max(line).alias("_z"))
    rows = ends.join(held, ["lon", "lat"], "left").where((F.coalesce("_a", line) == F.col(line)) & (F.coalesce("_z", line) == F.col(line)))
    return checkpointed(rows.select(*ends.columns))


def gap_candidates(ends: DataFrame, segs: DataFrame, line: str, lo: float = GAP_MIN_KM, hi: float = GAP_MAX_KM) -> DataFrame:
    """For each end the way to the nearest other line, lo to hi kilometres off; to that line's end where its foot is
    within lo of it: (line, side, source, target, to_end, km, to_lon, to_lat). Ends are named by six decimals."""
    points = _off_others(ends, segs, line) if lo > 1e-6 else ends
    points = points.withColumn("id", F.struct(line, "side"))
    near = S.near_edges(points, segs.withColumnRenamed(line, "other"), hi * 1.05).where(F.col(f"id.{line}") != F.col("other"))
    t = geo.segment_t(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    near = near.withColumn("t", t).withColumns({"fx": F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")), "fy": F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))})
    km = lambda a, b, c, d: geo.haversine_km(F.col(a), F.col(b), F.col(c), F.col(d))
    near = near.withColumn("foot_km", km("lon", "lat", "fx", "fy"))
    best = near.groupBy("id", "lon", "lat").agg(F.min(F.struct("foot_km", "other", "seq", "fx", "fy")).alias("m")).select("id", "lon", "lat", "m.*").where((F.col("foot_km") > lo) & (F.col("foot_km") <= hi))
    own = ends.select(F.col(line).alias("other"), F.col("side").alias("end_side"), F.col("lon").alias("ex"), F.col("lat").alias("ey"))
    named = best.join(own, "other").withColumn("end_km", km("fx", "fy", "ex", "ey"))
    picked = named.groupBy("id", "lon", "lat", "foot_km", "fx", "fy").agg(F.min(F.struct("end_km", F.when(F.col("end_side") == "start", 0).otherwise(1).alias("n"), "ex", "ey")).alias("e"))
    to_end = F.col("e.end_km") <= lo
    out = picked.select(F.col(f"id.{line}").alias(line), F.col("id.side").alias("side"), "lon", "lat", to_end.alias("to_end"), F.when(to_end, F.col("e.ex")).otherwise(F.col("fx")).alias("to_lon"), F.when(to_end, F.col("e.ey")).otherwise(F.col("fy")).alias("to_lat"))
    out = out.withColumn("km", km("lon", "lat", "to_lon", "to_lat")).where((F.col("km") > lo) & (F.col("km") <= hi))
    return out.select(line, "side", _node("lon", "lat").alias("source"), _node("to_lon", "to_lat").alias("target"), "to_end", "km", "to_lon", "to_lat")


def _node(x: str, y: str) -> Column:
    six = lambda c: F.format_string("%d", F.floor(F.col(c) * 1e6 + 0.5).cast("long"))
    return F.concat(six(x), F.lit(","), six(y))


def accepted_joins(candidates: DataFrame) -> DataFrame:
    """Of candidates in order (to an end first, source, distance, target) each whose ends no accepted one holds.

    Rounds: a row is taken if it is the first of all rows left at each of its ends; rows at a taken end go. That is the
    choice in order, as a row is decided as soon as no earlier row shares an end with it."""
    order = F.struct((~F.col("to_end")).alias("o"), "source", "km", "target", "_n")
    left = checkpointed(candidates.withColumn("_n", F.xxhash64(*candidates.columns)).withColumn("rank", order))
    taken = None
    while not left.isEmpty():
        keys = left.select("rank", F.explode(F.when(F.col("to_end"), F.array("source", "target")).otherwise(F.array("source"))).alias("key"))
        first = keys.groupBy("key").agg(F.min("rank").alias("first"))
        lost = keys.join(first, "key").where("rank <> first").select("rank").distinct()
        now = checkpointed(left.join(lost, "rank", "left_anti"))
        taken = now if taken is None else checkpointed(taken.unionByName(now))
        held = now.select(F.explode(F.when(F.col("to_end"), F.array("source", "target")).otherwise(F.array("source"))).alias("key")).distinct()
        gone = keys.join(held, "key", "left_semi").select("rank").distinct()
        left = checkpointed(left.join(gone, "rank", "left_anti"))
    return (left if taken is None else taken).drop("rank", "_n")


def sliced(vertices: DataFrame, line: str, start: DataFrame, end: DataFrame) -> DataFrame:
    """The part of each line between the feet of two points (line, lon, lat), in the direction from start to end:
    (line, pos, lon, lat). The foot is the nearest place by plain degrees, of equal ones the first."""
    w = Window.partitionBy(line).orderBy("seq")
    segs = S.segments(vertices, line)

    def foot(points: DataFrame, name: str) -> DataFrame:
        both = segs.join(points.select(line, F.col("lon").alias("px"), F.col("lat").alias("py")), line)
        t = geo.segment_t(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
        both = both.withColumn("t", t).withColumns({"fx": F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")), "fy": F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))})
        d2 = F.pow(F.col("fx") - F.col("px"), 2) + F.pow(F.col("fy") - F.col("py"), 2)
        best = both.groupBy(line).agg(F.min(F.struct(d2.alias("d2"), "seq", "t", "fx", "fy")).alias("m"))
        return best.select(line, (F.col("m.seq") + F.col("m.t")).alias(f"{name}_at"), F.col("m.fx").alias(f"{name}_x"), F.col("m.fy").alias(f"{name}_y"))

    feet = foot(start, "a").join(foot(end, "z"), line)
    lo, hi = F.least("a_at", "z_at"), F.greatest("a_at", "z_at")
    inner = vertices.select(line, "seq", "lon", "lat").join(feet, line).where((F.col("seq") > lo) & (F.col("seq") < hi)).select(line, F.col("seq").cast("double").alias("at"), "lon", "lat", (F.col("a_at") > F.col("z_at")).alias("back"))
    tips = feet.select(line, F.explode(F.array(*[F.struct(F.col(f"{n}_at").alias("at"), F.col(f"{n}_x").alias("lon"), F.col(f"{n}_y").alias("lat")) for n in "az"])).alias("f"), (F.col("a_at") > F.col("z_at")).alias("back")).select(line, "f.*", "back")
    rows = inner.unionByName(tips).distinct()
    order = F.when(F.col("back"), -F.col("at")).otherwise(F.col("at"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(line).orderBy(order, "lon", "lat"))).select(line, "pos", "lon", "lat")


def chains(ways: DataFrame, least: int = 10) -> DataFrame:
    """(way_id, start, end, n_vertices) -> (chain, pos, way_id, reversed, vertices): ways joined at nodes where exactly
    two way ends meet, in order from the chain's smaller end node; chains of under `least` vertices go.

    Each way can be walked in two directions; the walk that follows is known by the node it leads to, and pointer
    doubling ranks all walks in rounds that grow with the log of a chain's length. A ring is opened at its smallest way."""
    ends = ways.select("way_id", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("start").alias("node")), F.struct(F.lit(1).alias("at"), F.col("end").alias("node")))).alias("e")).select("way_id", "e.at", "e.node")
    two = ends.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("way_id", "at")).alias("a"), F.max(F.struct("way_id", "at")).alias("b")).where("n = 2 and a <> b")
    meets = two.select("node", F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("m")).select(F.col("m.own.way_id").alias("way_id"), F.col("m.own.at").alias("at"), F.col("m.other.way_id").alias("other"), F.col("m.other.at").alias("other_at"))
    meets = checkpointed(meets.where("way_id <> other"))
    parts = connected_components(meets.select(F.col("way_id").alias("src"), F.col("other").alias("dst"))).select(F.col("node").alias("way_id"), F.col("component").alias("part"))
    parts = checkpointed(ways.select("way_id").join(parts, "way_id", "left").select("way_id", F.coalesce("part", "way_id").alias("part")))
    # a ring has as many meetings as way ends: its smallest way's start is opened
    rings = parts.join(meets.groupBy("way_id").agg(F.count("*").alias("n")), "way_id", "left").groupBy("part").agg(F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n = 2").select(F.col("part").alias("way_id"))
    opened = rings.withColumn("at", F.lit(0))
    cut = meets.join(opened, ["way_id", "at"], "left_anti").join(opened.select(F.col("way_id").alias("other"), F.col("at").alias("other_at")), ["other", "other_at"], "left_anti")
    # a walk (way, reversed) leaves at end 1, or at 0 if reversed; the next is walked from the end where they meet
    walk = lambda way, back: F.concat_ws(":", F.col(way).cast("string"), back.cast("string"))
    nxt = cut.select(walk("way_id", 1 - F.col("at")).alias("walk"), walk("other", F.col("other_at")).alias("to"))
    every = ways.select("way_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("back")).withColumn("walk", walk("way_id", F.col("back")))
    state = checkpointed(every.join(nxt, "walk", "left").select("walk", "way_id", "back", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("left"), F.coalesce("to", "walk").alias("last")))
    while not state.where("to is not null").isEmpty():
        hop = state.select(F.col("walk").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"), F.col("last").alias("_last"))
        state = checkpointed(state.join(hop, "to", "left").select("walk", "way_id", "back", F.col("_to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"), F.coalesce("_last", "last").alias("last")))
    # both directions of a chain are ranked; the one that starts at the smaller free node stays
    tips = every.select(F.col("walk").alias("last"), "way_id", "back").join(ways, "way_id").select("last", F.when(F.col("back") == 0, F.col("end")).otherwise(F.col("start")).alias("last_node"))
    ranked = state.join(tips, "last").join(parts, "way_id")
    keep = ranked.groupBy("part").agg(F.max(F.struct("last_node", "last")).alias("m")).select("part", F.col("m.last").alias("last"))
    chosen = ranked.join(keep, ["part", "last"])
    one = Window.partitionBy("part")
    out = chosen.join(ways.select("way_id", "n_vertices"), "way_id").withColumns({"pos": F.max("left").over(one) - F.col("left") + 1, "vertices": F.sum("n_vertices").over(one) - F.count("*").over(one) + 1})
    return out.where(F.col("vertices") >= least).select(F.col("part").alias("chain"), "pos", "way_id", (F.col("back") == 1).alias("reversed"), "vertices")


def stitched(vertices: DataFrame, anchors: DataFrame, name: str, line: str, limit: float = 0.2) -> DataFrame:
    """Pieces of one name put together from an anchor (name, lon, lat) on: (name, pos, line, reversed).

    The first piece is the one with the vertex nearest the anchor, turned so that it starts there; then, as long as one
    is within `limit` (squared degrees) of an end of what there is, the piece with the nearest end joins at that end.
    Each step needs the one before, so a name's pieces, which are few, go to one group."""
    import pandas as pd

    rows = vertices.groupBy(name, line).agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("v"))
    rows = rows.join(anchors.select(name, F.col("lon").alias("ax"), F.col("lat").alias("ay")), name)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = {r[line]: [(p["lon"], p["lat"]) for p in r["v"]] for r in pdf.to_dict("records")}
        anchor = (pdf["ax"].iloc[0], pdf["ay"].iloc[0])
        d2 = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
        first = min(sorted(pieces), key=lambda k: min(d2(p, anchor) for p in pieces[k]))
        back = d2(pieces[first][0], anchor) > d2(pieces[first][-1], anchor)
        chain, left = [(first, back)], set(pieces) - {first}
        ends = [pieces[first][-1 if back else 0], pieces[first][0 if back else -1]]
        while left:
            ways = [(d2(ends[e], pieces[k][-z]), k, e, z) for k in sorted(left) for e in (0, 1) for z in (0, 1)]
            far, k, e, z = min(ways)
            if far > limit:
                break
            # joined at the chain's end e by its own end z; what is now outside is the other end
            chain.insert(0 if e == 0 else len(chain), (k, z == 0 if e == 0 else z == 1))
            ends[e] = pieces[k][-1 if z == 0 else 0]
            left.discard(k)
        return pd.DataFrame({name: [pdf[name].iloc[0]] * len(chain), "pos": range(1, len(chain) + 1), line: [k for k, _ in chain], "reversed": [b for _, b in chain]})

    kind = {f.name: f.dataType.simpleString() for f in vertices.schema.fields}
    return rows.groupBy(name).applyInPandas(one, f"{name} {kind[name]}, pos long, {line} {kind[line]}, reversed boolean")


def passed_in_order(vertices: DataFrame, via: DataFrame, line: str, first: int, second: int, near_m: float = 1.0) -> DataFrame:
    """(line, first_at, second_at, passed): the first vertex within near_m of a line's first place and, there or later, of
    its second; via: (line, place, vx, vy)."""
    p = vertices.select(line, "seq", "lon", "lat")
    hit = via.join(p, line).where(geo.haversine_km(F.col("lon"), F.col("lat"), F.col("vx"), F.col("vy")) * 1000 <= near_m).select(line, "place", "seq")
    a = hit.where(F.col("place") == first).groupBy(line).agg(F.min("seq").alias("first_at"))
    both = via.groupBy(line).agg(F.count_if(F.col("place") == first).alias("na"), F.count_if(F.col("place") == second).alias("nb")).where("na > 0 and nb > 0").select(line).join(a, line, "left")
    b = hit.where(F.col("place") == second).join(both, line).where(F.col("seq") >= F.coalesce("first_at", F.lit(1))).groupBy(line).agg(F.min("seq").alias("second_at"))
    rows = both.join(b, line, "left")
    at = lambda c: F.col(c).cast("long").alias(c)
    return rows.select(line, at("first_at"), at("second_at"), (F.col("first_at").isNotNull() & F.col("second_at").isNotNull()).alias("passed"))
