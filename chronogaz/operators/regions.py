"""Areas as cells, label points, leftovers, permitted inputs, places at equal distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogaz.functions import geo
from chronogaz.operators import graph as G
from chronogaz.operators import spatial as S
from chronogaz.operators.graph import checkpointed

#: Degrees of a coarse cell, how many each side of a border cell is cut into, and how often.
CELL, SPLIT, LEVELS = 1.0, 5, 4
#: Label points: candidates to a side, zoom levels, pixels of line height, padding and room about pins at zoom 8.
GRID, ZOOMS, LINE_PX, PAD_PX, PIN_PX = 56, (4, 9), 14.0, 4.0, 24.0


def refined_cover(edges: DataFrame, size: float = CELL, split: int = SPLIT, levels: int = LEVELS) -> DataFrame:
    """(area_id, level, cx, cy): cells of each area. Cells that no edge passes are whole; those that one passes are cut
    again, so rows grow with the borders' length in fine cells and not with the areas. The last cut is decided by the
    cells' centres: its cells are size / split ** (levels - 1) degrees wide."""
    box = S.boxes(edges, "area_id")
    cells = box.withColumn("cx", S.cell_span(F.col("w"), F.col("e"), size)).withColumn("cy", S.cell_span(F.col("s"), F.col("n"), size)).select("area_id", "cx", "cy")
    out = None
    for level in range(levels):
        s = size / split**level
        border = S.passed_cells(edges, s).select("area_id", F.col("_cx").alias("cx"), F.col("_cy").alias("cy")).distinct()
        last = level == levels - 1
        whole = cells if last else cells.join(border, ["area_id", "cx", "cy"], "left_anti")
        centres = whole.select(F.struct("area_id", "cx", "cy").alias("id"), ((F.col("cx") + 0.5) * s).alias("lon"), ((F.col("cy") + 0.5) * s).alias("lat"))
        held = S.containing(centres, edges).where(F.col("id.area_id") == F.col("area_id")).select("area_id", F.lit(level).alias("level"), "id.cx", "id.cy")
        out = held if out is None else out.unionByName(held)
        if not last:
            part = lambda c: F.explode(F.sequence(F.col(c) * split, F.col(c) * split + split - 1))
            cells = G.checkpointed(cells.join(border, ["area_id", "cx", "cy"], "left_semi").withColumn("cx", part("cx")).withColumn("cy", part("cy")))
    return out


def cell_km2(level: Column, cy: Column, size: float = CELL, split: int = SPLIT) -> Column:
    """Square kilometres of a cell on the sphere."""
    s = F.lit(size) / F.pow(F.lit(float(split)), level)
    return F.radians(s) * (F.sin(F.radians((cy + 1) * s)) - F.sin(F.radians(cy * s))) * geo.EARTH_KM**2


def overlaps_km2(a: DataFrame, b: DataFrame, split: int = SPLIT, levels: int = LEVELS) -> DataFrame:
    """(area_a, area_b, km2) of two refined covers: a cell meets the cells that hold it or that it holds."""
    out = None
    up = lambda df, m: df.select(*df.columns, F.floor(F.col("cx") / split ** (df_level - m)).alias("kx"), F.floor(F.col("cy") / split ** (df_level - m)).alias("ky"))
    for la in range(levels):
        for lb in range(levels):
            m = min(la, lb)
            df_level = la
            left = up(a.where(F.col("level") == la), m).select(F.col("area_id").alias("area_a"), F.col("cy").alias("ya"), "kx", "ky")
            df_level = lb
            right = up(b.where(F.col("level") == lb), m).select(F.col("area_id").alias("area_b"), F.col("cy").alias("yb"), "kx", "ky")
            fine, y = max(la, lb), "ya" if la >= lb else "yb"
            km2 = left.join(right, ["kx", "ky"]).select("area_a", "area_b", cell_km2(F.lit(float(fine)), F.col(y)).alias("km2"))
            out = km2 if out is None else out.unionByName(km2)
    return out.groupBy("area_a", "area_b").agg(F.sum("km2").alias("km2"))


def equidistant(segs: DataFrame, inside: list[tuple[float, float]], outside: tuple[float, float], cos_phi: float) -> DataFrame:
    """(segs' columns, t, x, y): where segments are as far from the outside anchor as from the nearest inside one.

    Along a segment the difference of squared distances to two anchors is linear, so each pair has one place in closed
    form; it counts if no other inside anchor is nearer there."""

    def gap(x: Column, y: Column, anchor: tuple[float, float]) -> Column:
        d2 = lambda p: F.pow((x - p[0]) * cos_phi, 2) + F.pow(y - p[1], 2)
        return d2(outside) - d2(anchor)

    at = lambda c, t: F.col(f"{c}1") + t * (F.col(f"{c}2") - F.col(f"{c}1"))
    found = []
    for anchor in inside:
        a, b = gap(F.col("x1"), F.col("y1"), anchor), gap(F.col("x2"), F.col("y2"), anchor)
        t = a / F.nullif(a - b, F.lit(0.0))
        nearest = F.greatest(*[gap(at("x", t), at("y", t), o) for o in inside if o != anchor], F.lit(-1e300), F.lit(-1e300)) <= 0
        found.append(F.when(t.between(0, 1) & nearest, t))
    return segs.withColumn("t", F.explode(F.array_compact(F.array(*found)))).withColumns({"x": at("x", F.col("t")), "y": at("y", F.col("t"))})


def leftovers(edges: DataFrame, pieces: DataFrame, explained: DataFrame, step: float, near_km: float, second: float = 0.33) -> DataFrame:
    """Leftover pieces given to the area that their outline runs along: (piece, area_id, status).

    edges: of all areas; pieces: (area_id) of the leftover ones; explained: (id, lon, lat) of listed points. A piece that
    holds such a point, or that borders are shared with through other such pieces, is unlisted; one whose second
    neighbour has more than `second` of the first's samples is ambiguous."""
    own = edges.join(pieces, "area_id", "left_semi")
    built = edges.join(pieces, "area_id", "left_anti")
    samples = S.densify(own, ["area_id", "seq"], step).withColumn("id", F.struct("area_id", "seq", "k"))
    near = S.near_edges(samples, built.select(F.col("area_id").alias("other"), "x1", "y1", "x2", "y2"), near_km).select("id", "other").distinct()
    shares = near.groupBy(F.col("id.area_id").alias("piece"), "other").agg(F.count("*").alias("n"))
    w = Window.partitionBy("piece").orderBy(F.desc("n"), "other")
    best = shares.withColumns({"place": F.row_number().over(w), "second": F.lead("n").over(w)}).where("place = 1")
    joined = S.adjacency(own.select("area_id", "x1", "y1", "x2", "y2")).select(F.col("area_a").alias("src"), F.col("area_b").alias("dst"))
    groups = G.connected_components(joined.unionByName(pieces.select(F.col("area_id").alias("src"), F.col("area_id").alias("dst"))))
    held = S.containing(explained, own.select("area_id", "x1", "y1", "x2", "y2")).select(F.col("area_id").alias("node")).distinct()
    marked = groups.join(held, "node").select("component").distinct().withColumn("marked", F.lit(True))
    rows = pieces.select(F.col("area_id").alias("piece")).join(groups, F.col("node") == F.col("piece")).join(marked, "component", "left").join(best, "piece", "left")
    status = F.when(F.col("marked"), "unlisted").when(F.col("n").isNull(), "island").when(F.col("second") > F.col("n") * second, "ambiguous").otherwise("given")
    return rows.select("piece", F.when(status == "given", F.col("other")).alias("area_id"), status.alias("status"))


def permitted(vertices: DataFrame, line: str, sources: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """(line, kind, worst_km, ok): every vertex of a line of a kind must lie within that kind's tolerance of its declared
    source (an edge table without the line's own edges). worst_km is null where one lies beyond twice the tolerance.

    Vertices at one place are one search, edges that lie alike one edge with two owners at most: a line's distance is that of
    its place's nearest owner or, where that is itself, of the nearest other one."""
    out, xy = None, ("x1", "y1", "x2", "y2")
    for kind, (edges, km) in sources.items():
        own = vertices.where(F.col("kind") == kind)
        of_shape = Window.partitionBy(*xy).orderBy("owner")
        two = edges.select("owner", *xy).distinct().withColumn("_n", F.row_number().over(of_shape)).where("_n <= 2").drop("_n")
        near = S.near_places(own, checkpointed(two), 2 * km).groupBy("lon", "lat", "owner").agg(F.min("km").alias("km"))
        near = near.withColumn("_n", F.row_number().over(Window.partitionBy("lon", "lat").orderBy("km", "owner"))).where("_n <= 2")
        pick = lambda n: F.max(F.when(F.col("_n") == n, F.struct("km", "owner"))).alias(f"m{n}")
        best = checkpointed(near.groupBy("lon", "lat").agg(pick(1), pick(2)))
        rows = own.join(best, ["lon", "lat"], "left").withColumn("km", F.when(F.col("m1.owner").eqNullSafe(F.col(line)), F.col("m2.km")).otherwise(F.col("m1.km")))
        rows = rows.groupBy(line).agg(F.when(F.count("km") == F.count("*"), F.max("km")).alias("worst_km"))
        rows = rows.select(line, F.lit(kind).alias("kind"), "worst_km", F.coalesce(F.col("worst_km") <= km, F.lit(False)).alias("ok"))
        out = rows if out is None else out.unionByName(rows)
    return out


def frontier_gap(frontier: DataFrame, band: DataFrame, outline: DataFrame, handoff: tuple[float, float], step_km: float = 0.2, band_km: float = 5.0, skip_km: float = 1.0, reach_km: float = 50.0) -> DataFrame:
    """(area_a, n_samples, n_skipped, gap_km, lon, lat): the largest gap between a frontier, sampled where it runs within
    band_km of a band line, and an outline; samples within skip_km of the hand-off are left out."""
    s = S.densify(frontier, ["area_a", "seq"], step_km / geo.FLAT_DEG_KM).withColumn("id", F.struct("area_a", "seq", "k"))
    beside = s.join(S.near_edges(s, band, band_km).select("id").distinct(), "id", "left_semi")
    off = geo.plane_km(F.lit(handoff[0]), F.lit(handoff[1]), F.col("lon"), F.col("lat"))
    rows = beside.withColumn("skipped", off <= skip_km)
    gaps = S.nearest_edge(rows.where("not skipped"), outline, reach_km, [])
    rows = rows.join(gaps, "id", "left")
    worst = F.max(F.when(F.col("km").isNotNull(), F.struct("km", "lon", "lat")))
    return rows.groupBy("area_a").agg(F.count("*").alias("n_samples"), F.count_if("skipped").alias("n_skipped"), worst.alias("w")).select("area_a", "n_samples", "n_skipped", F.col("w.km").alias("gap_km"), F.col("w.lon").alias("lon"), F.col("w.lat").alias("lat"))


def pixels(lon: Column, lat: Column, zoom: int = 8) -> tuple[Column, Column]:
    """Pixels of the world map at a zoom."""
    world = 256.0 * 2**zoom
    x, y = geo.mercator(lon, lat)
    turn = 2 * 3.141592653589793 * geo.MERCATOR_M
    return (x / turn + 0.5) * world, (0.5 - y / turn) * world


def label_points(edges: DataFrame, labels: DataFrame, pins: DataFrame, grid: int = GRID) -> DataFrame:
    """(area_id, lon, lat, min_zoom, edge_px, pin_px): the best label point of each area.

    labels: (area_id, width_px, n_lines). Candidates are the centres of a grid over the area's box that lie inside. The
    order: the smallest zoom at which the label's box lies in the area, room about the pins, distance to pins, to the
    edge, then place. Pins: (id, lon, lat); without one in the area its distance is null and counts as the largest."""
    box = S.boxes(edges, "area_id")
    n = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    cells = box.withColumn("i", n).withColumn("j", n)
    cand = cells.select("area_id", F.struct("area_id", "i", "j").alias("id"), (F.col("w") + (F.col("i") + 0.5) / grid * (F.col("e") - F.col("w"))).alias("lon"), (F.col("s") + (F.col("j") + 0.5) / grid * (F.col("n") - F.col("s"))).alias("lat"))
    flat = edges.select("area_id", "x1", "y1", "x2", "y2")
    inside = S.containing(cand, flat).where(F.col("id.area_id") == F.col("area_id")).select("id")
    x, y = pixels(F.col("lon"), F.col("lat"))
    cand = G.checkpointed(cand.join(inside, "id", "left_semi").withColumns({"px": x, "py": y}))
    (x1, y1), (x2, y2) = (pixels(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2))
    drawn = flat.select("area_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    edge = cand.join(drawn, "area_id").groupBy("id").agg(F.min(geo.segment_degrees(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("edge_px"))
    held = S.containing(pins, flat).join(pins, "id")
    hx, hy = pixels(F.col("lon"), F.col("lat"))
    pin = cand.select("id", "area_id", "px", "py").join(held.select("area_id", hx.alias("hx"), hy.alias("hy")), "area_id").groupBy("id").agg(F.min(F.sqrt(F.pow(F.col("px") - F.col("hx"), 2) + F.pow(F.col("py") - F.col("hy"), 2))).alias("pin_px"))
    # the label's box at each zoom, as nine points in pixels of zoom 8
    lo, hi = ZOOMS
    half_w, half_h = F.col("width_px") / 2 + PAD_PX, F.col("n_lines") * LINE_PX / 2 + PAD_PX
    scale = F.pow(F.lit(2.0), 8 - F.col("zoom"))
    spots = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    tried = cand.join(labels, "area_id").withColumn("zoom", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("s", spots)
    tried = tried.select(F.struct("id", "zoom", "s").alias("id"), (F.col("px") + F.col("s.a") * half_w * scale).alias("lon"), (F.col("py") + F.col("s.b") * half_h * scale).alias("lat"))
    fits = S.containing(tried, drawn, 512.0).where(F.col("id.id.area_id") == F.col("area_id")).groupBy("id.id", "id.zoom").agg(F.count("*").alias("n")).where("n = 9").groupBy("id").agg(F.min("zoom").alias("min_zoom"))
    rows = cand.join(edge, "id").join(pin, "id", "left").join(fits, "id", "left").withColumn("min_zoom", F.coalesce("min_zoom", F.lit(hi + 1)))
    far = F.coalesce("pin_px", F.lit(float("inf")))
    w = Window.partitionBy("area_id").orderBy("min_zoom", (far < PIN_PX).cast("int"), far.desc(), F.desc("edge_px"), "lon", "lat")
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").select("area_id", "lon", "lat", "min_zoom", "edge_px", "pin_px")


#: Degrees (about a metre) by which a ring may miss the line that it came in on and still turn back on it.
SPIKE = 0.00001


def clean_rings(vertices: DataFrame, tolerance: float = SPIKE) -> DataFrame:
    """(ring, seq, x, y) of open rings -> the vertices that stay: none that repeats the one before, and no spike, which is a
    vertex where the ring turns back along the line it came in on.

    A round takes a spike out of each run of neighbouring ones, the first, as the others are judged anew without it. Rings
    without spikes leave; three vertices stay at least. Rounds grow with the longest spike's vertices."""
    w, whole = Window.partitionBy("ring").orderBy("seq"), Window.partitionBy("ring")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, out = vertices.select("ring", "seq", "x", "y"), None
    while True:
        same = F.lag("x").over(w).eqNullSafe(F.col("x")) & F.lag("y").over(w).eqNullSafe(F.col("y"))
        d = at.withColumn("same", same).where("not same")
        closes = (F.first("x").over(full) == F.col("x")) & (F.first("y").over(full) == F.col("y")) & F.lead("seq").over(w).isNull() & (F.row_number().over(w) > 1)
        d = d.withColumn("closes", closes).where("not closes")
        around = lambda c, step: F.coalesce((F.lag if step < 0 else F.lead)(c).over(w), (F.last if step < 0 else F.first)(c).over(full))
        d = d.select("ring", "seq", "x", "y", (F.col("x") - around("x", -1)).alias("ix"), (F.col("y") - around("y", -1)).alias("iy"), (around("x", 1) - F.col("x")).alias("ox"), (around("y", 1) - F.col("y")).alias("oy"), F.count("*").over(whole).alias("n"))
        back = F.col("ix") * F.col("ox") + F.col("iy") * F.col("oy") < 0
        off = F.abs(F.col("ix") * F.col("oy") - F.col("iy") * F.col("ox")) / F.greatest(F.hypot("ix", "iy"), F.hypot("ox", "oy"))
        d = d.withColumn("spike", F.coalesce(back & (off <= tolerance) & (F.col("n") > 3), F.lit(False)))
        first = F.col("spike") & (~around("spike", -1) | (F.min("spike").over(whole) & (F.row_number().over(w) == 1)))
        d = d.withColumn("goes", first).withColumn("goes", F.col("goes") & (F.sum(F.col("goes").cast("int")).over(w) <= F.col("n") - 3))
        d = checkpointed(d.select("ring", "seq", "x", "y", "goes", F.max("goes").over(whole).alias("again")))
        done = d.where("not again").select("ring", "seq", "x", "y")
        out = done if out is None else out.unionByName(done)
        at = d.where("again and not goes").select("ring", "seq", "x", "y")
        if at.isEmpty():
            return out


def ring_km2(vertices: DataFrame) -> DataFrame:
    """(ring, seq, x, y in degrees) -> (ring, n, three: whether it has three different places, km2: on the sphere).

    A ring's last row gives its figures, found by windows: a task holds one ring at a time, as groups would hold all of its rings,
    and all of their places."""
    w = Window.partitionBy("ring").orderBy("seq")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(full)) for c in ("x", "y"))
    part = F.radians(nx - F.col("x")) * (2 + F.sin(F.radians("y")) + F.sin(F.radians(ny)))
    place = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y"))
    rows = vertices.select("ring", "seq", place.alias("place"), part.alias("part"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    rows = rows.withColumn("one", F.first("place", True).over(full))
    rows = rows.withColumn("two", F.first(F.when(F.col("place") != F.col("one"), F.col("place")), True).over(full))
    other = F.coalesce((F.col("place") != F.col("one")) & (F.col("place") != F.col("two")), F.lit(False))
    rows = rows.select("ring", "last", F.count("*").over(full).alias("n"), F.max(other).over(full).alias("three"), (F.abs(F.sum("part").over(full)) * (geo.EARTH_KM * geo.EARTH_KM / 2)).alias("km2"))
    return rows.where("last").drop("last")


def clean_parts(vertices: DataFrame, parts: DataFrame, least_km2: float, tolerance: float = SPIKE) -> tuple[DataFrame, DataFrame]:
    """vertices: (ring, seq, x, y); parts: (ring, part, hole) -> the vertices that stay, and a report (part, degenerate rings,
    n_kept: vertices of its rings once cleaned, small: whether the part was under least_km2 and went, km2: its area less its holes;
    null where its outer ring went)."""
    cleaned = checkpointed(clean_rings(vertices, tolerance))
    sizes = parts.join(ring_km2(cleaned), "ring", "left").withColumn("ok", F.coalesce("three", F.lit(False)))
    outer, hole = F.col("ok") & ~F.col("hole"), F.col("ok") & F.col("hole")
    area = F.greatest(F.lit(0.0), F.sum(F.when(outer, F.col("km2"))) - F.sum(F.when(hole, F.col("km2")).otherwise(0.0)))
    report = sizes.groupBy("part").agg(F.count_if(~F.col("ok")).alias("degenerate"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_kept"), F.when(F.max(outer), area).alias("km2"))
    report = checkpointed(report.withColumn("small", F.coalesce(F.col("km2") < least_km2, F.lit(False))))
    stays = report.where("km2 is not null and not small").select("part")
    rings = sizes.where("ok").join(stays, "part").select("ring", "part")
    return cleaned.join(rings, "ring"), report
