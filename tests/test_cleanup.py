"""Ring cleanup and ring faults against loops."""

import math
import random

from chronogaz.operators import regions, spatial, textjobs


def tidy(ring):
    out = [p for i, p in enumerate(ring) if not i or p != ring[i - 1]]
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


def is_spike(before, p, after, tolerance):
    ix, iy, ox, oy = p[0] - before[0], p[1] - before[1], after[0] - p[0], after[1] - p[1]
    return ix * ox + iy * oy < 0 and abs(ix * oy - iy * ox) / max(math.hypot(ix, iy), math.hypot(ox, oy)) <= tolerance


def plain_rounds(ring, tolerance=regions.SPIKE):
    ring = tidy(ring)
    while True:
        n = len(ring)
        spikes = [n > 3 and is_spike(ring[i - 1], ring[i], ring[(i + 1) % n], tolerance) for i in range(n)]
        go = [i for i in range(n) if spikes[i] and (not spikes[i - 1] or i == 0 and all(spikes))][: max(0, n - 3)]
        if not go:
            return ring
        ring = tidy([p for i, p in enumerate(ring) if i not in go])


def test_rings_lose_repeats_and_spikes(spark):
    rng = random.Random(3)
    rings = {
        1: [(0, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4)],  # a spike up
        2: [(0, 0), (4, 0), (9, 0), (12, 0), (9, 0), (4, 0), (4, 4), (0, 4), (0, 0)],  # a long one with vertices
        3: [(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0)],
        4: [(0, 0), (4, 0), (0, 0)],
        5: [(1, 1)],
        6: [(0, 0), (4, 0), (4, 4), (4.000001, 9), (4.000002, 4), (0, 4)],  # within a metre
        7: [(0, 0), (4, 0), (8, 0), (4, 0)],  # nothing but a spike
        8: [(3, 0), (0, 0), (-5, 0), (0, 0), (0, 3), (3, 3)],  # about the ring's seam
    }
    rings |= {100 + i: [(rng.randrange(4), rng.randrange(3)) for _ in range(rng.randint(1, 14))] for i in range(200)}
    rows = [(r, i, float(x), float(y)) for r, ps in rings.items() for i, (x, y) in enumerate(ps)]
    df = spark.createDataFrame(rows, "ring long, seq long, x double, y double")
    got = {}
    for r in regions.clean_rings(df).orderBy("ring", "seq").collect():
        got.setdefault(r.ring, []).append((r.x, r.y))
    assert got == {r: plain_rounds([(float(x), float(y)) for x, y in ps]) for r, ps in rings.items()}
    assert got[1] == got[2] == got[3] == [(0, 0), (4, 0), (4, 4), (0, 4)] and len(got[4]) == 2 and len(got[6]) == 4 and len(got[8]) == 4
    assert regions.clean_rings(df.limit(0)).count() == 0


def test_small_and_degenerate_parts_are_reported(spark):
    square = lambda ring, size: [(ring, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (size, 0), (size, size), (0, size)])]
    rows = square(1, 2.0) + square(2, 1.0) + square(3, 0.1) + [(4, 0, 0.0, 0.0), (4, 1, 1.0, 1.0)] + [(5, 0, 0.5, 0.5), (5, 1, 0.6, 0.6)] + square(6, 1.0) + square(7, 0.99)
    parts = [(1, 10, False), (2, 10, True), (5, 10, True), (3, 20, False), (4, 30, False), (6, 40, False), (7, 40, True)]
    kept, report = regions.clean_parts(spark.createDataFrame(rows, "ring long, seq long, x double, y double"), spark.createDataFrame(parts, "ring long, part long, hole boolean"), 1000.0)
    got = {r.part: r for r in report.collect()}
    km2 = lambda size: abs(math.radians(size) * math.sin(math.radians(size))) * 6371.0088**2
    trapezoid = lambda size: math.radians(size) * math.sin(math.radians(size)) * 6371.0088**2
    assert abs(got[10].km2 - (trapezoid(2.0) - trapezoid(1.0))) < km2(2.0) * 1e-3 and (got[10].degenerate, got[10].small) == (1, False)
    assert got[20].small and got[30].km2 is None and got[30].degenerate == 1 and got[40].small
    assert {r.ring for r in kept.collect()} == {1, 2}


def test_ring_figures_hold_one_ring_at_a_time(spark):
    nan = float("nan")
    rings = {
        1: [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)],
        2: [(0.0, 0.0), (-0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (0.0, 0.0)],  # two places, one with a zero of either sign
        3: [(1.0, 1.0), (None, 1.0), (1.0, None), (2.0, 2.0)],
        4: [(nan, 1.0), (nan, 1.0), (1.0, 1.0)],
        5: [(nan, 1.0), (None, None), (1.0, 1.0), (1.0, 1.0), (1.0, 2.0)],
        6: [(1.0, 1.0)],
        None: [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)],
    }
    df = spark.createDataFrame([(r, i, *p) for r, ps in rings.items() for i, p in enumerate(ps)], "ring long, seq long, x double, y double").repartition(3)
    figures = regions.ring_km2(df)
    got = {r.ring: r for r in figures.collect()}
    assert {r: (g.n, g.three) for r, g in got.items()} == {r: (len(ps), r in (1, 5, None)) for r, ps in rings.items()}
    assert abs(got[1].km2 - math.radians(2) * math.sin(math.radians(2)) * 6371.0088**2) < 1e-6 and got[6].km2 == 0
    assert "Aggregate" not in figures._jdf.queryExecution().executedPlan().toString()
    _, report = regions.clean_parts(df.where("ring < 3"), spark.createDataFrame([(1, 10, False), (2, 10, True), (7, 20, False)], "ring long, part long, hole boolean"), 1.0)
    assert {(r.part, r.degenerate, r.n_kept) for r in report.collect()} == {(10, 1, 6), (20, 1, 0)}


def test_ring_faults(spark):
    rings = {
        1: [(0, 0), (4, 0), (4, 4), (0, 4)],
        2: [(0, 0), (4, 4), (4, 0), (0, 4)],  # a bow tie
        3: [(0, 0), (8, 0), (8, 4), (4, 0), (0, 4)],  # a corner on an edge
        4: [(0, 0), (8, 0), (8, 4), (6, 4), (6, 0), (2, 0), (2, 4), (0, 4)],  # an edge along another
        5: [(0, 0), (4, 0), (4, 4)],
    }
    rows = [(r, i + 1, *map(float, p), *map(float, ps[(i + 1) % len(ps)])) for r, ps in rings.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "ring long, seq long, x1 double, y1 double, x2 double, y2 double")
    for size in (1.0, 3.0, 50.0):
        got = {(r.ring, r.a_seq, r.b_seq, r.kind) for r in spatial.ring_faults(df, "ring", size).collect()}
        assert got == {(2, 1, 3, "cross"), (3, 1, 3, "touch"), (3, 1, 4, "touch"), (4, 1, 4, "touch"), (4, 1, 5, "overlap"), (4, 1, 6, "touch")}


def test_near_names(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(150)})

    def near(a, b):
        if len(a) == len(b):
            at = [i for i in range(len(a)) if a[i] != b[i]]
            return len(at) <= 1 or len(at) == 2 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    got = {tuple(r) for r in textjobs.near_names(spark.createDataFrame([(n,) for n in [*names, names[0], None]], "name string")).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and near(a, b)} and len(got) > 200


def test_searches_that_open_alike_meet_no_pairs(spark):
    names = [(f"Supplier#{i:09d}",) for i in range(3000)] + [("Évora",), ("su",), (None,), ("",), ("The supper room",)]
    asked = [f"Supppier#{i:09d}" for i in range(3000)] + ["Supplier#000000007", "suppl", "s", "évo", " SU ", "supper r", "supper", "zzz", None, ""]
    queries = spark.createDataFrame([(q,) for q in asked], "q string")
    starts = spark.createDataFrame([(n.lower(),) for (n,) in names if n], "start string")
    folded = sorted({q.lower() for q in asked if q and q == q.strip()})
    met = textjobs._opened(starts, spark.createDataFrame([(q,) for q in folded], "fq string"))
    assert {tuple(r) for r in met.collect()} == {(n.lower(), q) for (n,) in names if n for q in folded if n.lower().startswith(q)}
    # no join keeps pairs that only share their first letters
    assert met._jdf.queryExecution().executedPlan().toString().count("StartsWith") == 0
    got = {(r.q, r.name, r.rank, r.pos) for r in textjobs.search(spark.createDataFrame(names, "name string"), queries, 1).collect()}
    assert {g for g in got if not g[0].startswith("Supppier")} == {
        ("Supplier#000000007", "Supplier#000000007", 0, 1), ("suppl", "Supplier#000000000", 1, 1), ("s", "su", 1, 1), ("évo", "Évora", 1, 1),
        (" SU ", "su", 0, 1), ("supper r", "The supper room", 2, 1), ("supper", "The supper room", 1, 1),
    }
    assert {g for g in got if g[0].startswith("Supppier")} == {(q, q.replace("ppp", "ppl"), 2, 1) for q in asked[:3000]}
