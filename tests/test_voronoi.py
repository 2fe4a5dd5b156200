"""Bisectors against a plain clipping by every other seed."""

import math
import random

import pytest

from chronogaz.operators import voronoi

BOX = (0.0, 0.0, 100.0, 60.0)


def plain(seeds):
    """{(a, b): (t0, t1, m, d)} of the pieces that part two seeds' areas."""
    at, out = {}, {}
    for i, x, y in sorted(seeds):
        if BOX[0] <= x <= BOX[2] and BOX[1] <= y <= BOX[3] and (x, y) not in at.values():
            at[i] = x, y
    for a, (ax, ay) in at.items():
        for b, (bx, by) in at.items():
            if a >= b:
                continue
            m, d = ((ax + bx) / 2, (ay + by) / 2), (ay - by, bx - ax)
            lo, hi = -math.inf, math.inf
            limits = [(d[0], BOX[2] - m[0]), (-d[0], m[0] - BOX[0]), (d[1], BOX[3] - m[1]), (-d[1], m[1] - BOX[1])]
            limits += [(2 * (d[0] * (cx - ax) + d[1] * (cy - ay)), cx * cx + cy * cy - ax * ax - ay * ay - 2 * (m[0] * (cx - ax) + m[1] * (cy - ay))) for c, (cx, cy) in at.items() if c not in (a, b)]
            for k, room in limits:
                if k > 0:
                    hi = min(hi, room / k)
                elif k < 0:
                    lo = max(lo, room / k)
                elif room < 0:
                    hi = -math.inf
            if hi - lo > 1e-9:
                out[a, b] = [(m[0] + d[0] * t, m[1] + d[1] * t) for t in (lo, hi)]
    return at, out


@pytest.mark.parametrize("first", [4.0, 0.7])
def test_bisectors(spark, first):
    rng = random.Random(8)
    seeds = [(i, rng.uniform(0, 100), rng.uniform(0, 60)) for i in range(40)] + [(100 + i, rng.gauss(10, 1), rng.gauss(10, 1)) for i in range(20)]
    seeds += [(200, 50.0, 30.0), (201, 50.0, 30.0), (202, 300.0, 1.0), (203, 60.0, 30.0)]
    at, want = plain(seeds)
    rows = voronoi.bisectors(spark.createDataFrame(seeds, "id long, x double, y double"), BOX, first).collect()
    assert {(r.a, r.b) for r in rows} == set(want) and len(rows) == len(want) > 100
    corners = []
    for r in rows:
        assert (r.x1, r.y1) == pytest.approx(want[r.a, r.b][0], abs=1e-6) and (r.x2, r.y2) == pytest.approx(want[r.a, r.b][1], abs=1e-6)
        for t in (0.0, 0.3, 1.0):  # two seeds are nearest, and equally near
            p = r.x1 + (r.x2 - r.x1) * t, r.y1 + (r.y2 - r.y1) * t
            near = sorted(math.dist(p, q) for q in at.values())
            assert math.dist(p, at[r.a]) == pytest.approx(near[0], abs=1e-6) and math.dist(p, at[r.b]) == pytest.approx(near[0], abs=1e-6)
        corners += [(r.x1, r.y1), (r.x2, r.y2)]
    rim = lambda p: min(p[0], p[1], 100 - p[0], 60 - p[1]) < 1e-6
    for p in corners:  # pieces meet at common points, three at least, or end at the box
        assert rim(p) or sum(math.dist(p, q) < 1e-6 for q in corners) >= 3


def test_few_seeds(spark):
    one = lambda rows: voronoi.bisectors(spark.createDataFrame(rows, "id long, x double, y double"), BOX).collect()
    assert one([]) == [] and one([(1, 5.0, 5.0)]) == []
    assert [(r.a, r.b, r.x1, r.x2) for r in one([(1, 40.0, 30.0), (2, 60.0, 30.0)])] == [(1, 2, 50.0, 50.0)]
