"""Choices, paths and histories against loops."""

import heapq
import random

from pyspark.sql import functions as F

from chronogaz.operators import graph, temporal
from chronogaz.plans import registry
from chronogaz.plans import views as V


def test_traced_paths_are_least_cost(spark, sf):
    near = {}
    for r in V.v_graph_ids(spark, sf).collect():
        for a, b in ((r.src, r.dst), (r.dst, r.src)):
            near.setdefault(a, []).append((b, r.weight, r.id))
    cost, heap = {}, [(0, 7)]
    while heap:
        c, n = heapq.heappop(heap)
        if n not in cost:
            cost[n] = c
            for m, w, _ in near.get(n, []):
                heapq.heappush(heap, (c + w, m))
    rows = {}
    for r in registry.QUERIES["grf3_traced_paths"](spark, sf).collect():
        rows.setdefault(r.target, []).append(r)
    ends = {r.dst for r in V.v_graph(spark, sf).collect() if r.dst % 50 == 0}
    assert set(rows) == {t for t in ends if t in cost} and rows
    for target, path in rows.items():
        path.sort(key=lambda r: r.back)
        assert path[0].node == target and path[0].cost == cost[target] and path[-1].node == 7 and path[-1].edge is None
        for a, b in zip(path, path[1:]):
            assert (b.node, a.cost - b.cost, a.edge) in near[a.node]


def plain_merge(rows):
    out = []
    for f, t, h, s in sorted(rows):
        if out and out[-1][1] == f and out[-1][2] == h:
            out[-1] = (out[-1][0], t, h, out[-1][3] | s)
        else:
            out.append((f, t, h, s))
    return out


def test_history_equals_the_loop(spark):
    rng = random.Random(6)
    base, over, want = [], [], []
    for key in range(25):
        at, rows, laid = 0, [], []
        for i in range(rng.randrange(1, 7)):
            at += rng.choice([0, 0, 0, 3])
            rows.append((at, at + rng.randrange(1, 9), rng.choice("ab"), frozenset({f"o{i}"})))
            at = rows[-1][1]
        start = -4
        for i in range(rng.randrange(0, 5)):
            start += rng.randrange(0, 7)
            laid.append((start, start + rng.randrange(1, 10), rng.choice("abX"), frozenset({f"x{i}"})))
            start = laid[-1][1]
        base += [(key, *r[:3], sorted(r[3])) for r in rows]
        over += [(key, i, *r[:3], sorted(r[3])) for i, r in enumerate(laid)]
        now = plain_merge(rows)
        for f, t, h, s in laid:
            cut = []
            for a, b, g, q in now:
                if f < b and a < t:
                    cut += [p for p in ((a, max(a, f), g, q), (max(a, f), min(b, t), h, s), (min(b, t), b, g, q)) if p[0] < p[1]]
                else:
                    cut.append((a, b, g, q))
            now = plain_merge(cut)
        want += [(key, f, t, h, tuple(sorted(s))) for f, t, h, s in now]
    kind = "`from` long, `to` long, holder string, sources array<string>"
    got = temporal.history(spark.createDataFrame(base, f"k int, {kind}"), spark.createDataFrame(over, f"k int, id int, {kind}"), "k")
    assert sorted((r.k, r["from"], r["to"], r.holder, tuple(r.sources)) for r in got.collect()) == sorted(want)


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(5)
    assert [(r.k, r.pos) for r in graph.positions(df, "k").orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]
