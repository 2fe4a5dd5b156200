import heapq

from chronogaz.plans import registry
from chronogaz.plans import views as V


def test_shortest_paths(spark, sf):
    near = {}
    for r in V.v_graph(spark, sf).collect():
        near.setdefault(r.src, []).append((r.dst, r.weight))
        near.setdefault(r.dst, []).append((r.src, r.weight))
    cost, heap = {}, [(0, 7)]
    while heap:
        c, n = heapq.heappop(heap)
        if n not in cost:
            cost[n] = c
            for m, w in near.get(n, []):
                heapq.heappush(heap, (c + w, m))
    got = {r.node: r for r in registry.QUERIES["grf3_shortest_paths"](spark, sf).collect()}
    assert max(cost.values()) > 60
    assert {n: r.cost for n, r in got.items()} == cost
    for n, r in got.items():
        assert n == 7 and r.prev is None or (r.prev, r.cost - cost[r.prev]) in near[n]
