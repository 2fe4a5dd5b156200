"""Ways over a grid against a plain Dijkstra over all states."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from chronogaz.operators import gridpath as P

MOVES = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]


def dijkstra(cells, sources, targets):
    """cells: {(x, y): five costs}; sources: {(x, y): cost}; targets: a set of cells for each layer."""

    def layer_at(cell, k):
        while k < len(targets) and cell in targets[k]:
            k += 1
        return k

    best, heap = {}, [(c, xy, layer_at(xy, 0)) for xy, c in sources.items() if xy in cells]
    heapq.heapify(heap)
    while heap:
        cost, (x, y), k = heapq.heappop(heap)
        if (x, y, k) in best:
            continue
        best[x, y, k] = cost
        for dx, dy in MOVES:
            to = x + dx, y + dy
            if to in cells and (not dx or not dy or ((x + dx, y) in cells and (x, y + dy) in cells)):
                heapq.heappush(heap, (cost + step(cells, (x, y), to), to, layer_at(to, k)))
    return best


def step(cells, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    return cells[b][0] if not dy else cells[b][(1 if dy > 0 else 2) + (2 if dx else 0)]


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(5)
    free = [(x, y) for x in range(-9, 21) for y in range(-4, 18) if rng.random() < 0.75]
    blocked = [(x, y) for x in range(-10, 22) for y in range(-5, 19) if (x, y) not in set(free)]
    xy = "x long, y long"
    clear = P.clearance(spark.createDataFrame(free, xy), spark.createDataFrame(blocked, xy), 3)
    rows = P.stepped(clear, 100 + F.col("y"), 100.5 + F.col("y"), 99.5 + F.col("y"), F.sqrt("d2") * 100, 250.0, 4.0)
    return free, blocked, clear, rows


def test_clearance_and_penalty(grid):
    free, blocked, clear, rows = grid
    want = {}
    for x, y in free:
        d2 = min((x - a) ** 2 + (y - b) ** 2 for a, b in blocked)
        want[x, y] = d2 if d2 <= 9 else None
    assert {(r.x, r.y): r.d2 for r in clear.collect()} == want
    for r in rows.collect():
        raised = 1 + 4 * max(0.0, 250 - (math.sqrt(want[r.x, r.y]) * 100 if want[r.x, r.y] is not None else 250)) / 250
        assert r.level == pytest.approx((100 + r.y) * raised) and r.diagonal_down == pytest.approx((99.5 + r.y) * raised * math.sqrt(2))


@pytest.mark.parametrize("tile", [9, 64])
def test_ways_through_ordered_targets(spark, grid, tile):
    _, _, _, rows = grid
    cells = {(r.x, r.y): tuple(r[c] for c in P.STEPS) for r in rows.collect()}
    some = sorted(cells)
    rng = random.Random(tile)
    near = lambda c, r: {xy for xy in some if math.dist(xy, c) <= r}
    searches = {
        1: ({some[0]: 0.0}, []),
        2: ({some[3]: 5.0, some[40]: 0.0, (99, 99): 0.0}, [near((15, 10), 3)]),
        3: ({some[100]: 0.0}, [near((18, 15), 2), near((-5, 2), 2), near((18, 0), 1)]),
        4: ({some[200]: 7.0}, [{some[200]}, near(some[200], 2), set()]),  # begins on its first targets; the last is never met
        5: ({(50, 50): 0.0}, []),  # begins on no cell
    }
    sources = [(s, x, y, c) for s, (src, _) in searches.items() for (x, y), c in src.items()]
    targets = [(s, k, x, y) for s, (_, ts) in searches.items() for k, t in enumerate(ts) for x, y in t]
    got = P.least_costs(rows, spark.createDataFrame(sources, "search long, x long, y long, cost double"), spark.createDataFrame(targets, "search long, layer int, x long, y long"), tile)
    by = {}
    for r in got.collect():
        by.setdefault(r.search, {})[r.x, r.y, r.layer] = r
    assert 5 not in by
    goals = []
    for s, (src, ts) in searches.items():
        want = dijkstra(cells, src, ts)
        mine = by.get(s, {})
        assert set(mine) == set(want)
        for state, cost in want.items():
            r = mine[state]
            assert r.cost == pytest.approx(cost)
            if r.px is not None:  # the state before it leads here at that cost
                assert mine[r.px, r.py, r.pl].cost + step(cells, (r.px, r.py), state[:2]) == pytest.approx(r.cost)
        goals += [(s, g, *rng.choice(some), len(ts), float(g)) for g in range(4)]
    goals += [(s, 0, *rng.choice(some), len(ts), 50.0) for s, (_, ts) in searches.items()]  # a second cell for a goal
    reached = P.ends(got, spark.createDataFrame(goals, "search long, goal long, x long, y long, layer long, cost double"))
    ways = {}
    for r in P.traced(got, reached, tile).collect():
        ways.setdefault((r.search, r.goal), {})[r.back] = (r.x, r.y, r.layer)
    ends = {(r.search, r.goal): r for r in reached.collect()}
    assert set(ways) == set(ends) and len(ends) > 8
    for (s, g), r in ends.items():
        want = dijkstra(cells, *searches[s])
        assert r.total == pytest.approx(min(want[x, y, k] + c for t, h, x, y, k, c in goals if (t, h) == (s, g) and (x, y, k) in want))
        way = [ways[s, g][i] for i in range(len(ways[s, g]))][::-1]
        assert way[-1] == (r.x, r.y, r.layer) and way[0][:2] in searches[s][0]
        cost = searches[s][0][way[0][:2]] + sum(step(cells, a[:2], b[:2]) for a, b in zip(way, way[1:]))
        assert cost == pytest.approx(by[s][way[-1]].cost) and all(a[2] <= b[2] for a, b in zip(way, way[1:]))


def test_empty_searches(spark, grid):
    rows = grid[3]
    none = spark.createDataFrame([], "search long, x long, y long, cost double")
    got = P.least_costs(rows, none)
    assert got.count() == 0 and P.traced(got, P.ends(got, spark.createDataFrame([], "search long, goal long, x long, y long, layer long, cost double"))).count() == 0


def test_sites_in_one_cell_are_one_search(spark, tmp_path, monkeypatch):
    """Copies of the sites with shifted keys lie where the first ones lie: they add rows, not searches."""
    from pyspark.sql import functions as F

    from chronogaz.operators import gridpath
    from chronogaz.plans import registry

    few = spark.createDataFrame([(k, k % 3) for k in range(4)], "s_suppkey long, s_nationkey int")
    few.unionByName(few.withColumn("s_suppkey", F.col("s_suppkey") + 6000)).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, f"n{k}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    seen, costs = [], gridpath.least_costs
    monkeypatch.setattr(gridpath, "least_costs", lambda cells, sources, *a: seen.append(sources.select("search").distinct().count()) or costs(cells, sources, *a))
    got = {r.search: (r.total_hm, r.traced) for r in registry.QUERIES["grf4_ways_through_targets"](spark, str(tmp_path)).collect()}
    assert seen[0] <= 4 and got and all(t for _, t in got.values())
    assert got == {**{k: got[k] for k in got if k < 4}, **{k + 6000: got[k] for k in got if k < 4}}
