"""Least-cost ways over a grid of cells: eight directions, corners not cut, through ordered targets, dearer near a shore.

A state is a cell and a layer: how many of the targets, taken in order, the way has met. The grid is dealt out in square
tiles. A round takes the tiles that got better states from a neighbour, settles each tile in a task of its own and hands
what leaves the tile on, so rounds grow with the tiles that a way crosses, not with its cells. A task holds one tile
for some searches: tile * tile cells for each layer and search.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogaz.operators.graph import checkpointed

#: Cells on a tile's side.
TILE = 64
#: Searches that one task takes through a tile, about.
SEARCHES = 32
#: Columns with the cost of a step into a cell: along its row, from the row below, from the row above; the same, diagonal.
STEPS = ("level", "up", "down", "diagonal_up", "diagonal_down")
_MOVES = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
_STATE = "search long, x long, y long, layer long, cost double, px long, py long, pl long"


def clearance(free: DataFrame, blocked: DataFrame, radius: int) -> DataFrame:
    """(x, y) of free and blocked cells -> (x, y, d2): squared distance to the nearest blocked cell, null beyond the radius."""
    ring = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    near = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), F.lit(i * i + j * j).cast("long").alias("d2")) for i, j in ring]))
    reached = blocked.select(near.alias("r")).groupBy("r.x", "r.y").agg(F.min("r.d2").alias("d2"))
    return free.join(reached, ["x", "y"], "left").select("x", "y", "d2")


def stepped(cells: DataFrame, length: Column, up: Column, down: Column, clear: Column | None = None, within: float = 0.0, weight: float = 0.0) -> DataFrame:
    """(x, y) -> with STEPS: ground length of a step inside the row, from the row below and from the one above, raised by up
    to `weight` times where the cell's clearance (null: far) is below `within`."""
    raised = F.lit(1.0)
    if clear is not None:
        short = F.greatest(F.lit(0.0), F.lit(within) - F.coalesce(clear, F.lit(within))) / within
        raised = 1 + short * weight
    root = math.sqrt(2.0)
    return cells.select("x", "y", *[(c * raised).alias(n) for n, c in zip(STEPS, (length, up, down, up * root, down * root))])


def _tile(c: str, tile: int) -> Column:
    return F.floor(F.col(c) / tile).cast("long")


def _dealt(cells: DataFrame, tile: int) -> DataFrame:
    """Cells by tile, those at a side also to the tiles beside it."""
    around = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile).cast("long") for d in (-1, 0, 1)])))
    return cells.withColumn("tx", around("x")).withColumn("ty", around("y"))


def _grouped(df: DataFrame, by: list[str]):
    """Grouped under names of its own, as both sides of a cogroup come from one frame."""
    return df.select(*[F.col(c).alias(f"_{c}" if c in by else c) for c in df.columns]).groupBy(*[f"_{c}" for c in by])


def least_costs(cells: DataFrame, sources: DataFrame, targets: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """cells: (x, y, STEPS); sources: (search, x, y, cost); targets: (search, layer from 0, x, y) cells that meet a target ->
    (search, x, y, layer, cost, px, py, pl): the least cost of each state that is reached, and the state before it (null
    where the search starts; of equal costs the least). Sources on no cell are left out."""
    grid = checkpointed(_dealt(cells.select(F.col("x").cast("long"), F.col("y").cast("long"), *STEPS), tile))
    on = sources.join(cells.select("x", "y"), ["x", "y"], "left_semi").groupBy("search", "x", "y").agg(F.min("cost").cast("double").alias("cost"))
    on = checkpointed(on.select(*[F.col(c).cast("long") for c in ("search", "x", "y")], "cost"))
    parts = on.select("search").distinct().count() // SEARCHES + 1
    part = F.pmod(F.xxhash64("search"), F.lit(parts)).alias("part")
    none = F.lit(None).cast("long")
    hits = None if targets is None else targets.groupBy(*[F.col(c).cast("long").alias(c) for c in ("search", "x", "y")]).agg(F.array_sort(F.collect_set(F.col("layer").cast("long"))).alias("hits"))
    layer = F.lit(0).cast("long")
    fresh = on
    if hits is not None:  # a source may stand on a target
        layer = F.aggregate(F.coalesce("hits", F.array().cast("array<long>")), layer, lambda k, h: F.when(h == k, k + 1).otherwise(k))
        fresh = on.join(hits, ["search", "x", "y"], "left")
        hits = checkpointed(_dealt(hits, tile).select(part, "search", "x", "y", *[F.lit(None).cast("double").alias(c) for c in STEPS], "tx", "ty", "hits"))
    fresh = fresh.select("search", "x", "y", layer.alias("layer"), "cost", none.alias("px"), none.alias("py"), none.alias("pl"), part, _tile("x", tile).alias("tx"), _tile("y", tile).alias("ty"), F.lit(True).alias("fresh"))
    names, fresh = fresh.columns, checkpointed(fresh)
    settled = fresh.limit(0)

    def settle(key, states: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_settled(key, states, around, tile)), columns=names)

    by = ["part", "tx", "ty"]
    while not fresh.isEmpty():
        tiles = fresh.select(*by).distinct()
        around = tiles.join(grid, ["tx", "ty"]).select("part", F.lit(-1).cast("long").alias("search"), "x", "y", *STEPS, "tx", "ty", F.lit(None).cast("array<long>").alias("hits"))
        around = around if hits is None else around.unionByName(hits.join(tiles, by, "left_semi"))
        both = settled.join(tiles, by, "left_semi").unionByName(fresh)
        out = checkpointed(both.groupBy(*by).cogroup(_grouped(around, by)).applyInPandas(settle, _STATE + ", part long, tx long, ty long, fresh boolean"))
        done = out.where("not fresh")
        settled = checkpointed(settled.join(done.select(*by).distinct(), by, "left_anti").unionByName(done))
        fresh = out.where("fresh")  # a tile drops what is no better than its own
    return settled.select(*[c.split()[0] for c in _STATE.split(", ")])


def _settled(key, states: pd.DataFrame, around: pd.DataFrame, tile: int) -> Iterator[tuple]:
    """All states of one tile for the searches of a part, and those that leave it (fresh)."""
    part, tx, ty = (int(k) for k in key)
    steps, hits = {}, {}
    for search, x, y, *costs, met in around[["search", "x", "y", *STEPS, "hits"]].itertuples(index=False, name=None):
        if met is None:
            steps[x, y] = costs
        else:
            hits.setdefault(search, {})[x, y] = set(met)
    for search, own in states.groupby("search"):
        for row in _one_search(own, steps, hits.get(search, {}), tile, tx, ty):
            yield search, *row[:-1], part, row[0] // tile, row[1] // tile, row[-1]


def _one_search(states: pd.DataFrame, steps: dict, hits: dict, tile: int, tx: int, ty: int) -> Iterator[tuple]:
    """Dijkstra inside one tile from its fresh states: (x, y, layer, cost, px, py, pl, fresh)."""
    none = (-1, -1, -1)
    best: dict[tuple, tuple] = {}
    heap: list[tuple] = []
    for row in states.sort_values("fresh")[["x", "y", "layer", "cost", "px", "py", "pl", "fresh"]].itertuples(index=False, name=None):
        x, y, layer, cost, px, py, pl, fresh = row
        before = none if pd.isna(px) else (int(px), int(py), int(pl))
        if (x, y, layer) not in best or (cost, before) < best[x, y, layer]:
            best[x, y, layer] = cost, before
            if fresh:
                heap.append((cost, x, y, layer))
    heapq.heapify(heap)
    out: dict[tuple, tuple] = {}
    while heap:
        cost, x, y, layer = heapq.heappop(heap)
        if cost > best[x, y, layer][0]:
            continue
        for dx, dy in _MOVES:
            to = x + dx, y + dy
            costs = steps.get(to)
            if costs is None or dx and dy and ((x + dx, y) not in steps or (x, y + dy) not in steps):
                continue
            total = cost + (costs[0] if not dy else costs[(1 if dy > 0 else 2) + (2 if dx else 0)])
            met, k = hits.get(to, ()), layer
            while k in met:
                k += 1
            state, found = (*to, k), (total, (x, y, layer))
            inside = to[0] // tile == tx and to[1] // tile == ty
            kept = best if inside else out
            if state not in kept or found < kept[state]:
                if inside and (state not in kept or total < kept[state][0]):
                    heapq.heappush(heap, (total, *state))
                kept[state] = found
    for kept, fresh in ((best, False), (out, True)):
        for (x, y, layer), (cost, before) in kept.items():
            yield x, y, layer, cost, *((None,) * 3 if before == none else before), fresh


def ends(states: DataFrame, goals: DataFrame) -> DataFrame:
    """goals: (search, goal, x, y, layer, cost) cells where a goal may be joined, at a cost, in this layer -> (search, goal,
    x, y, layer, total): the state in which each goal is reached at least cost; goals that are not reached are left out."""
    met = states.join(goals.withColumnRenamed("cost", "_join"), ["search", "x", "y", "layer"])
    least = met.groupBy("search", "goal").agg(F.min(F.struct((F.col("cost") + F.col("_join")).alias("total"), "x", "y", "layer")).alias("m"))
    return least.select("search", "goal", "m.x", "m.y", "m.layer", "m.total")


def traced(states: DataFrame, reached: DataFrame, tile: int = TILE) -> DataFrame:
    """(search, goal, back, x, y, layer): the cells of each way, from the goal back; a round walks each way through a tile."""
    parts = reached.select("search").distinct().count() // SEARCHES + 1
    part = F.pmod(F.xxhash64("search"), F.lit(parts)).alias("part")
    own = checkpointed(states.select("search", "x", "y", "layer", "px", "py", "pl", part, _tile("x", tile).alias("tx"), _tile("y", tile).alias("ty")))
    at = checkpointed(reached.select("search", "goal", "x", "y", "layer", F.lit(0).cast("long").alias("back"), part, _tile("x", tile).alias("tx"), _tile("y", tile).alias("ty")))
    by, done = ["part", "tx", "ty"], []
    schema = "search long, goal long, back long, x long, y long, layer long, part long, tx long, ty long, leaves boolean"

    def walk(key, starts: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        before = {row[:4]: row[4:] for row in around[["search", "x", "y", "layer", "px", "py", "pl"]].itertuples(index=False, name=None)}
        rows = []
        for search, goal, x, y, k, back in starts[["search", "goal", "x", "y", "layer", "back"]].itertuples(index=False, name=None):
            state = x, y, k
            while (search, *state) in before:
                rows.append((search, goal, back, *state, *key, False))
                p = before[search, *state]
                if pd.isna(p[0]):
                    break
                state, back = tuple(int(v) for v in p), back + 1
            else:
                rows.append((search, goal, back, *state, key[0], state[0] // tile, state[1] // tile, True))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    while not at.isEmpty():
        out = checkpointed(at.groupBy(*by).cogroup(_grouped(own.join(at.select(*by).distinct(), by, "left_semi"), by)).applyInPandas(walk, schema))
        done.append(out.where("not leaves"))
        at = out.where("leaves")
    rows = done[0] if done else states.sparkSession.createDataFrame([], schema)
    for p in done[1:]:
        rows = rows.unionByName(p)
    return rows.select("search", "goal", "back", "x", "y", "layer")
