"""Bisections of a weighted graph: cut cost, gains, and two refinement heuristics."""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges up to which a graph is bisected on the driver.
MAX_EDGES = 1_000_000


def cut_cost(edges: DataFrame, side: DataFrame) -> DataFrame:
    """(cost): weight of the edges (each pair once) between the sides; side: (read_id, side)."""
    s = lambda v: side.select(F.col("read_id").alias(v), F.col("side").alias(f"s{v}"))
    return edges.where("x < y").join(s("x"), "x").join(s("y"), "y").where("sx <> sy").agg(F.coalesce(F.sum("score"), F.lit(0)).alias("cost"))


def deltas(edges: DataFrame, side: DataFrame) -> DataFrame:
    """(read_id, delta): weight of a vertex's edges to the other side, less those within its own; edges in both directions."""
    s = lambda v: side.select(F.col("read_id").alias(v), F.col("side").alias(f"s{v}"))
    e = edges.join(s("x"), "x").join(s("y"), "y")
    return e.groupBy(F.col("x").alias("read_id")).agg(F.sum(F.when(F.col("sx") != F.col("sy"), F.col("score")).otherwise(-F.col("score"))).alias("delta"))


def swap_gains(edges: DataFrame, side: DataFrame) -> DataFrame:
    """(x, y, gain) of swapping the ends of each cut edge, x on the lower side."""
    d = deltas(edges, side)
    s = lambda v: side.join(d, "read_id").select(F.col("read_id").alias(v), F.col("side").alias(f"s{v}"), F.col("delta").alias(f"d{v}"))
    e = edges.join(s("x"), "x").join(s("y"), "y").where("sx < sy")
    return e.select("x", "y", (F.col("dx") + F.col("dy") - 2 * F.col("score")).alias("gain"))


def split_half(vertices: Iterable[int], seed: int) -> tuple[set[int], set[int]]:
    order = sorted(vertices)
    random.Random(seed).shuffle(order)
    return set(order[: (len(order) + 1) // 2]), set(order[(len(order) + 1) // 2 :])


def _graph(edges: DataFrame) -> dict[int, dict[int, float]]:
    once = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "score").where("x <> y").groupBy("x", "y").agg(F.max("score").alias("score"))
    n = once.count()
    if n > MAX_EDGES:
        raise ValueError(f"the graph has {n} edges; bisection takes {MAX_EDGES} at most")
    near: dict[int, dict[int, float]] = {}
    for r in once.orderBy("x", "y").collect():
        near.setdefault(r["x"], {})[r["y"]] = r["score"]
        near.setdefault(r["y"], {})[r["x"]] = r["score"]
    return near


def cost_of(near: dict[int, dict[int, float]], a: set[int]) -> float:
    return sum(w for v in a for u, w in near[v].items() if u not in a)


def _best_swap(left: list[int], right: list[int], delta: dict[int, float], near: dict) -> tuple[float, int, int]:
    """(gain, x, y) of the best swap; sides in the order of falling delta, the first of equal gains counts.

    A gain is at most the sum of its two deltas, so the search along the ordered sides ends
    as soon as that sum is no more than the best gain found.
    """
    best = (-float("inf"), left[0], right[0])
    for x in left:
        if delta[x] + delta[right[0]] <= best[0]:
            break
        own = near[x]
        for y in right:
            both = delta[x] + delta[y]
            if both <= best[0]:
                break
            if (gain := both - 2 * own.get(y, 0)) > best[0]:
                best = (gain, x, y)
    return best


def _pass(near: dict, a: set[int], b: set[int], narrow: int | None) -> tuple[list[tuple[int, int]], float]:
    """Greedy swaps until one side is used up; the first ones whose gains sum highest, and that sum.

    narrow: how many of each side's best vertices are tried for a swap; None finds the best
    of all pairs.  The sides stay sorted; a swap moves its neighbours only.
    """
    delta = {v: sum(w if (u in a) != (v in a) else -w for u, w in near[v].items()) for v in near}
    key = lambda v: (-delta[v], v)
    sides = [sorted(s, key=key) for s in (a, b)]
    at = {v: k for k, s in enumerate((a, b)) for v in s}
    swaps, gains = [], []
    while sides[0] and sides[1]:
        gain, x, y = _best_swap(*(s[:narrow] for s in sides) if narrow else sides, delta, near)
        swaps.append((x, y))
        gains.append(gain)
        for v in (x, y):
            del sides[at[v]][bisect_left(sides[at[v]], key(v), key=key)]
        moved = {u for v in (x, y) for u in near[v] if u in at} - {x, y}
        own = {x: at.pop(x), y: at.pop(y)}
        for u in moved:
            side = sides[at[u]]
            del side[bisect_left(side, key(u), key=key)]
            for v, k in own.items():
                if u in near[v]:
                    delta[u] += 2 * near[v][u] if at[u] == k else -2 * near[v][u]
            insort(side, u, key=key)
    best, total, last = 0.0, 0.0, 0
    for k, g in enumerate(gains, 1):
        total += g
        if total > best:
            best, last = total, k
    return swaps[:last], best


def bisect(edges: DataFrame, seed: int = 1, narrow: int | None = None, max_rounds: int = 50) -> tuple[set[int], set[int], float]:
    """Two halves of the graph and their cut cost, by Kernighan and Lin's passes from a random split.

    narrow=None finds the best of all pairs in a pass; a small number (5, say) tries only each
    side's best vertices, which is faster and nearly as good.  The graph is held on the
    driver, up to MAX_EDGES edges; a larger one is an error.
    """
    near = _graph(edges)
    a, b = split_half(near, seed)
    for _ in range(max_rounds):
        swaps, gain = _pass(near, a, b, narrow)
        if gain <= 0:
            break
        out_a, out_b = {x for x, _ in swaps}, {y for _, y in swaps}
        a, b = (a - out_a) | out_b, (b - out_b) | out_a
    return a, b, cost_of(near, a)
