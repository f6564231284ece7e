"""Graphs as edge tables: strengths, modularity, components, communities; Leiden's method on the driver for small ones."""

from __future__ import annotations

import random
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ranking import cut, written


def strengths(edges: DataFrame) -> DataFrame:
    """(node, degree, strength) of an undirected weighted edge table (a, b, weight)."""
    both = edges.select(F.col("a").alias("node"), "weight").unionAll(edges.select(F.col("b").alias("node"), "weight"))
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(modularity) of a partition (node, community), from two aggregations."""
    k = strengths(edges).join(membership, "node").groupBy("community").agg(F.sum("strength").alias("k"))
    left = membership.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    right = membership.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inside = edges.join(left, "a").join(right, "b").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("m"))
    return k.crossJoin(F.broadcast(inside)).groupBy("inside", "m").agg(F.sum(F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("e")).select((F.col("inside") / F.col("m") - gamma * F.col("e")).alias("modularity"))


def _joined(live: DataFrame) -> DataFrame:
    """(node, to): the smallest node of its component for each other node, in one task."""

    def run(batches):
        up: dict = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "to"])

    kind = to_arrow_type(live.schema["a"].dataType)
    return live.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", live.schema["a"].dataType), T.StructField("to", live.schema["a"].dataType)]))


def components(edges: DataFrame, few: int = 100_000) -> DataFrame:
    """(node, component): the smallest node of each component.

    Each round hooks a component onto its smallest neighbour and jumps pointers,
    until no edge leads out of a component. A component that has none smaller is
    met by a larger one, so rounds grow with the logarithm of the nodes at most.
    The last ``few`` edges between components are joined in one task.
    Each step is checkpointed, so that the plan doesn't grow and lost executors
    cost one step.
    """
    ends = cut(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    labels = ends.select(F.col("a").alias("node")).unionAll(ends.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node"))
    live = cut(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while left := live.count():
        hook = cut(_joined(live) if left <= few else live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        while left > few:
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = cut(hook.join(up, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            hook = jumped.select("node", "to")
            if jumped.filter("moved").isEmpty():
                break
        labels = cut(labels.join(hook.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        if left <= few:
            break
        a = hook.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        b = hook.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = live.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).filter("a <> b")
        live = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels.select("node", F.col("label").alias("component"))


class _Graph:
    """Undirected weighted graph of one level; ``size`` is what a node stands for."""

    def __init__(self, n: int, edges: dict):
        self.n = n
        self.near: list[dict] = [{} for _ in range(n)]
        self.loop = [0.0] * n
        for (a, b), w in edges.items():
            if a == b:
                self.loop[a] += w
            else:
                self.near[a][b] = self.near[a].get(b, 0.0) + w
                self.near[b][a] = self.near[b].get(a, 0.0) + w
        self.k = [sum(self.near[v].values()) + 2 * self.loop[v] for v in range(n)]
        self.m2 = sum(self.k) or 1.0


def _quality(g: _Graph, part: list[int], gamma: float) -> float:
    inside, k = 0.0, {}
    for v in range(g.n):
        inside += 2 * g.loop[v] + sum(w for u, w in g.near[v].items() if part[u] == part[v])
        k[part[v]] = k.get(part[v], 0.0) + g.k[v]
    return inside / g.m2 - gamma * sum((x / g.m2) ** 2 for x in k.values())


def _move(g: _Graph, part: list[int], gamma: float, rng: random.Random) -> bool:
    """Local moves with a queue until none improves."""
    total: dict[int, float] = {}
    for v in range(g.n):
        total[part[v]] = total.get(part[v], 0.0) + g.k[v]
    order = list(range(g.n))
    rng.shuffle(order)
    queue, waiting, moved = deque(order), set(order), False
    fresh = max(part, default=0) + 1
    while queue:
        v = queue.popleft()
        waiting.discard(v)
        links: dict[int, float] = {}
        for u, w in g.near[v].items():
            links[part[u]] = links.get(part[u], 0.0) + w
        old = part[v]
        total[old] -= g.k[v]
        gain = lambda c: links.get(c, 0.0) - gamma * total.get(c, 0.0) * g.k[v] / g.m2  # noqa: B023, E731
        best, most = old, gain(old)
        for c in sorted(links):
            if gain(c) > most + 1e-12:
                best, most = c, gain(c)
        if most < -1e-12:  # alone is better
            best, fresh = fresh, fresh + 1
        total[best] = total.get(best, 0.0) + g.k[v]
        if best != old:
            part[v], moved = best, True
            for u in g.near[v]:
                if part[u] != best and u not in waiting:
                    queue.append(u)
                    waiting.add(u)
    return moved


def _refine(g: _Graph, part: list[int], gamma: float, rng: random.Random) -> list[int]:
    """Splits communities into well-connected parts by merging single nodes greedily."""
    sub = list(range(g.n))
    inside: dict[int, list[int]] = {}
    for v in range(g.n):
        inside.setdefault(part[v], []).append(v)
    for nodes in inside.values():
        whole = sum(g.k[v] for v in nodes)
        k = {v: g.k[v] for v in nodes}
        size = {v: 1 for v in nodes}
        out = {v: sum(w for u, w in g.near[v].items() if part[u] == part[v]) for v in nodes}
        order = list(nodes)
        rng.shuffle(order)
        for v in order:
            if size[sub[v]] > 1 or out[v] < gamma * g.k[v] * (whole - g.k[v]) / g.m2 - 1e-12:
                continue
            links: dict[int, float] = {}
            for u, w in g.near[v].items():
                if part[u] == part[v] and sub[u] != sub[v]:
                    links[sub[u]] = links.get(sub[u], 0.0) + w
            best, most = None, 1e-12
            for c in sorted(links):
                fits = out[c] >= gamma * k[c] * (whole - k[c]) / g.m2 - 1e-12
                gain = links[c] - gamma * k[c] * g.k[v] / g.m2
                if fits and gain > most:
                    best, most = c, gain
            if best is not None:
                size[sub[v]] -= 1
                out[best] += out[v] - 2 * links[best]
                k[best] += g.k[v]
                size[best] += 1
                sub[v] = best
    return sub


def _compact(part: list[int]) -> list[int]:
    names: dict[int, int] = {}
    return [names.setdefault(c, len(names)) for c in part]


def leiden(n: int, edges: list[tuple[int, int, float]], gamma: float = 1.0, seed: int = 1, passes: int = 10) -> tuple[list[int], float]:
    """(community of each node, modularity) by Leiden's method on a small graph.

    Communities are numbered by first appearance, and each is connected.
    """
    rng = random.Random(seed)
    weights: dict = {}
    for a, b, w in edges:
        key = min(a, b), max(a, b)
        weights[key] = weights.get(key, 0.0) + w
    base = _Graph(n, weights)
    final, last = list(range(n)), -2.0
    for _ in range(passes):
        g, part, place = base, list(final), list(range(n))
        while True:
            moved = _move(g, part, gamma, rng)
            flat = [part[place[v]] for v in range(n)]
            sub = _compact(_refine(g, part, gamma, rng))
            if not moved or max(sub, default=-1) + 1 == g.n:
                break
            merged: dict = {}
            for v in range(g.n):
                if g.loop[v]:
                    merged[sub[v], sub[v]] = merged.get((sub[v], sub[v]), 0.0) + g.loop[v]
                for u, w in g.near[v].items():
                    if u > v:
                        key = min(sub[u], sub[v]), max(sub[u], sub[v])
                        merged[key] = merged.get(key, 0.0) + w
            up = [0] * (max(sub) + 1)
            for v in range(g.n):
                up[sub[v]] = part[v]
            place = [sub[place[v]] for v in range(n)]
            g, part = _Graph(len(up), merged), _compact(up)
        final = _compact(flat)
        now = _quality(base, final, gamma)
        if now - last <= 1e-10:
            break
        last = now
    final = _connected(base, final)
    return final, _quality(base, final, 1.0)


def _connected(g: _Graph, part: list[int]) -> list[int]:
    out, fresh = [-1] * g.n, 0
    for v in range(g.n):
        if out[v] < 0:
            out[v], stack = fresh, [v]
            while stack:
                x = stack.pop()
                for u in g.near[x]:
                    if out[u] < 0 and part[u] == part[x]:
                        out[u] = fresh
                        stack.append(u)
            fresh += 1
    return out


# --- communities of large graphs ---------------------------------------------


def _weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a <= b, a row for each pair; a loop holds the weight inside its node."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def _degrees(edges: DataFrame) -> DataFrame:
    """(node, k); a loop counts twice."""
    ends = edges.select(F.col("a").alias("node"), "weight").unionAll(edges.select(F.col("b").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("k"))


def local_moves(edges: DataFrame, labels: DataFrame, gamma: float = 1.0, rounds: int = 12, least: float = 0.002) -> tuple[DataFrame, int]:
    """(labels, moves): nodes moved to the neighbouring community with the largest gain of modularity.

    ``edges`` as ``_weights`` gives them, ``labels`` (node, community). All nodes
    of a half, drawn anew by hash each round, decide at once on the labels of the
    round before, so that two neighbours don't swap for ever. It ends when a
    round moves fewer than a share ``least`` of the nodes, twice in a row.
    """
    degrees = written(_degrees(edges))
    n, m2 = degrees.agg(F.count("*"), F.sum("k")).first()
    if not n or not m2:
        return labels, 0
    near = edges.filter("a <> b")
    near = written(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    total, still = 0, 0
    for turn in range(rounds):
        held = labels.join(degrees, "node")
        mass = held.groupBy("community").agg(F.sum("k").alias("mass"))
        mine = held.filter(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0).withColumnRenamed("community", "own")
        links = near.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        # the own community is an option even without a neighbour in it
        options = links.join(mine, "node").unionByName(mine.select("node", F.col("own").alias("community"), F.lit(0.0).alias("w"), "own", "k"))
        options = options.groupBy("node", "community", "own", "k").agg(F.sum("w").alias("w")).join(mass, "community")
        stays = F.col("community") == F.col("own")
        gain = F.col("w") - gamma * F.col("k") * (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)) / m2
        # rounded, so that sums in another order give the same choice; staying wins a tie, then the smaller community
        best = options.groupBy("node").agg(F.min_by("community", F.struct(-F.round(gain, 9), (~stays).cast("int"), "community")).alias("to"), F.first("own").alias("own")).filter("to <> own")
        moves = written(best.select("node", "to"))
        moved = moves.count()
        labels = written(labels.join(moves, "node", "left").select("node", F.coalesce("to", "community").alias("community")))
        total += moved
        still = still + 1 if moved < max(1.0, least * n) else 0
        if still == 2:
            break
    return labels, total


def communities(edges: DataFrame, gamma: float = 1.0, seed: int = 1, small: int = 50_000) -> DataFrame:
    """(node, community) of an undirected weighted edge table (a, b, weight); each community is connected.

    Local moves and aggregation by turns, distributed, until the graph of the
    communities has at most ``small`` edges: these alone are collected, and
    ``leiden`` solves them. A graph that no move makes smaller stays as it is.
    Then nodes move once more in the whole graph. A community is named by its smallest node.
    """
    spark = edges.sparkSession
    whole = level = written(_weights(edges.filter("a IS NOT NULL AND b IS NOT NULL AND weight > 0")))
    kind = whole.schema["a"].dataType
    labels = None  # node of the whole graph -> node of the level
    large = whole.count() > small
    while level.count() > small:
        nodes = level.select(F.col("a").alias("node")).unionAll(level.select(F.col("b").alias("node"))).distinct()
        found, moved = local_moves(level, written(nodes.withColumn("community", F.col("node"))), gamma)
        if not moved:
            break
        labels = found if labels is None else written(labels.join(found.select(F.col("node").alias("community"), F.col("community").alias("up")), "community").select("node", F.col("up").alias("community")))
        a, b = (found.select(F.col("node").alias(x), F.col("community").alias(f"{x}2")) for x in "ab")
        level = written(_weights(level.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"), "weight")))
    rows = level.orderBy("a", "b").limit(small + 1).collect()
    if len(rows) <= small:
        names = sorted({x for r in rows for x in (r.a, r.b)})
        at = {x: i for i, x in enumerate(names)}
        part, _ = leiden(len(names), [(at[r.a], at[r.b], float(r.weight)) for r in rows], gamma, seed)
        first: dict = {}
        table = spark.createDataFrame([(x, first.setdefault(c, x)) for x, c in zip(names, part, strict=True)], T.StructType([T.StructField("node", kind), T.StructField("community", kind)]))
        if labels is None:
            return table
        labels = written(labels.join(table.select(F.col("node").alias("community"), F.col("community").alias("up")), "community").select("node", F.col("up").alias("community")))
    if not large:
        return labels
    labels, _ = local_moves(whole, labels, gamma, 4)
    # moves may leave a community in parts
    a, b = (labels.select(F.col("node").alias(x), F.col("community").alias(f"{x}2")) for x in "ab")
    inside = whole.join(a, "a").join(b, "b").filter("a2 = b2").select("a", "b")
    return components(inside).select("node", F.col("component").alias("community")).unionByName(labels.select("node").join(inside.select(F.col("a").alias("node")).unionAll(inside.select(F.col("b").alias("node"))), "node", "left_anti").withColumn("community", F.col("node")))
