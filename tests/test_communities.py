"""Communities of graphs that don't fit the driver's bound, against Leiden's method on the whole graph."""

import random

from lexistrata.functions.ranking import written
from lexistrata.operators import graph


def planted(rng, groups, size, inside, outside):
    n, edges = groups * size, set()
    for a in range(n):
        g = a // size
        for _ in range(inside):
            edges.add((min(a, b := g * size + rng.randrange(size)), max(a, b)))
        for _ in range(outside):
            edges.add((min(a, b := rng.randrange(n)), max(a, b)))
    return n, sorted((a, b, 1.0 + (a + b) % 3) for a, b in edges if a != b)


def test_modularity_is_near_leiden(spark):
    n, edges = planted(random.Random(5), 20, 30, 4, 1)
    table = spark.createDataFrame(edges, "a int, b int, weight double")
    got = written(graph.communities(table, small=300))
    assert got.count() == n == got.select("node").distinct().count()
    q = graph.modularity(table, got).first().modularity
    _, want = graph.leiden(n, edges)
    assert q > 0.99 * want
    # each is connected
    label = {r.node: r.community for r in got.collect()}
    up = {x: x for x in label}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, _ in edges:
        if label[a] == label[b]:
            up[root(a)] = root(b)
    assert len({root(x) for x in label}) == len(set(label.values()))


def test_small_and_odd_graphs(spark):
    table = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 2.0), ("y", "x", 1.0), ("z", "z", 1.0), (None, "a", 1.0), ("q", "a", 0.0)], "a string, b string, weight double")
    for small in (50, 1):
        groups = {}
        for r in graph.communities(table, small=small).collect():
            groups.setdefault(r.community, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["x", "y"], ["z"]]
    assert graph.communities(table.filter("a = 'none'")).collect() == []


def test_local_moves_never_lower_modularity(spark):
    n, edges = planted(random.Random(2), 6, 20, 3, 1)
    table = spark.createDataFrame(edges, "a int, b int, weight double")
    nodes = spark.range(n).selectExpr("cast(id as int) node", "cast(id as int) community")
    before = graph.modularity(table, nodes).first().modularity
    labels, moved = graph.local_moves(graph._weights(table), nodes, rounds=6)
    assert moved > 0 and graph.modularity(table, labels).first().modularity > before + 0.3
