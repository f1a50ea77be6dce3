import random

from tracelink.operators.graph import connected_components


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (5000, 5000)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, None), (None, 2)], "a long, b long")).count() == 0


def test_components_of_long_ordered_paths(spark):
    long = [(i, i + 1) for i in range(3000)] + [(10000 - i, 9999 - i) for i in range(500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(long, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(3001), 0) | dict.fromkeys(range(9500, 10001), 9500)
    named = [(f"n{i:04}", f"n{i + 1:04}") for i in range(300)]
    assert {r.component for r in connected_components(spark.createDataFrame(named, "a string, b string")).collect()} == {"n0000"}
