import random

from factloom.operators.components import components


def found(spark, edges):
    return {r.node: r.component for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}


def test_a_long_chain_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (101, 100), (None, 5), (7, 7), (200, 200)]
    assert found(spark, edges) == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}


def test_against_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(80)] + [(500, 500 + i) for i in range(1, 40)]  # and a star
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert found(spark, edges) == {x: top(x) for x in root}


def test_no_edges(spark):
    assert found(spark, []) == {}
