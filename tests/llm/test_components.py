import random

from vellum.llm.components import connected_components, local_roots

import numpy as np


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def run(spark, edges, kind="long", **kw):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    return {r.vertex: r.component for r in connected_components(df, "a", "b", **kw).collect()}


def test_local_roots():
    v, r = local_roots(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(v.tolist(), r.tolist())) == {1: 1, 3: 1, 5: 1, 8: 8, 9: 8}


def test_chain_over_many_cells(spark):
    edges = [(i, i + 1) for i in range(150)]
    random.Random(1).shuffle(edges)
    assert run(spark, edges, cell_edges=12) == brute(edges)


def test_random_graph_and_hub(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(1000, i) for i in range(1001, 1200)]
    assert run(spark, edges, cell_edges=25) == brute(edges)


def test_strings_nulls_repeats_and_self_pairs(spark):
    edges = [("b", "a"), ("a", "b"), ("b", "a"), ("c", "c"), (None, "a"), ("d", None), ("z", "b")]
    assert run(spark, edges, "string") == {"a": "a", "b": "a", "z": "a"}


def test_empty(spark):
    assert run(spark, []) == {}


def test_extra_columns(spark):
    df = spark.createDataFrame([(2, 1, "x", 5)], "a long, b long, u string, v int")
    assert {r.vertex: r.component for r in connected_components(df, "a", "b").collect()} == {1: 1, 2: 1}
