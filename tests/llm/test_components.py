"""Components against union-find, on chains, stars, cliques and random graphs."""

import random

from structlab.llm.components import connected_components


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, k) for k in range(201, 230)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(45)]
    edges += [(a, b) for a in range(500, 506) for b in range(500, 506) if a != b] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {row.node: row.component for row in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
