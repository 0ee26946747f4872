import random

from grainline.llm.components import connected_components


def test_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    edges += [(500, i) for i in range(501, 560)] + [(i + 1, i) for i in range(600, 640)] + [(7, 7), (None, 3), (3, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, find(x)) for x in parent)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u string, v string")).collect() == []
