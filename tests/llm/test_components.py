import random

from kinetra.llm.components import connected_components


def test_components_match_union_find(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (None, 3), (5, None)]
    edges += [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(200)]
    rnd.shuffle(edges)
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == {x: find(x) for x in top}
    assert connected_components(df.limit(0)).collect() == []
