import hashlib
import math
import random

import numpy as np
import pytest

from kinetra.llm.centroids import cluster_report, cluster_vectors, enough_axes, nearest, rotated, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, seed, width, scale):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e, _ in rows
            if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    hashed = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), e) for i, e in kept)
    cents = [e for _, e in hashed[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(e, c)), j) for j, c in enumerate(cents)) for _, e in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(cents)):
            mine = [e for (_, e), (_, n) in zip(kept, near) if n == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    per = [sum(d for d, n in near if n == j) for j in range(len(cents))]
    return sorted(((i, j, d, per[j], sum(per), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, near)), key=str)


def rows_of(n, width, seed):
    rnd = random.Random(seed)
    places = [[rnd.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [c + rnd.gauss(0, 0.3) for c in rnd.choice(places)], "x") for i in range(n)]
    rows += [(n + i, [round(x) / 4 for x in rows[i][1]], "tie") for i in range(30)]  # many equal distances
    rows += [(i, [0.5] * width, "hot") for i in range(2000, 2100)]
    return rows + [(None, [0.1] * width, "a"), (1, rows[1][1], "again"), (9001, None, ""), (9002, [0.0] * (width - 1), ""), (9003, [], ""),
                   (9004, [0.0] * (width + 1), ""), (9005, [None] + [0.0] * (width - 1), ""), (9006, [float("nan")] + [0.0] * (width - 1), ""),
                   (9007, [float("-inf")] + [0.0] * (width - 1), ""), (9008, [-0.0] * width, "")]


@pytest.mark.parametrize("k, leading", [(12, 3), (5, 8), (1, 2), (400, 4)])
def test_clusters_match_brute_force(spark, k, leading):
    rows = rows_of(200, 8, k)
    got = cluster_report(spark.createDataFrame(rows, SCHEMA), k=k, rounds=3, seed=2, width=8, scale=16, leading=leading)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, 3, 2, 8, 16)


def test_result_does_not_depend_on_partitions(spark):
    rows = rows_of(150, 8, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted(map(tuple, cluster_report(d, k=7, rounds=4, width=8).collect()), key=str) for d in (df.repartition(5), df.coalesce(1))]
    assert runs[0] == runs[1] == brute(rows, 7, 4, 2, 8, 256)


def test_the_filter_spares_most_distances_and_loses_none():
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 200, (40, 64))
    middle[:, 20:] /= 20
    values = np.floor(middle[rng.integers(0, 40, 3000)] + rng.normal(0, 20, (3000, 64))).astype(np.int64)
    cents = values[:40]
    mean = values.mean(axis=0)
    axes = np.linalg.eigh(np.cov(values.T))[1][:, ::-1]
    head, rest = rotated(values, mean, axes, 16)
    c_head, c_rest = rotated(cents, mean, axes, 16)
    found, best, computed = nearest(values, head, rest, cents, c_head, c_rest, float((values ** 2).sum(axis=1).max()))
    every = ((values[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert computed < every.size / 5


def test_leading_axes_follow_the_variance():
    assert enough_axes(np.array([8.0, 1.0, 1.0]), 0.75) == 1 and enough_axes(np.ones(64), 0.75) == 48
    assert enough_axes(np.array([5.0, 5.0, 0.0]), 1.0) == 2 and enough_axes(np.zeros(4), 0.75) == 1


def test_large_values_and_empty_tables(spark):
    rows = [(i, [1e300 if i % 2 else -1e300, float(i)], "") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {abs(r["values"][0]) for r in whole_vectors(df, width=2).collect()} == {1 << 27}
    out = cluster_report(df, k=2, rounds=2, width=2).collect()
    assert len(out) == 6 and len({(r.vec_id % 2, r.cluster) for r in out}) == 2
    assert cluster_report(df.limit(0), width=2).collect() == []
    assert cluster_report(df, width=3).collect() == []
    assigned, cents = cluster_vectors(df, k=100, width=2)
    assert len(cents) == 6 and assigned.count() == 6
    with pytest.raises(ValueError, match="embedding"):
        cluster_report(df.drop("embedding"))
