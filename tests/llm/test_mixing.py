import pytest

from kinetra.llm.mixing import mix_sources, mixed_documents

SCHEMA = "doc_id long, text string, source string"


def water_level(sizes, weights, budget, most):
    """Targets by resharing the excess until none is above its bound."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    left = budget * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: (left - sum(most * sizes[f] for f in full)) * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= most * sizes[s]}
        if not over:
            target = share | {s: most * sizes[s] for s in full}
            return target
        full |= over
        if len(full) == len(names):
            return {s: most * sizes[s] for s in names}


def rows():
    out = [(i, "w " * (1 + i * 7 % 23), f"s{i % 3 if i % 5 else 9}") for i in range(600)]
    return out + [(700, None, "s1"), (701, " \n", "empty"), (702, "a b", None), (703, "word " * 3000, "s2"), (None, "x y z", "s2"), (5, "again here", "s0")]


@pytest.mark.parametrize("weights, budget, most, slices", [((5, 2, 1), 1.5, 2, 4096), ((5, 2, 1), 1.5, 2, 16), ((1, 1), 0.5, 1, 50), ((1,), 2.0, 2, 7)])
def test_targets_and_takes(spark, weights, budget, most, slices):
    data = rows()
    got = mix_sources(spark.createDataFrame(data, SCHEMA), weights=weights, budget=budget, most=most, slice_rows=slices).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = water_level(sizes, weights, budget, most)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken % max(r["size"], 1) == 0 and 0 <= r.taken <= most * r["size"]
    for s, target in targets.items():
        longest = max(len((t or "").split()) for _, t, x in data if x == s)
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= longest / 2 + 0.5


def test_slices_dont_change_the_mix_and_reruns_agree(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    once = sorted(map(tuple, mix_sources(df, slice_rows=64).collect()), key=str)
    assert once == sorted(map(tuple, mix_sources(df.repartition(5), slice_rows=4096).collect()), key=str)
    assert mix_sources(df.limit(0)).collect() == []


def test_documents_come_as_often_as_taken(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows()[:600])], SCHEMA + ", _times int")
    out = mixed_documents(df)
    assert out.columns == df.columns
    want = {r.doc_id: r.taken // r["size"] for r in mix_sources(df).collect() if r.taken}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
