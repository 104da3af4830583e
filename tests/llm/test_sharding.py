import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.llm.sharding import balance_groups, difference, level_with, shard_documents, write_shards

SCHEMA = "doc_id long, text string"


def plain_differencing(sizes, ways):
    """The same rule with sorted lists: the two largest spreads are joined, fullest bins with emptiest ones."""
    parts = [(i, [(0, ())] * (ways - 1) + [(s, (i,))]) for i, s in enumerate(sizes)]
    born = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][-1][0] - p[1][0][0]), p[0]))
        a, b = parts[0][1], parts[1][1][::-1]
        parts = parts[2:] + [(born, sorted(((x + y, i + j) for (x, i), (y, j) in zip(a, b)), key=lambda p: p[0]))]
        born += 1
    return sorted(sorted(items) for _, items in parts[0][1])


@pytest.mark.parametrize("ways", [1, 2, 3, 7])
def test_differencing_matches_the_plain_rule(ways):
    rnd = random.Random(ways)
    for n in (1, 2, 5, 40):
        sizes = [rnd.randint(1, 1000) for _ in range(n)]
        bins = difference(np.array(sizes), ways)
        got = sorted(sorted(np.flatnonzero(bins == w).tolist()) for w in range(ways))
        assert got == plain_differencing(sizes, ways), (ways, sizes)
    assert list(difference(np.array([], np.int64), ways)) == []


def test_differencing_is_tighter_than_filling_in_order():
    rng = np.random.default_rng(5)
    sizes = -np.sort(-rng.integers(1000, 100_000, 2000))
    spread = np.ptp(np.bincount(difference(sizes, 40), sizes, 40))
    greedy = np.zeros(40)
    for s in sizes:
        greedy[greedy.argmin()] += s
    assert spread < np.ptp(greedy) / 5


def test_a_started_partition_is_filled_up():
    held = np.array([900, 0, 50_000, 300])
    sizes = np.array([100 + i % 7 for i in range(400)])
    start = level_with(held, sizes.sum())
    assert list(level_with(np.array([5, 0, 1]), 6)) == [3.5, 0, 1] and list(level_with(np.array([9, 0, 1]), 5)) == [3, 0, 1]
    bins = difference(sizes, 4, start.astype(np.int64))
    filled = held + np.bincount(bins, sizes, 4)
    assert filled[2] < 50_300 and np.ptp(filled[[0, 1, 3]]) < 100


def tables(rnd, n, copies):
    rows = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(rnd.randint(1, 200)))) for i in range(n)]
    rows += [(n + i, "hot group é" * 3) for i in range(copies)]
    return rows + [(None, "no id"), (None, "no id"), (None, None), (-1, None), (-2, ""), (-3, "x" * 30_000), (-4, " "), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("options", [{}, {"cell": 50, "last": 40, "part": 2}, {"cell": 20, "last": 0, "part": 4}])
def test_shards_are_balanced_and_whole(spark, options):
    rows = tables(random.Random(1), 600, 150)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("key", F.lit(0)).withColumn("shard", F.lit("s"))
    out = shard_documents(df, shards=7, **options).collect()
    size = lambda t: len((t or "").encode()) + 16
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=key) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=key)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)} and {r.shard for r in out} <= set(range(7))
    by_text = {}
    for r in out:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append((r.slot, r.size))
    assert all(sorted(x for x, _ in s) == list(range(len(s))) for s in slots.values())
    filled = [sum(b for _, b in slots[w]) for w in range(7)]
    assert max(filled) - min(filled) < (100 if options.get("last", 1) else 3000), filled


def test_a_group_above_the_mean_fills_a_shard_alone(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, "copy") for i in range(900)]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), shards=5, cell=30, last=20, part=3).collect()
    of_copies = {r.shard for r in out if r.doc_id >= 1000}
    assert len(of_copies) == 1 and not {r.shard for r in out if r.doc_id < 1000} & of_copies
    rest = [sum(r.size for r in out if r.shard == w) for w in set(range(5)) - of_copies]
    assert max(rest) - min(rest) < 40
    again = shard_documents(spark.createDataFrame(rows[::-1], SCHEMA), shards=5, cell=30, last=20, part=3).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in out) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_empty_single_and_missing(spark):
    df = spark.createDataFrame([(1, "a")], SCHEMA)
    assert shard_documents(df.limit(0)).collect() == []
    assert [(r.size, r.slot) for r in shard_documents(df).collect()] == [(17, 0)]
    with pytest.raises(ValueError, match="text"):
        shard_documents(df.drop("text"))
    large, others = balance_groups(df.limit(0).select(F.lit(b"").alias("key"), F.lit(1).alias("bytes"), F.lit(1).alias("rows")), 3)
    assert large.count() + others.count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(i, f"text {i % 40}" if i % 50 else None, "x") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA + ", _key string")
    write_shards(df, f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r.doc_id, r.text or "", r._key) for r in back.collect()) == sorted((d, t or "", k) for d, t, k in rows)
    assert back.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError, match="shard"):
        write_shards(df.withColumn("Shard", F.lit(1)), f"{tmp_path}/again")
