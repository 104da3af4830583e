"""Chains in blocks against the plain walk, bit for bit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators import smooth as S
from kinetra.operators.chains import euro_chain
from kinetra.operators.sequence import Sequence

SCHEMA = "swing_id int, frame int, note string, x double, y double"


def plain(values):
    out, state = [], None
    for x in values:
        if x is not None and x == x:
            state = S.euro_step(x, state, 1 / 30, 1.0, 0.007, 1.0)
        out.append(state[0] if state else None)
    return out


def table(spark, lengths, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in enumerate(lengths):
        xy = np.cumsum(rng.normal(0, 30, (n, 2)), axis=0) + rng.normal(0, 200, (n, 2)) * (rng.random((n, 2)) < 0.05)
        xy[rng.random((n, 2)) < 0.2] = np.nan
        xy[:7, 0] = np.nan
        rows += [(s, i, f"{s}-{i}", *[None if np.isnan(v) and i % 2 else float(v) for v in p]) for i, p in enumerate(xy)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block, warm", [(64, 64), (64, 3), (64, 0), (200, 150), (5, 5), (4096, 512)])
def test_blocks_equal_the_chain(spark, block, warm):
    rows, df = table(spark, [600, 1, 64, 65, 129, 7], block + warm)
    out = euro_chain(df.repartition(5), ["x", "y"], Sequence(("swing_id",), block=4096), 1 / 30, 1.0, 0.007, 1.0, block, warm)
    assert out.columns == df.columns
    got = {(r.swing_id, r.frame): r for r in out.collect()}
    assert len(got) == len(rows)
    for s in range(6):
        for c in "xy":
            want = plain([r[3 + "xy".index(c)] for r in rows if r[0] == s])
            assert [got[s, i][c] for i in range(len(want))] == want, (s, c)
    assert all(r.note == f"{s}-{i}" for (s, i), r in got.items())


def test_measured_short_sequences_need_no_borders(spark):
    rows, df = table(spark, [50, 20], 1)
    out = euro_chain(df, ["x"], Sequence(("swing_id",), longest=50), 1 / 30, 1.0, 0.007, 1.0).collect()
    assert {(r.swing_id, r.frame): r.x for r in out} == {(s, i): v for s in range(2) for i, v in enumerate(plain([r[3] for r in rows if r[0] == s]))}


def test_a_long_sequence_spreads_over_tasks(spark):
    df = spark.range(60_000).select(F.lit(0).alias("swing_id"), F.col("id").cast("int").alias("frame"), F.lit("").alias("note"),
                                    (F.sin("id") * 100 + F.col("id") % 13).alias("x"), F.lit(None).cast("double").alias("y"))
    seq = Sequence(("swing_id",))
    out = S.one_euro(df, ["x", "y"], 30.0, variant="filtered", seq=seq)
    got = [r.x for r in out.orderBy("frame").select("x").collect()]
    assert got == plain([r.x for r in df.orderBy("frame").select("x").collect()])
    assert out.filter("y is not null").count() == 0
    assert euro_chain(df.limit(0), ["x"], seq, 1 / 30, 1.0, 0.007, 1.0).collect() == []
