"""Containment, vector folds and total orders: brute force, and groups that hold most of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators import pairing as P, sets, vectors as V


@pytest.mark.parametrize("gram", [1, 3, 8])
def test_containment_matches_brute_force(spark, gram):
    rnd = random.Random(gram)
    word = lambda n: "".join(rnd.choice("abc_1é") for _ in range(n))
    long = [(k, word(rnd.randint(0, 30))) for k in range(2) for _ in range(120)] + [(0, None), (1, "aaaa" * 10), (0, "x")]
    short = [(k, word(rnd.randint(0, 12))) for k in range(2) for _ in range(80)] + [(0, None), (1, ""), (1, "aaaaaaaaaaaa"), (0, "x")]
    short += [(k, t[5:5 + rnd.randint(1, 20)]) for k, t in long if t and len(t) > 8]
    got = P.containing(spark.createDataFrame(short * 2, "k int, short string"), spark.createDataFrame(long * 2, "k int, long string"), ["k"], gram).collect()
    want = {(a, s, t) for a, s in short for b, t in long if a == b and s and t and s in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_containment_index_grows_with_the_texts(spark):
    """Ids that all share their beginning meet by their rarest piece: no text is compared with all others."""
    n = 4000
    long = spark.range(n).select(F.format_string("recording_%06d_take", "id").alias("long"))
    short = spark.range(0, n, 3).select(F.format_string("recording_%06d", "id").alias("short"))
    pairs = P.containing(short, long, [])
    assert pairs.count() == len(range(0, n, 3)) and pairs.filter(~F.contains("long", "short")).count() == 0
    none = P.containing(short.limit(0), long, [])
    assert none.count() == 0 and P.containing(short, long.limit(0), []).count() == 0


@pytest.mark.parametrize("how", ["mean", "max"])
def test_clips_fold_as_they_are_met(spark, how):
    rng = np.random.default_rng(4)
    rows = [("hot", i, [float(v) for v in rng.normal(0, 1, 6)]) for i in range(3000)]
    rows += [("gaps", 0, [1.0, float("nan"), None, -2.0]), ("gaps", 1, [-5.0, float("nan"), 3.0, -4.0]), ("ragged", 0, [1.0]), ("ragged", 1, [-3.0, -7.0]),
             ("none", 0, None), ("none", 1, []), ("zero", 0, [0.0, -1.0]), ("zero", 1, [-1.0, 0.0]), (None, 0, [2.5])]
    df = spark.createDataFrame(rows, "id string, clip int, vec array<double>").repartition(6)
    got = {r.id: r.vec for r in V.reduce_clips(df, ["id"], how).collect()}
    hot = np.array([r[2] for r in rows[:3000]])
    np.testing.assert_allclose(got.pop("hot"), hot.max(axis=0) if how == "max" else hot.mean(axis=0), rtol=1e-12)
    want = {"gaps": [1.0, None, 3.0, -2.0], "ragged": [1.0, -7.0], "none": [], "zero": [0.0, 0.0], None: [2.5]} if how == "max" else \
        {"gaps": [-2.0, None, 3.0, -3.0], "ragged": [-1.0, -7.0], "none": [], "zero": [-0.5, -0.5], None: [2.5]}
    assert got == want
    assert V.reduce_clips(df.limit(0), ["id"], how).collect() == []
    plan = V.reduce_clips(df, ["id"], how)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_" in plan


def test_a_total_order_spreads_over_tasks(spark):
    big = 10 ** 40
    names = [f"scan_{i * 7919 % 3000}_b{big + i % 5}" for i in range(3000)] + ["scan_", "scan_007", "scan_7", "Scan_8", "", "scan_0"]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(4)
    out = sets.number_in_order(df, [sets.natural_key(F.col("n")), F.col("n")])
    got = [r.n for r in sorted(out.collect(), key=lambda r: r.place)]
    assert sorted(r.place for r in out.collect()) == list(range(len(names)))

    def key(name):
        import re
        return [(t.lower(), -1 if not d else len(d.lstrip("0")), d.lstrip("0")) for t, d in re.findall(r"(\D*)(\d*)", name) if t or d], name

    assert got == sorted(names, key=key)
    # The names begin alike, and yet no range holds more than a share of them.
    ranged = df.repartitionByRange(8, sets.natural_key(F.col("n")), "n").groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < 0.4 * len(names)
    assert sets.number_in_order(df.limit(0), [F.col("n")]).collect() == []


@pytest.mark.parametrize("side", [5, 8, 64])
def test_depth_tiles_agree_with_maps(spark, tmp_path, side):
    from kinetra.sources import readers
    rng = np.random.default_rng(2)
    (tmp_path / "s1").mkdir()
    for f in range(3):
        a = rng.random((20, 30)) * 3
        a[rng.random((20, 30)) < 0.3] = 0
        a[0, 0], a[3, 3] = np.nan, np.inf
        np.save(tmp_path / "s1" / f"{f:06d}.npy", a)
    at = [(0, 0), (10.5, 7.5), (29, 19), (31, 5), (200, 5), (-1, -2), (-40, 3), (None, 4), (float("nan"), 4), (7, 8), (15.5, 16)]
    pts = spark.createDataFrame([("s1", f, j, *map(lambda v: v if v is None else float(v), p)) for f in range(3) for j, p in enumerate(at)],
                                "swing_id string, frame int, joint_idx int, x double, y double")
    tiles = P.depth_patch_tiles(pts, readers.depth_tiles(spark, str(tmp_path), side), ["swing_id", "frame"], 2, side)
    maps = P.depth_patch_maps(pts.filter("not isnan(x)"), readers.depth_maps(spark, str(tmp_path)), ["swing_id", "frame"])
    a, b = (sorted(map(tuple, d.select("frame", "joint_idx", "depth").collect())) for d in (tiles, maps))
    assert [r[:2] for r in a] == [r[:2] for r in b] and len(a) >= 18
    np.testing.assert_allclose([r[2] for r in a], [r[2] for r in b])


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_depth_of_dealt_frames_is_not_moved(spark):
    keys = ["swing_id", "frame"]
    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    frames = spark.range(40).select((F.col("id") % 4).alias("swing_id"), F.floor(F.col("id") / 4).cast("int").alias("frame")).repartition(5, *keys)
    pts = frames.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("joint_idx")).withColumns(
        {"x": F.when(F.col("joint_idx") < 2, F.col("joint_idx") * 4.0 + 2), "y": F.lit(3.0)})
    tiles = frames.select(*keys, F.explode(F.array(F.lit(0), F.lit(1))).alias("tx"), F.lit(0).alias("ty"), cells.alias("cells"))
    pixels = tiles.select(*keys, "tx", F.posexplode("cells").alias("i", "depth")).select(
        *keys, (F.col("tx") * 8 + F.col("i") % 8).alias("px"), F.floor(F.col("i") / 8).cast("int").alias("py"), "depth")
    for found in (P.depth_patch_tiles(pts, tiles, keys), P.depth_patch(pts, pixels, keys)):
        assert exchanges(found) == 2
        rows = found.collect()
        assert len(rows) == 80 and {(r.joint_idx, r.depth) for r in rows} == {(0, 26.0), (1, 29.0)}


def test_one_row_per_joint_holds_plain_buffers(spark):
    rows = [(1, 0, 0, j, seq, float(seq + j), 1.0, None if j == 2 and seq == 5 else 1.0) for j in range(3) for seq in (9, 5, 7)] + [(1, 1, 0, 0, None, 1.0, 1.0, 1.0)]
    pose = spark.createDataFrame(rows, "swing_id int, frame int, person_idx int, joint_idx int, seq long, X3 double, Y3 double, Z3 double")
    found = sets.one_per_joint(pose.repartition(3, "swing_id", "frame"), "seq")
    assert found.columns == pose.columns and exchanges(found) == 1 and "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 0, 5, 5.0, 1.0, 1.0), (1, 0, 0, 1, 5, 6.0, 1.0, 1.0)]


def test_a_sample_with_gaps_counts_its_frames(spark):
    from kinetra.operators.sequence import Sequence
    from kinetra.plans.training import usable_samples
    rows = [(s, f, 0, j, float(f), 1.0, 0.5) for s, frames in ((1, range(60)), (2, range(0, 90, 3))) for f in frames for j in range(2)]
    pose = spark.createDataFrame(rows, "swing_id int, frame int, person_idx int, joint_idx int, x double, y double, conf double")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "swing_id int, label int")
    got = usable_samples(pose, labels, Sequence(longest=90), trim=False, min_frames=40)
    assert [(r.swing_id, r.start, r.end, r.total_frames, r.label) for r in got.collect()] == [(1, 0, 59, 60, 0)]
    got = usable_samples(pose, labels, Sequence(longest=90), trim=False, min_frames=29)
    assert {(r.swing_id, r.total_frames) for r in got.collect()} == {(1, 60), (2, 30)}


def test_plain_names_come_first_in_2d():
    from kinetra.operators.reshape import resolve_axes
    columns = ["Nose__x", "Nose__y", "Nose_x", "Nose_y", "LHip__x", "LHip__y"]
    assert resolve_axes(columns, prefer_2d=True) == {"Nose": {"x": "Nose_x", "y": "Nose_y"}, "LHip": {"x": "LHip__x", "y": "LHip__y"}}
    assert resolve_axes(columns)["Nose"] == {"x": "Nose__x", "y": "Nose__y"}
