"""Swing metrics: the measured and the blocked layout agree, errors are kept apart, grades at bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.functions import rules
from kinetra.operators.clean import mask_missing
from kinetra.operators.sequence import Sequence
from kinetra.plans import metrics as M
from kinetra.schema import Params
from kinetra.sources import fixtures as fx


@pytest.fixture(scope="module")
def pose(spark, sf):
    return mask_missing(fx.pose(spark, sf)).filter("swing_id < 4").cache()


@pytest.mark.parametrize("name,dim", [(n, d) for n in M.list_metrics() for d in ("3d", "2d") if (n, d) != ("xfactor", "2d")])
def test_layouts_agree(pose, name, dim):
    p = Params(dimension=dim, m_per_px=0.003)
    a = M.get_metric(name)(pose, p, Sequence(longest=100))
    b = M.get_metric(name)(pose, p, Sequence(block=20))
    tables = [(a.summary, b.summary, ["swing_id"]), (a.frames, b.frames, ["swing_id", "frame"])]
    if dim == "3d":
        # Some swings are longer than this block, the others keep the plan of whole swings.
        tops = sorted(r[0] for r in pose.groupBy("swing_id").agg(F.max("frame")).select("max(frame)").collect())
        c = M.get_metric(name)(pose, p, Sequence(block=tops[0] + 1, longest=tops[-1] + 1))
        assert tops[0] < tops[-1]
        tables += [(a.summary, c.summary, ["swing_id"]), (a.frames, c.frames, ["swing_id", "frame"])]
    for x, y, keys in tables:
        x, y = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (x, y))
        assert len(x) == len(y) > 0
        for c in x.columns:
            if x[c].dtype.kind == "f" or y[c].dtype.kind == "f":
                np.testing.assert_allclose(x[c].astype(float), y[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
            else:
                assert x[c].astype(str).tolist() == y[c].astype(str).tolist(), c


def test_failing_metric_is_reported(pose):
    M.register_metric("broken", lambda *_: 1 / 0)
    try:
        results, errors = M.run_all(pose, Params(dimension="2d"), Sequence(longest=100), ["com_speed", "xfactor", "broken"])
    finally:
        del M.REGISTRY["broken"]
    assert list(results) == ["com_speed"] and "ZeroDivisionError" in errors["broken"]


def test_grades(spark):
    df = spark.createDataFrame([(v,) for v in (-35.0, -30.0, -25.0, -15.0, -10.0, -9.0)], "v double")
    assert [r[0] for r in df.select(rules.back_shift_grade(F.col("v"))).collect()] == ["과다", "보통", "적정", "적정", "보통", "부족"]
    df = spark.createDataFrame([(v,) for v in (9.0, 10.0, 20.0, 30.0, 35.0, 36.0)], "v double")
    assert [r[0] for r in df.select(rules.down_shift_grade(F.col("v"))).collect()] == ["부족", "보통", "적정", "적정", "보통", "과다"]
    df = spark.createDataFrame([(4.9,), (5.0,), (10.0,), (15.0,), (None,)], "v double")
    assert [r[0] for r in df.select(rules.head_grade(F.col("v"))).collect()] == ["Excellent", "Good", "Caution", "Excessive", None]
    df = spark.createDataFrame([(24.9,), (25.0,), (40.0,), (50.0,), (50.1,), (None,)], "v double")
    assert [r[0] for r in df.select(rules.xfactor_category(F.col("v"))["range"]).collect()] == \
        ["< 25°", "25°–40°", "25°–40°", "40°–50°", "> 50°", "N/A"]


def test_impact_falls_back(spark):
    """No crossing: the first largest wrist value; no wrist at all: the last frame."""
    rows = []
    for f, w in enumerate([0.1, 0.4, 0.4, 0.2]):
        rows += [(0, f, 0, 10, w, 0.0, 0.0), (0, f, 0, 15, 5.0, 0.0, 0.0), (0, f, 0, 16, 5.2, 0.0, 0.0), (1, f, 0, 15, 5.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "swing_id int, frame int, person_idx int, joint_idx int, X3 double, Y3 double, Z3 double")
    s = M.swing_speed(df, Params(), Sequence(longest=4)).summary.orderBy("swing_id").collect()
    assert [r.impact_frame for r in s] == [1, 3]


def test_angles_can_stop_at_a_gap(pose):
    from dataclasses import replace
    p = Params()
    keep = M.xfactor(pose, p, Sequence(longest=100)).frames.filter("xf_X_Z is null").count()
    stop = M.xfactor(pose, replace(p, angle_gaps="stop"), Sequence(longest=100)).frames.filter("xf_X_Z is null").count()
    assert stop > keep


def test_sequences_of_one_frame(spark):
    df = spark.createDataFrame([(0, 0, 0, j, float(j), 1.0, 2.0) for j in range(17)],
                               "swing_id int, frame int, person_idx int, joint_idx int, X3 double, Y3 double, Z3 double")
    for name in ("com_speed", "com_shift", "head_speed", "swing_speed", "xfactor"):
        assert M.get_metric(name)(df, Params(), Sequence(longest=1)).summary.count() == 1


def test_all_metrics_read_a_gathered_pose_once(pose):
    """Six summaries over a pose that lies by swing: no shuffle but for those that regroup."""
    results, errors = M.run_all(pose, Params(), Sequence(longest=100))
    assert not errors and set(results) == set(M.list_metrics())
    plans = [r.summary._jdf.queryExecution().executedPlan().toString() for r in results.values()]
    assert sum(plan.count("Exchange hashpartitioning") for plan in plans) < 8
    alone = M.com_shift(pose, Params(), Sequence(longest=100)).summary.orderBy("swing_id").collect()
    assert results["com_shift"].summary.orderBy("swing_id").collect() == alone


@pytest.mark.parametrize("seq", [Sequence(longest=100), Sequence(block=30), Sequence(block=50, longest=100)])
def test_failures_stay_with_their_swings(spark, sf, seq):
    def picky(rows, p, s):
        bad = F.when(F.col("swing_id").isin(3, 8), F.raise_error(F.lit("no such pose")).cast("int")).otherwise(1)
        out = rows.select("swing_id", "frame").distinct()
        return M.MetricResult(out.groupBy("swing_id").agg(F.sum(bad).alias("n")), out)

    def hopeless(rows, p, s):
        return M.MetricResult(rows.select("swing_id").distinct().withColumn("n", F.raise_error(F.lit("never")).cast("int")), rows.select("swing_id", "frame"))

    M.register_metric("picky", picky)
    M.register_metric("hopeless", hopeless)
    M.register_metric("unplanned", lambda *_: 1 / 0)
    few = mask_missing(fx.pose(spark, sf)).filter("swing_id < 12")
    try:
        results, errors, failures = M.run_guarded(few, Params(dimension="2d"), seq, ["picky", "com_speed", "unplanned", "hopeless"], most=4)
    finally:
        for name in ("picky", "hopeless", "unplanned"):
            del M.REGISTRY[name]
    assert set(results) == {"picky", "com_speed"} and "ZeroDivisionError" in errors["unplanned"] and "never" in errors["hopeless"]
    assert sorted((r.swing_id, r.metric, "no such pose" in r.error) for r in failures.collect()) == [(3, "picky", True), (8, "picky", True)]
    ids = {r.swing_id for r in few.select("swing_id").distinct().collect()}
    assert {r.swing_id for r in results["picky"].summary.collect()} == ids - {3, 8}
    assert {r.swing_id for r in results["com_speed"].summary.collect()} == ids
    import json
    docs = {r.swing_id: json.loads(r.document)["metrics"] for r in M.summary_document(results, ["swing_id"], "2d", errors, failures=failures).collect()}
    assert "no such pose" in docs[3]["picky"]["error"] and docs[3]["picky"]["summary"] is None and docs[3]["com_speed"]["summary"]["unit"] == "px/s"
    other = min(ids - {3, 8})
    assert docs[other]["picky"]["error"] is None and docs[other]["picky"]["summary"]["n"] > 0 and "never" in docs[other]["hopeless"]["error"]


def test_a_trial_reads_the_rows_of_its_own_share(spark, sf):
    plans = []

    def odd(rows, p, s):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        bad = F.when(F.col("swing_id") % 4 == 1, F.raise_error(F.lit("no such pose")).cast("int")).otherwise(1)
        out = rows.select("swing_id", "frame").distinct()
        return M.MetricResult(out.groupBy("swing_id").agg(F.sum(bad).alias("n")), out)

    M.register_metric("odd", odd)
    few = mask_missing(fx.pose(spark, sf)).filter("swing_id < 12")
    try:
        results, errors, failures = M.run_guarded(few, Params(dimension="2d"), Sequence(longest=200), ["odd"], fan=4)
    finally:
        del M.REGISTRY["odd"]
    ids = {r.swing_id for r in few.select("swing_id").distinct().collect()}
    assert not errors and {r.swing_id for r in failures.collect()} == {i for i in ids if i % 4 == 1} != set()
    assert {r.swing_id for r in results["odd"].summary.collect()} == {i for i in ids if i % 4 != 1}
    trials = [plan for plan in plans if "FileScan" in plan]
    assert len(trials) > 4 and all("PartitionFilters: [isnotnull(_share" in plan for plan in trials)


@pytest.mark.parametrize("regroups", [False, True])
def test_many_swings_are_told_apart_by_the_tasks_of_one_plan(spark, regroups):
    """Each share in doubt used to be planned and run by itself, dozens for three failing swings."""
    plans = []

    def odd(rows, p, s):
        plans.append(rows)
        bad = F.when(F.col("swing_id") % 40 == 7, F.raise_error(F.lit("no such pose")).cast("int")).otherwise(1)
        out = rows.select("swing_id", "frame").distinct()
        if regroups:
            out = out.repartition(3, "frame")
        # One swing fails in its summary, the others in their frames.
        early = out.groupBy("swing_id").agg(F.sum(F.when(F.col("swing_id") < 40, bad).otherwise(1)).alias("n"))
        return M.MetricResult(early, out.withColumn("one", bad))

    pose = spark.range(360).select((F.col("id") % 120).alias("swing_id"), F.floor(F.col("id") / 120).cast("int").alias("frame"))
    M.register_metric("odd", odd)
    try:
        results, errors, failures = M.run_guarded(pose, Params(dimension="2d"), Sequence(longest=3), ["odd"])
    finally:
        del M.REGISTRY["odd"]
    assert not errors and sorted((r.swing_id, "no such pose" in r.error) for r in failures.collect()) == [(7, True), (47, True), (87, True)]
    assert {r.swing_id for r in results["odd"].summary.collect()} == set(range(120)) - {7, 47, 87}
    assert (len(plans) > 30) == regroups
