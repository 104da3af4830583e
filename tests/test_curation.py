"""Curation, joins, sampling, scores: hand-made cases, brute force and invariants."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators import cluster, curate as C, evaluate as E, pairing as P, reshape, sample as SM, sets, vectors as V
from kinetra.operators.sequence import Sequence
from kinetra.sources import writers


def merge_short(segs, short):
    """Restated: a short segment takes in the next; a short last one joins the previous."""
    def once(s):
        out, i = [], 0
        while i < len(s):
            a, b = s[i]
            if b - a >= short:
                out.append((a, b))
            elif i + 1 < len(s):
                out.append((a, s[i + 1][1]))
                i += 1
            elif out:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            i += 1
        return out
    s = once(segs)
    while len(s) > 1 and any(b - a < short for a, b in s):
        s = once(s)
    return s


@pytest.mark.parametrize("seq", [Sequence(("video",), "segment", longest=60), Sequence(("video",), "segment", block=7)])
def test_segment_merge(spark, seq):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for v, n in enumerate([1, 2, 5, 31, 50]):
        cut = np.round(np.cumsum(rng.exponential(0.9, n)), 3).tolist()
        segs = list(zip([0.0] + cut[:-1], cut))
        rows += [(v, i, a, b) for i, (a, b) in enumerate(segs)]
        want[v] = merge_short(segs, 1.5)
    df = spark.createDataFrame(rows, "video int, segment long, start double, end double")
    got = C.merge_short_segments(df, seq, 1.5).orderBy("video", "segment").collect()
    for v in want:
        assert [(r.start, r.end) for r in got if r.video == v] == want[v]
        assert [r.segment for r in got if r.video == v] == list(range(len(want[v])))


@pytest.mark.parametrize("block", [None, 10])
def test_clusters_and_impacts(spark, block):
    nums = [1, 2, 3, 20, 21, 24, 60, 61, 62, 63]
    hit = [1, 1, 1, 1, 0, 1, 0, 0, 0, 1]
    df = spark.createDataFrame([("t", n, bool(h)) for n, h in zip(nums, hit)] + [("u", 1, True), ("u", 9, True)], "prefix string, no int, hit boolean")
    seq = Sequence(("prefix",), "no", longest=64) if block is None else Sequence(("prefix",), "no", block=block)
    c = C.gap_clusters(df, seq, 5)
    assert [r.cluster for r in c.filter("prefix = 't'").orderBy("no").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    late = C.late_detections(c, seq)
    assert sorted((r.prefix, r.no) for r in late.collect()) == [("t", 63), ("u", 9)]
    assert sorted(r.no for r in C.majority_clusters(c, seq, 4).filter("prefix = 't'").collect()) == [20, 21, 24]


def test_dbscan_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, (n, s) in enumerate([(120, 20), (150, 6), (80, 2)]):
        x, y = rng.normal(0, s, n), rng.normal(0, s, n)
        if g == 1:
            x[:60], y[:60] = np.round(x[:60]), np.round(y[:60])
        want[g] = brute(x, y, 6.0, 4)
        rows += [(g, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "g int, id long, x double, y double")
    out = cluster.dbscan(df, ["g"], "id", "x", "y", 6.0, 4).toPandas()
    for g, w in want.items():
        assert out[out.g == g].sort_values("id")["cluster"].tolist() == w.tolist()


def test_dbscan_of_a_crowded_place(spark):
    """Most points lie in a few cells, lone ones on circles around them at about eps: split boxes decide as distances do."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 0.6, 2500), rng.normal(0, 0.6, 2500)
    angle, far = rng.uniform(0, 2 * np.pi, 160), rng.uniform(5.0, 8.5, 160)
    x, y = np.r_[x, far * np.cos(angle), [x[0] + 6.0, 40.0]], np.r_[y, far * np.sin(angle), [y[0], 40.0]]
    want = brute(x, y, 6.0, 20)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, id long, x double, y double")
    out = cluster.dbscan(df, ["g"], "id", "x", "y", 6.0, 20).toPandas()
    assert out.sort_values("id")["cluster"].tolist() == want.tolist() and -1 in want
    # No task takes the distances of a lone point to a whole crowd: what is compared are boxes, by far fewer than its places.
    near = df.select("g", F.col("id").alias("_id"), "x", "y", F.floor(F.col("x") / 4).alias("cx"), F.floor(F.col("y") / 4).alias("cy"))
    lone = near.filter("_id >= 2500").selectExpr("g", "_id", "x AS qx", "y AS qy", "cx AS qcx", "cy AS qcy")
    met = cluster._full_cells_near(lone, near.filter("_id < 2500"), ["g"], 4.0, 4.0 * 2 ** 0.5, 10 ** 9).toPandas()
    d2 = (x[2500:, None] - x[:2500]) ** 2 + (y[2500:, None] - y[:2500]) ** 2
    within = (d2 <= (4.0 * 2 ** 0.5) ** 2).sum(axis=1)
    got = met.groupby("_id")["_w"].sum()
    assert {2500 + i: int(n) for i, n in enumerate(within) if n} == {int(k): int(v) for k, v in got.items()}


def brute(x, y, eps, m):
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= eps * eps
    core, lab, c = near.sum(1) >= m, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if not core[i] or lab[i] >= 0:
            continue
        todo = [i]
        lab[i] = c
        while todo:
            j = todo.pop()
            if core[j]:
                for k in np.where(near[j] & (lab < 0))[0]:
                    lab[k] = c
                    todo.append(k)
        c += 1
    return lab


def test_strict_alignment_fails_on_missing_id(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("1", 5)], "id string, v int")
    assert P.align_strict(a.filter("id = '1'"), b).collect()[0].v == 5
    with pytest.raises(Exception, match="id not in the second set: 2"):
        P.align_strict(a, b).collect()


def test_manifest_keeps_failure(spark):
    ev = spark.createDataFrame([("a", "done", "1"), ("a", "failed", "2"), ("b", "failed", "1"), ("b", "done", "2")], "video_path string, status string, ts string")
    m = P.latest_manifest(ev)
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "video_path string")
    assert sorted(r[0] for r in P.resume(items, m).collect()) == ["a", "c"]


def test_predictions_by_substring(spark):
    ann = spark.createDataFrame([("a1",), ("b2",), ("zz",)], "id string")
    pred = spark.createDataFrame([("x_b2_y", 2, 7), ("b2_first", 1, 6), ("a1", 5, 3), ("a1_x", 0, 9)], "id string, seq int, pred int")
    assert {r.id: r.pred for r in P.match_predictions(ann, pred).collect()} == {"a1": 3, "b2": 6, "zz": None}


def test_splits_are_whole_and_disjoint(spark):
    df = spark.range(500).select("id", F.when(F.col("id") == 499, 9).otherwise((F.col("id") % 3).cast("int")).alias("label"))
    t = SM.three_way_split(df).toPandas()
    assert len(t) == 500 and t["id"].is_unique
    for lab, g in t.groupby("label"):
        n = len(g)
        assert (g["split"] == "train").sum() == int(n * 0.8) and (g["split"] == "valid").sum() == int(n * 0.1)
    h = SM.stratified_holdout(df, 0.1).toPandas()
    assert h[h["label"] == 9]["split"].tolist() == ["val"]
    f = SM.folds(df, 5, "label").groupBy("label", "fold").count().toPandas()
    assert f.groupby("label")["count"].agg(lambda c: c.max() - c.min()).max() <= 1
    again = SM.three_way_split(df.repartition(7)).toPandas()
    assert dict(zip(t["id"], t["split"])) == dict(zip(again["id"], again["split"]))


def test_balancing(spark):
    df = spark.range(100).select("id", (F.col("id") >= 30).cast("int").alias("label"))
    assert {r.label: r["count"] for r in SM.undersample(df).groupBy("label").count().collect()} == {0: 30, 1: 30}
    over = SM.oversample(df).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in over} == {0: 70, 1: 70}
    assert SM.bootstrap(df).count() == 70
    with pytest.raises(Exception, match="too few"):
        SM.undersample_exact(df, small=1).collect()


def test_noise_is_reproducible(spark):
    df = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("label"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    a = SM.augment_with_noise(df, "vec", ratio=2.5, sigma=0.1).filter("augmented").toPandas()
    b = SM.augment_with_noise(df.repartition(5), "vec", ratio=2.5, sigma=0.1).filter("augmented").toPandas()
    assert len(a) == 50
    key = lambda p: sorted((i, *map(float, v)) for i, v in zip(p["id"], p["vec"]))
    assert key(a) == key(b)
    dev = np.stack(a["vec"]) - [1.0, 2.0]
    assert abs(dev.mean()) < 0.05 and 0.05 < dev.std() < 0.15


def test_missing_predictions(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (0, 1), (0, 0), (7, 1)], "gt int, pred int")
    b = E.binary_metrics(df.filter("gt < 2")).first()
    assert (b.tp, b.tn, b.fp, b.fn, b.valid) == (1, 1, 1, 0, 3)
    m = {r["class"]: r for r in E.class_metrics(df, 2).collect()}
    assert (m[1].tp, m[1].fp, m[1].fn, m[1].support) == (1, 1, 1, 2)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert abs(E.auc_scores(df, "s", "y").first().roc_auc - want) < 1e-12


def test_lda_separates(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 4))
    y = rng.integers(0, 2, 300)
    x[:, 1] += 3 * y
    df = spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "id int, label int, vec array<double>")
    out = V.lda_1d(df, df).toPandas()
    means = out.groupby("label")["projection"].mean()
    assert means[1] - means[0] > 2
    within = out["projection"] - out["label"].map(means)
    assert abs((within ** 2).sum() / 298 - 1) < 1e-9


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (120, 5)) @ np.diag([3, 2, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "id int, vec array<double>")
    out, share = V.pca_2d(df, df)
    got = np.stack(out.orderBy("id").toPandas()["projection"])
    c = x - x.mean(0)
    u, d, vt = np.linalg.svd(c, full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs(c @ vt[:2].T), atol=1e-8)
    np.testing.assert_allclose(share, (d ** 2 / (d ** 2).sum())[:2])


def test_column_resolver_and_names():
    axes = reshape.resolve_axes(["frame", "Nose__x", "Nose__y", "Nose__z", "LHip_X3D", "LHip_Y3D", "LHip_Z3D"], True)
    assert axes == {"Nose": {"x": "Nose__x", "y": "Nose__y", "z": "Nose__z"}, "LHip": {"x": "LHip_X3D", "y": "LHip_Y3D", "z": "LHip_Z3D"}}
    assert reshape.canonical_names(["nose_x", "LANKLE_conf", "midhip_score", "tail_y", "time"]) == {
        "nose_x": "Nose_x", "LANKLE_conf": "LAnkle_c", "midhip_score": "MidHip_c", "tail_y": "Tail_y"}
    assert reshape.missing_columns([f"{j}_{a}" for j in reshape.KP17 for a in "xyc"]) is None
    assert len(reshape.missing_columns(["Nose_x"])) == 50


def test_sanitise_and_landmarks(spark):
    df = spark.createDataFrame([(1, "2.5", "bad", "7")], "id int, Nose__x string, nose_conf string, LEye_y string")
    r = reshape.sanitise(df, ["id"])
    assert len(r.columns) == 52
    row = r.first()
    assert (row.Nose_x, row.Nose_y, row.Nose_c, row.LEye_y, row.REye_c) == (2.5, None, 0.0, 7.0, 0.0)
    lm = reshape.rename_landmarks(spark.createDataFrame([(0, 1.0, 2.0)], "frame_idx int, landmark_0_x double, landmark_11_y double"))
    assert lm.columns == ["frame_idx", "nose_x", "left_shoulder_y"]


def test_flat_numbers(spark):
    df = spark.createDataFrame([("1,2,0.5,3,4,0.6",), ("1,2,x,3,4",), ("1",)], "t string")
    out = [r[0] for r in df.select(reshape.flat_numbers(F.split("t", ","))).collect()]
    assert [(p.x, p.y, p.conf) for p in out[0]] == [(1, 2, 0.5), (3, 4, 0.6)]
    assert [(p.x, p.y, p.conf) for p in out[1]] == [(1, 2, None), (3, 4, None)]
    assert len(out[2]) == 25 and out[2][0].x == 0


@pytest.mark.parametrize("orient", writers.ORIENTS)
def test_json_orients_over_blocks(spark, orient):
    rows = [("a", i, i * 0.5 if i % 3 else None, f"t{i}\"") for i in range(7)] + [("b", 0, 1.0, "u")]
    df = spark.createDataFrame(rows, "k string, i int, v double, s string")
    texts = {r.k: r.text for r in writers.oriented(df, ["k"], "i", ["v", "s"], orient, block=3).collect()}
    assert len(texts) == 2 and json.loads(texts["b"])
    doc = json.loads(texts["a"])
    want = [{"v": v, "s": s} for k, _, v, s in rows if k == "a"]
    if orient == "records":
        assert doc == want
    elif orient == "index":
        assert doc == {str(i): w for i, w in enumerate(want)}
    elif orient == "values":
        assert doc == [[w["v"], w["s"]] for w in want]
    elif orient == "split":
        assert doc == {"columns": ["v", "s"], "data": [[w["v"], w["s"]] for w in want]}
    elif orient == "columns":
        assert doc == {c: {str(i): w[c] for i, w in enumerate(want)} for c in ("v", "s")}
    else:
        assert doc["data"] == want and doc["schema"]["fields"][0] == {"name": "v", "type": "number"}


def test_natural_order(spark):
    names = ["b2", "a10", "a9", "a9b", "a009"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(sets.natural_key(F.col("n")), "n").collect()]
    assert got == ["a009", "a9", "a9b", "a10", "b2"]


def test_recordings_of_any_length_give_one_row(spark):
    rows = [(s, f, j, float(f), 1.0, 0.5) for s, n in (("long", 4100), ("short", 2)) for f in range(n) for j in range(2)]
    df = spark.createDataFrame(rows, "swing_id string, frame int, joint_idx int, x double, y double, conf double")
    got = {r.swing_id: r for r in reshape.assemble_tensor(df, ["swing_id"], block=1000).collect()}
    assert got["long"].total_frames == 4100 and got["short"].total_frames == 2
    assert [f[1][0] for f in got["long"].keypoint[0]] == [float(i) for i in range(4100)]
    docs = {r.swing_id: json.loads(r.document) for r in reshape.frame_map(df.filter("joint_idx = 0"), ["swing_id"], ["x"], block=1000).collect()}
    assert list(docs["long"]) == [str(i) for i in range(4100)] and docs["long"]["4099"] == {"x": 4099.0}


def test_depth_names_of_any_number_of_digits(spark):
    frames = spark.createDataFrame([("s", 1000000), ("s", 7), ("s", 12345678901)], "swing_id string, frame long")
    maps = spark.createDataFrame([("s", "1000000.npy", 0), ("s", "0001000000x.npy", 1), ("s", "000007.npy", 2), ("s", "d12345678901.npy", 3), ("s", "0000007.npy", 4)],
                                 "swing_id string, name string, position long")
    got = {r.frame: (r.name, r.how) for r in P.match_depth_frames(frames, maps).collect()}
    assert got == {1000000: ("1000000.npy", "exact"), 7: ("000007.npy", "exact"), 12345678901: ("d12345678901.npy", "contains")}
