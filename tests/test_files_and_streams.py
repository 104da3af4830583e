"""Round trips through files and streams on temporary folders."""

import json
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators.clean import mask_missing
from kinetra.operators import pairing
from kinetra.operators.sequence import Sequence
from kinetra.plans import metrics as M
from kinetra.schema import KP17, Params
from kinetra.sources import fixtures as fx, readers, writers
from kinetra.streaming import filters, jobs


def dump(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False)


def test_label_and_pose_json(spark, tmp_path):
    root = str(tmp_path)
    dump(f"{root}/Amateur/[라벨]swing/a_0001.json", {"image": {"evaluation": "Good"}, "annotations": [{"class": "person", "points": [1, 2, 2, 3, 4, 2]}]})
    dump(f"{root}/Amateur/other/a_0002.json", {"image": {"evaluation": "bad"}})
    d = readers.label_json(spark, root).collect()
    assert len(d) == 1 and d[0].image.evaluation == "Good" and "[라벨]" in d[0].path
    for i, people in enumerate([[[1, 2, 0.5, 3, 4, 0.6]], [], [[5, 6, 0.7], [7, 8, 0.9]]]):
        dump(f"{root}/pose/s1/f_{i:03d}.json", {"people": [{"pose_keypoints_2d": p} for p in people]})
    rows = sorted((r.frame, r.person_idx, r.joint_idx, r.x) for r in readers.pose_json(spark, f"{root}/pose").collect())
    assert rows == [(0, 0, 0, 1.0), (0, 0, 1, 3.0), (2, 0, 0, 5.0), (2, 1, 0, 7.0)]
    assert readers.pose_json(spark, f"{root}/pose", True).count() == 3


def test_csv_scans(spark, tmp_path):
    cols = [f"{j}_{a}" for j in KP17 for a in "xyc"]
    for sep, name in ((",", "comma"), ("\t", "tab")):
        folder = tmp_path / name
        folder.mkdir()
        with open(folder / "s.csv", "w", encoding="utf-8-sig") as f:
            f.write(sep.join(" " + c for c in cols) + "\n" + "\n".join(sep.join(str(i + k) for k in range(51)) for i in range(3)))
        df = readers.skeleton_csv(spark, str(folder))
        readers.check_columns(df)
        got = df.orderBy("frame").collect()
        assert [(r.swing_id, r.frame, float(r.Nose_x)) for r in got] == [("s", 0, 0.0), ("s", 1, 1.0), ("s", 2, 2.0)]
    with pytest.raises(ValueError, match="LEye_x"):
        readers.check_columns(df.drop("LEye_x"))
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "w.csv").write_text("1,2,0.1\n3,4,0.2\n")
    flat = readers.flat_csv(spark, str(tmp_path / "flat")).orderBy("frame").collect()
    assert [(r.frame, r.x, r.conf) for r in flat] == [(0, 1.0, 0.1), (1, 3.0, 0.2)]


def test_small_scans(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    assert [r.id for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    os.makedirs(tmp_path / "emb")
    np.save(tmp_path / "emb" / "a.npy", np.arange(4, dtype="float32"))
    v = readers.npy_vectors(spark, str(tmp_path / "emb")).collect()
    assert v[0].id == "a" and v[0].vec == [0, 1, 2, 3]
    os.makedirs(tmp_path / "depth" / "s1")
    np.save(tmp_path / "depth" / "s1" / "000004.npy", np.array([[1.0, 2.0], [3.0, np.nan]]))
    d = readers.depth_npy(spark, str(tmp_path / "depth")).filter("depth = 3").first()
    assert (d.swing_id, d.frame, d.py, d.px) == ("s1", 4, 1, 0)
    dump(f"{tmp_path}/intr/s1/a.json", {"intrinsics": {"fx": 1, "fy": 2, "cx": 3, "cy": 4}, "meta": {"depth_scale": 0.5}})
    dump(f"{tmp_path}/intr/s2/b.json", {"fx": 9, "fy": 2, "cx": 3, "cy": 4})
    k = {r.swing_id: r.fx for r in readers.intrinsics(spark, f"{tmp_path}/intr/*").collect()}
    assert k == {"s1": 1.0, "s2": 9.0}
    os.makedirs(tmp_path / "m" / "video")
    (tmp_path / "m" / "video" / "x.mp4").write_bytes(b"123")
    (tmp_path / "m" / "y.mp4").write_bytes(b"1")
    inv = readers.media_inventory(spark, str(tmp_path / "m"), leaf="video").collect()
    assert [(r.length) for r in inv] == [3]
    dump(f"{tmp_path}/pred/p.json", {"id": "q", "gt_label": 1, "pred_score": [0.1, 0.9]})
    assert readers.predictions(spark, f"{tmp_path}/pred").first().scores == [0.1, 0.9]


def test_depth_patch_forms_agree(spark, tmp_path):
    rng = np.random.default_rng(2)
    os.makedirs(tmp_path / "s1")
    for f in range(3):
        a = rng.random((20, 30)) * 3
        a[rng.random((20, 30)) < 0.3] = 0
        a[0, 0] = np.nan
        np.save(tmp_path / "s1" / f"{f:06d}.npy", a)
    pts = spark.createDataFrame([("s1", f, j, float(x), float(y)) for f in range(3) for j, (x, y) in enumerate(
        [(0, 0), (10.5, 7.5), (29, 19), (31, 5), (200, 5)])], "swing_id string, frame int, joint_idx int, x double, y double")
    long = pairing.depth_patch(pts, readers.depth_npy(spark, str(tmp_path)), ["swing_id", "frame"])
    maps = pairing.depth_patch_maps(pts, readers.depth_maps(spark, str(tmp_path)), ["swing_id", "frame"])
    a, b = (sorted(map(tuple, d.select("frame", "joint_idx", "depth").collect())) for d in (long, maps))
    assert [r[:2] for r in a] == [r[:2] for r in b] and len(a) == 12
    np.testing.assert_allclose([r[2] for r in a], [r[2] for r in b])


def test_sinks(spark, sf, tmp_path):
    s = fx.samples(spark, sf).withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("test"))
    writers.annotation_set(s, f"{tmp_path}/ann")
    assert readers.annotation_set(spark, f"{tmp_path}/ann", "train+nothing").count() == s.filter("split = 'train'").count()
    assert readers.annotation_set(spark, f"{tmp_path}/ann", "nothing").count() == s.count()
    assert readers.split_names("trainval,test") == ["train", "val", "test"]
    assert readers.split_names("both") == readers.split_names("train + val") == readers.split_names("train_and_val") == ["train", "val"]
    writers.split_lists(s, f"{tmp_path}/ids", s.filter("id < 10"))
    assert spark.read.text(f"{tmp_path}/ids/split=train").count() == s.filter("split = 'train' and id >= 10").count()
    docs = fx.meta(spark, sf).withColumn("e", F.get_json_object("doc", "$.image.evaluation"))
    writers.label_layout(docs, f"{tmp_path}/lab", F.col("e"))
    assert sorted(os.listdir(f"{tmp_path}/lab"))[-4:] == ["tf=false", "tf=other", "tf=true", "tf=unknown"]
    a = spark.createDataFrame([(1, None)], "x int, y double")
    writers.merged_json({"f1": a, "f2": a.select("x")}, f"{tmp_path}/cat", "concat")
    assert {r.source for r in spark.read.json(f"{tmp_path}/cat").collect()} == {"f1", "f2"}
    writers.merged_json({"f1": a, "f2": a}, f"{tmp_path}/by")
    assert sorted(d for d in os.listdir(f"{tmp_path}/by") if d.startswith("source")) == ["source=f1", "source=f2"]
    writers.metric_csv({"com": a}, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().y is None
    writers.result_documents(spark.createDataFrame([("3d", 5, "z")], "dimension string, frame_count int, secret string"), f"{tmp_path}/res")
    assert spark.read.json(f"{tmp_path}/res").columns == ["dimension", "frame_count"]
    writers.records_json(a, f"{tmp_path}/rec")
    writers.evaluation_rows(spark.createDataFrame([("a", 1, 0)], "id string, gt int, pred int"), f"{tmp_path}/ev")


def test_summary_document(spark, sf):
    pose = mask_missing(fx.pose(spark, sf)).filter("swing_id < 2")
    res, _ = M.run_all(pose, Params(), Sequence(longest=100), ["com_speed"])
    doc = json.loads(M.summary_document(res, ["swing_id"], "3d").filter("swing_id = 0").first().document)
    assert doc["job_id"] == "0" and doc["metrics"]["com_speed"]["summary"]["unit"] == "mm/s"


@pytest.mark.parametrize("method", ["ema", "oneeuro"])
def test_live_filter_equals_batch(spark, tmp_path, method):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(0, 1, (2, 30)), axis=1)
    x[0, [0, 4, 11]] = np.nan
    rows = [(k, i, None if np.isnan(x[k, i]) else float(x[k, i])) for k in range(2) for i in range(30)]
    schema = "k int, frame int, x double"
    for part in range(3):
        chunk = [r for r in rows if r[1] // 10 == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
        for f in os.listdir(f"{tmp_path}/in/p{part}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/src", exist_ok=True)
                with open(f"{tmp_path}/in/p{part}/{f}", "rb") as a, open(f"{tmp_path}/src/{part}.parquet", "wb") as b:
                    b.write(a.read())
                os.utime(f"{tmp_path}/src/{part}.parquet", (1000 + part, 1000 + part))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    filters.live_filter(spark, stream, f"{tmp_path}/out", ["k"], ["frame"], F.floor(F.col("frame") / 4), "x", method=method).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/rows").orderBy("k", "frame").toPandas()["filtered"].to_numpy(dtype=float)
    rows, before = spark.createDataFrame(rows, schema), None
    want = filters.filter_batch(rows, before, ["k"], ["frame"], F.lit(0), "x", method)[0].orderBy("k", "frame").toPandas()["filtered"]
    np.testing.assert_allclose(got, want.to_numpy(dtype=float), rtol=1e-12, equal_nan=True)
    assert len(got) == 60


def test_wait_for_both_stream(spark, tmp_path):
    """A result in time completes the job; without one the row comes out partial after the watermark."""
    ts = datetime(2024, 1, 1)
    a = [("a", ts), ("b", ts), ("late", ts + timedelta(hours=3))]
    b = [("a", ts + timedelta(seconds=20), 1), ("b", ts + timedelta(seconds=50), 2), ("late", ts + timedelta(hours=3), 3)]
    sa, sb = "job_id string, ts timestamp", "job_id string, ts timestamp, payload int"
    spark.createDataFrame(a, sa).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame(b, sb).coalesce(1).write.parquet(f"{tmp_path}/b")
    out = jobs.wait_for_both(spark.readStream.schema(sa).parquet(f"{tmp_path}/a"), spark.readStream.schema(sb).parquet(f"{tmp_path}/b"), 30)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.job_id: r.state for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/o").collect()}
    assert got["a"] == "complete" and got["b"] == "partial"


def test_notify_once_stream(spark, tmp_path):
    ts = datetime(2024, 1, 1)
    schema = "job_id string, owner string, status string, ts timestamp"
    spark.createDataFrame([("a", "u", "COMPLETED", ts), ("a", "u", "COMPLETED", ts), ("b", "x", "COMPLETED", ts), ("c", "u", "FAILED", ts)], schema) \
        .coalesce(1).write.parquet(f"{tmp_path}/in")
    owners = spark.createDataFrame([("a", "u"), ("b", "y"), ("c", "u")], "job_id string, owner string")
    out = jobs.notify_once(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), owners)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.job_id, r.owner) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/o").collect()] == [("a", "u")]


def test_ingest_resumes(spark, tmp_path):
    schema = "video_path string, v int"
    spark.createDataFrame([("a", 1), ("b", -1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")

    def process(df):
        bad = F.col("v") < 0
        return df.withColumns({"status": F.when(bad, "failed").otherwise("done"), "error": F.when(bad, "negative")})

    def run():
        src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.ingest(spark, src, process, f"{tmp_path}/t", f"{tmp_path}/m", f"{tmp_path}/c").awaitTermination()

    run()
    run()
    assert [r.video_path for r in spark.read.parquet(f"{tmp_path}/t").collect()] == ["a"]
    assert {r.video_path: r.status for r in spark.read.parquet(f"{tmp_path}/m").collect()} == {"a": "done", "b": "failed"}


def test_one_file_each_is_written_by_many_tasks_in_order(spark, tmp_path):
    from kinetra.catalog.files import FILES_A_TASK, _one_file_each
    n = 3 * FILES_A_TASK
    rows = spark.range(n).select((F.col("id") % 2).alias("by"), (n - F.col("id")).alias("at"), F.col("id").cast("string").alias("value"))
    _one_file_each(rows, f"{tmp_path}/out", "by", "at", "text")
    tasks = set()
    for by in (0, 1):
        files = sorted((tmp_path / "out" / f"by={by}").glob("*.txt"))
        tasks |= {f.name[:10] for f in files}
        assert [int(f.read_text()) for f in files] == [i for i in range(n - 1, -1, -1) if i % 2 == by]
    assert len(tasks) >= 3
