"""Queries that write files below the shared folder and scan them again: sources and sinks on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinetra.catalog.motion import masked
from kinetra.catalog.registry import query, r6
from kinetra.plans import metrics as M
from kinetra.schema import Params
from kinetra.sources import fixtures as fx, readers, writers
from kinetra.streaming import run


#: Files that one task writes; names count a task's files in a folder with three digits, so order holds below a thousand.
FILES_A_TASK = 200


def _one_file_each(rows: DataFrame, folder: str, by: str, order: str, kind: str) -> None:
    """One file per row in a folder per value of `by`; the names of a folder's files follow `order`.

    Tasks write ranges of (by, order), and their numbers lead the names. Each moves its own files into place, as the driver would
    move them one by one.
    """
    tasks = max(1, -(-rows.count() // FILES_A_TASK))
    out = rows.repartitionByRange(tasks, by, order).sortWithinPartitions(by, order).drop(order)
    out.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy(by).format(kind).save(folder)


_GRADES = "['best', 'Good', 'normal', 'BAD', 'worst', '', 'other']"


@query("src1_label_documents", f"""SELECT s_name AS filename, ({_GRADES})[1 + s_suppkey % 7] AS evaluation, CASE WHEN s_suppkey % 4 <> 0 THEN 'hit' END AS hitting,
 s_nationkey AS folder FROM supplier WHERE s_nationkey % 2 = 0""")
def _(spark, sf):
    """A document per supplier; the folders of odd nations don't carry the marker."""
    k, folder = F.col("s_suppkey"), run.scratch(spark)
    # Spellings of the evaluation field that a scan meets.
    spelled = F.element_at(F.array(*[F.lit(s) for s in ("best", "Good", "normal", "BAD", "worst", "", "other")]), (k % 7 + 1).cast("int"))
    docs = fx.table(spark, sf, "supplier").select(
        F.concat(F.when(F.col("s_nationkey") % 2 == 0, F.lit("라벨")).otherwise(F.lit("other")), F.col("s_nationkey").cast("string")).alias("set"), k.alias("o"),
        F.struct(F.col("s_name").alias("filename"), spelled.alias("evaluation"), F.when(k % 4 != 0, F.lit("hit")).alias("hitting")).alias("image"))
    _one_file_each(docs, folder, "set", "o", "json")
    found = readers.label_json(spark, folder, marker="라벨")
    return found.select("image.filename", "image.evaluation", "image.hitting", F.regexp_extract("path", r"라벨(\d+)/", 1).cast("int").alias("folder"))


@query("src2_pose_documents", """WITH f AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS frame FROM supplier),
j AS (SELECT *, unnest(range(0, 3)) AS j FROM f WHERE s_suppkey % 5 <> 0),
p AS (SELECT *, 0 AS person FROM j UNION ALL SELECT *, 1 FROM j WHERE s_suppkey % 5 = 1)
SELECT 'nation=' || s_nationkey AS swing_id, CAST(frame AS INT) AS frame, person AS person_idx, CAST(j AS INT) AS joint_idx, CAST(s_suppkey + 10 * j + 1000 * person AS DOUBLE) AS x,
 CAST(s_suppkey AS DOUBLE) AS y, CAST(j AS DOUBLE) / 4 AS conf FROM p""")
def _(spark, sf):
    """Frame files of one, two or no people; a nation is a recording and its suppliers are the frames."""
    k, folder = F.col("s_suppkey"), run.scratch(spark)

    def person(n: int):
        numbers = [v for j in range(3) for v in (k + 10 * j + 1000 * n, k, F.lit(j / 4))]
        return F.struct(F.array(*[v.cast("double") for v in numbers]).alias("pose_keypoints_2d"))

    people = F.when(k % 5 == 0, F.array().cast("array<struct<pose_keypoints_2d:array<double>>>")).when(k % 5 == 1, F.array(person(0), person(1))).otherwise(F.array(person(0)))
    frames = fx.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), k.alias("o"), people.alias("people"))
    _one_file_each(frames, folder, "nation", "o", "json")
    return readers.pose_json(spark, folder).select("swing_id", "frame", "person_idx", "joint_idx", "x", "y", "conf")


@query("src7_media_inventory", "SELECT s_nationkey AS nation, count(*) AS files, CAST(sum(strlen(s_name) + 1) AS BIGINT) AS bytes FROM supplier GROUP BY 1")
def _(spark, sf):
    folder = run.scratch(spark)
    files = fx.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("o"), F.col("s_name").alias("value"))
    _one_file_each(files, folder, "nation", "o", "text")
    found = readers.media_inventory(spark, folder, "*.txt")
    return found.groupBy(F.regexp_extract("path", r"nation=(\d+)/", 1).cast("int").alias("nation")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("src8_depth_maps", """SELECT CAST(s_nationkey AS VARCHAR) AS swing_id, CAST(s_suppkey AS INT) AS frame, CAST(py AS INT) AS py, CAST(px AS INT) AS px,
 CAST(s_suppkey + 10 * py + px AS DOUBLE) / 8 AS depth FROM supplier, (SELECT unnest(range(0, 3)) AS py), (SELECT unnest(range(0, 2)) AS px)""")
def _(spark, sf):
    def draw(batches):
        import io

        import numpy as np
        import pandas as pd
        for pdf in batches:
            out = []
            for key in pdf["frame"]:
                held = io.BytesIO()
                np.save(held, (key + 10 * np.arange(3)[:, None] + np.arange(2)[None]) / 8)
                out.append(held.getvalue())
            yield pdf.assign(content=out)

    maps = fx.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("swing_id"), F.col("s_suppkey").cast("int").alias("frame"))
    return readers.depth_values(maps.mapInPandas(draw, "swing_id string, frame int, content binary"))


def _split(spark, sf) -> DataFrame:
    """Samples dealt to four splits, with their class."""
    s, k = fx.samples(spark, sf), F.col("id")
    name = F.when(k % 10 < 6, "xsub_train").when(k % 10 < 8, "xsub_val").when(k % 10 == 8, "test").otherwise("extra")
    return s.select("id", "label", "source", "n_chars", name.alias("split"))


_SPLIT = """s AS (SELECT id, label, source, n_chars, CASE WHEN id % 10 < 6 THEN 'xsub_train' WHEN id % 10 < 8 THEN 'xsub_val' WHEN id % 10 = 8 THEN 'test' ELSE 'extra' END AS split FROM samples)"""


@query("snk5_annotation_set", f"WITH $SAMPLES, {_SPLIT} SELECT id, source, n_chars, split, label FROM s")
def _(spark, sf):
    folder = run.scratch(spark)
    writers.annotation_set(_split(spark, sf), folder)
    return readers.annotation_set(spark, folder)


@query("src11_annotations_of_splits", f"WITH $SAMPLES, {_SPLIT} SELECT id, split, label FROM s WHERE split <> 'extra'")
def _(spark, sf):
    folder = run.scratch(spark)
    writers.annotation_set(_split(spark, sf), folder)
    return readers.annotation_set(spark, folder, "trainval + test, unheard").select("id", "split", "label")


@query("snk6_split_lists", f"WITH $SAMPLES, {_SPLIT} SELECT CAST(id AS VARCHAR) AS id, split FROM s WHERE id % 13 <> 0")
def _(spark, sf):
    folder, s = run.scratch(spark), _split(spark, sf)
    writers.split_lists(s, folder, s.filter("id % 13 = 0"))
    lines = spark.read.text(folder)
    return lines.select(F.col("value").alias("id"), "split")


_SPEED = """,
c AS (SELECT swing_id, frame, avg(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END) AS cx FROM clean GROUP BY 1, 2)"""


@query("snk1_metric_tables", "WITH $CLEAN" + _SPEED + """
SELECT swing_id, 'com_frames' AS metric, frame, r6(cx) AS com_x, CAST(NULL AS VARCHAR) AS unit FROM c
UNION ALL SELECT DISTINCT swing_id, 'com_summary', NULL, NULL, 'px/s' FROM c""")
def _(spark, sf):
    folder = run.scratch(spark)
    r = M.com_speed(masked(spark, sf), Params(dimension="2d"), fx.sequence(spark, sf))
    writers.metric_csv({"com_frames": r.frames.select("swing_id", "frame", r6("com_x").alias("com_x")), "com_summary": r.summary.select("swing_id", "unit")}, folder)
    frames, summary = (spark.read.option("header", True).csv(f"{folder}/metric={m}") for m in ("com_frames", "com_summary"))
    out = frames.withColumn("metric", F.lit("com_frames")).unionByName(summary.withColumn("metric", F.lit("com_summary")), allowMissingColumns=True)
    return out.select(F.col("swing_id").cast("long").alias("swing_id"), "metric", F.col("frame").cast("int").alias("frame"), F.col("com_x").cast("double").alias("com_x"), "unit")


@query("snk3_merged_records", """SELECT doc_id, 'quality.json' AS source, CAST(quality AS INT) AS quality, CAST(NULL AS INT) AS toxic FROM labels
UNION ALL SELECT doc_id, 'toxic.json', NULL, CAST(toxic AS INT) FROM labels""")
def _(spark, sf):
    folder, rows = run.scratch(spark), fx.table(spark, sf, "labels")
    writers.merged_json({"quality.json": rows.select("doc_id", "quality"), "toxic.json": rows.select("doc_id", "toxic")}, folder, "concat")
    return spark.read.schema("doc_id long, source string, quality int, toxic int").json(folder)


@query("snk3_merged_by_file", """SELECT source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS quality, CAST(sum(toxic) AS BIGINT) AS toxic FROM (
 SELECT 'quality.json' AS source, quality, NULL AS toxic FROM labels UNION ALL SELECT 'toxic.json', NULL, toxic FROM labels) GROUP BY 1""")
def _(spark, sf):
    folder, rows = run.scratch(spark), fx.table(spark, sf, "labels")
    writers.merged_json({"quality.json": rows.select("doc_id", "quality"), "toxic.json": rows.select("doc_id", "toxic")}, folder)
    back = spark.read.schema("doc_id long, quality int, toxic int, source string").json(folder)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))


@query("snk4_label_layout", f"""WITH e AS (SELECT event_id, ({_GRADES})[1 + event_id % 7] AS g FROM events),
t AS (SELECT event_id, g, CASE WHEN lower(g) IN ('best', 'good', 'normal') THEN 'true' WHEN lower(g) IN ('bad', 'worst') THEN 'false' WHEN g = '' THEN 'unknown' ELSE 'other' END AS tf FROM e)
SELECT event_id, tf, CASE WHEN tf IN ('true', 'false') THEN lower(g) ELSE tf END AS evaluation FROM t""")
def _(spark, sf):
    folder = run.scratch(spark)
    docs = fx.meta(spark, sf).select("event_id", F.get_json_object("doc", "$.image.evaluation").alias("e"))
    writers.label_layout(docs, folder, F.col("e"))
    back = spark.read.option("inferSchema", False).schema("event_id long, e string, tf string, evaluation string").parquet(folder)
    return back.select("event_id", "tf", "evaluation")


@query("snk8_evaluation_rows", "WITH $PREDS SELECT id, gt, pred, clip FROM preds")
def _(spark, sf):
    folder = run.scratch(spark)
    rows = fx.preds(spark, sf).select(F.concat_ws("/", "id", F.col("clip").cast("string")).alias("id"), "gt", "pred")
    writers.evaluation_rows(rows, folder)
    back = spark.read.option("header", True).schema("id string, gt int, pred int").csv(folder)
    part = F.split("id", "/")
    return back.select(part[0].alias("id"), "gt", "pred", part[1].cast("int").alias("clip"))
