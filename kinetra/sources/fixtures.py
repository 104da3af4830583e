"""Pose, annotation and embedding views derived from the generic test tables.

Each view grows with its base table. `kinetra.catalog.views` states the same views as SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinetra.operators.sequence import Sequence, number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(v: float) -> Column:
    return F.lit(float(v))


def sequence(spark: SparkSession, sf_dir: str, *keys: str) -> Sequence:
    """The swings' layout, with the longest one measured on the base table."""
    sizes = table(spark, sf_dir, "events").groupBy("user_id").count()
    return Sequence(keys or ("swing_id",), longest=sizes.agg(F.max("count")).first()[0])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", "props")
    out = number_rows(ev, ["user_id"], [F.col("ts"), F.col("event_id")], F.to_date("ts"), "frame", total="n")
    return out.select(
        F.col("user_id").alias("swing_id"), "event_id", "ts", "event_type", "props",
        F.col("value").alias("v"), F.col("frame").cast("int").alias("frame"), F.col("n").cast("int").alias("n"))


#: Frames that lie together where rows are dealt by frame.
FRAMES_TOGETHER = 16384


def dealt_by_frame(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Rows of `frames` partitioned by (swing_id, frame), in parts of one size however many there are.

    What is made of a frame and grouped or joined by it afterwards needs no other shuffle, and fits the memory of a task.
    """
    many = -(-table(spark, sf_dir, "events").count() // FRAMES_TOGETHER)
    return df.repartition(max(spark.sparkContext.defaultParallelism, many), "swing_id", "frame")


def pose(spark: SparkSession, sf_dir: str, by_frame: bool = False) -> DataFrame:
    """Pose rows; `by_frame` deals the frames out by (swing_id, frame) before they become rows per joint."""
    f, n, e, j = F.col("frame"), F.col("n"), F.col("event_id"), F.col("j")
    ph = F.least(F.greatest(f - 12, F.lit(0)), n - 24)
    df = frames(spark, sf_dir).select("swing_id", "event_id", "frame", "n")
    if by_frame:
        df = dealt_by_frame(spark, sf_dir, df)
    df = df.select(
        "*", ph.alias("ph"),
        F.when((f > 12) & (f < n - 12), _d(0.2)).otherwise(_d(0.02)).alias("amp"))
    df = df.withColumn("q", F.abs((F.col("ph") + 10) % 40 - 20) - 10)
    df = df.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(16))))
    side = F.when(j < 5, 0).when(j % 2 == 1, 1).otherwise(-1)
    wide = (F.when(j < 5, 0).when(j < 7, 60).when(j < 9, 70).when(j < 11, 50)
            .when(j < 13, 40).when(j < 15, 60).otherwise(80))
    q, amp = F.col("q"), F.col("amp")
    x0 = (F.lit(960) + side * wide + F.when(j.isin(9, 10), 10 * q).when(j < 7, q).otherwise(0)
          + ((e * 7 + j * 13) % 11 - 5) * amp + F.when((e + j) % 97 == 0, 300).otherwise(0))
    y0 = F.lit(200) + 40 * j + ((e * 5 + j * 3) % 11 - 5) * amp
    turn = F.when(j.isin(5, 6), _d(0.012)).when(j.isin(11, 12), _d(0.004)).otherwise(_d(0))
    z0 = _d(2.5) + side * q * turn
    df = df.select("swing_id", "frame", "j", "event_id", "n", x0.alias("x0"), y0.alias("y0"), z0.alias("z0"),
                   ((e * 17 + j * 29) % 23 == 0).alias("miss"))
    miss = F.col("miss")
    return df.select(
        "swing_id", "frame", F.lit(0).alias("person_idx"), F.col("j").alias("joint_idx"), "event_id", "n",
        F.when(miss, _d(0)).otherwise(F.col("x0")).alias("x"),
        F.when(miss, _d(0)).otherwise(F.col("y0")).alias("y"),
        F.when(miss, _d(0)).otherwise(_d(0.3) + ((e + 11 * j) % 70).cast("double") / 100).alias("conf"),
        F.when(~miss, (F.col("x0") - 960) / _d(400)).alias("X3"),
        F.when(~miss, (F.col("y0") - 540) / _d(400)).alias("Y3"),
        F.when(~miss, F.col("z0")).alias("Z3"))


def emb_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("label").cast("int").alias("label"),
        F.slice("embedding", 1, 32).alias("vec"))


def emb_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 11 != 0).select(
        F.col("vec_id").cast("string").alias("id"), F.slice("embedding", 33, 32).alias("vec"))


def emb_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four clips of 16 values per vector."""
    c = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("label").cast("int").alias("label"),
        "embedding", c.alias("clip")).select(
        "id", "label", "clip", F.slice("embedding", F.col("clip") * 16 + 1, F.lit(16)).alias("vec"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four clips of five class scores per vector; some predictions are missing."""
    c = F.explode(F.sequence(F.lit(0), F.lit(3)))
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", c.alias("clip")).select(
        F.col("vec_id").cast("string").alias("id"), "vec_id", "clip", (F.col("label") % 5).cast("int").alias("gt"),
        F.transform(F.slice("embedding", F.col("clip") * 5 + 1, F.lit(5)), lambda x: x.cast("double")).alias("scores"))
    best = F.array_position("scores", F.array_max("scores")).cast("int") - 1
    return df.select("id", "clip", "gt", F.when(F.col("vec_id") % 17 != 0, best).alias("pred"), "scores")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, doc = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return lab.join(doc.select("doc_id", "source", "lang", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), "source", "lang", "n_chars",
        (F.col("doc_id") % 5).cast("int").alias("label5"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered label files of each swing, some with gaps."""
    f, u = F.col("frame"), F.col("swing_id")
    no = f + F.when(u % 3 == 0, 10 * F.floor(f / 15)).when(u % 3 == 1, F.floor(f / 20)).otherwise(0)
    df = frames(spark, sf_dir).select(
        "swing_id", "event_id", "frame", F.concat(F.lit("20240101_G_"), u.cast("string")).alias("prefix"),
        no.cast("int").alias("frame_no"))
    name = F.concat("prefix", F.lit("_"), F.lpad(F.col("frame_no").cast("string"), 4, "0"))
    return df.select("*", name.alias("stem"),
                     F.concat(F.lit("/data/Amateur/[라벨]set/"), F.col("prefix"), F.lit("/"), name, F.lit(".json")).alias("path"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene cut times per video with the video duration."""
    return frames(spark, sf_dir).select(
        F.col("swing_id").alias("video"), F.col("frame").alias("seq"),
        (F.col("frame") + ((F.col("event_id") * 37) % 90) / _d(100)).alias("cut"),
        (F.col("n") + _d(0.5)).alias("duration"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections per sampled frame; two people stand apart in x."""
    li = table(spark, sf_dir, "lineitem")
    person = F.col("l_partkey") % 2
    x1 = F.col("l_quantity") * 4 + person * 900 - 40
    y1 = F.col("l_suppkey") % 50 + F.col("l_discount") * 100
    return li.select(
        F.col("l_orderkey").alias("video"), F.col("l_linenumber").alias("frame"), person.cast("int").alias("person"),
        x1.alias("x1"), y1.cast("double").alias("y1"),
        (x1 + 150 + F.col("l_suppkey") % 13).alias("x2"), (y1 + 400 + F.col("l_partkey") % 17).cast("double").alias("y2"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested label document (as JSON text) per frame file."""
    e = F.col("event_id")
    # Spellings of the evaluation field that a scan meets.
    spell = F.element_at(F.array(*[F.lit(s) for s in ("best", "Good", "normal", "BAD", "worst", "", "other")]),
                         (e % 7 + 1).cast("int"))
    person = F.struct(
        F.lit("person").alias("class"),
        F.when(e % 5 == 0, F.lit("[]")).when(
            e % 2 == 0, F.concat(F.lit("["), (e % 100).cast("string"), F.lit(","), (e % 70).cast("string"), F.lit(",2,"),
                                 ((e + 3) % 100).cast("string"), F.lit(","), ((e + 9) % 70).cast("string"), F.lit(",2]")))
        .otherwise(F.concat(F.lit("[["), (e % 100).cast("string"), F.lit(","), (e % 70).cast("string"), F.lit("],["),
                            ((e + 3) % 100).cast("string"), F.lit(","), ((e + 9) % 70).cast("string"), F.lit("]]"))).alias("points"))
    doc = F.struct(
        F.struct(F.concat("stem", F.lit(".json")).alias("filename"), F.lit("20240101").alias("date"),
                 F.col("event_type").alias("action"), spell.alias("evaluation"),
                 F.when(e % 4 != 0, F.lit("hit")).alias("hitting")).alias("image"),
        F.struct(F.when(e % 3 == 0, F.lit("day")).otherwise(F.lit("night")).alias("time"),
                 F.lit("range").alias("location")).alias("environment"),
        F.struct(F.when(e % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("sex"),
                 F.when(e % 6 != 0, (20 + e % 30).cast("string")).alias("age")).alias("actor"),
        F.array(F.when(e % 9 != 0, person)).alias("annotations"))
    f = files(spark, sf_dir).join(frames(spark, sf_dir).select("event_id", "event_type"), "event_id")
    return f.select("event_id", "swing_id", "path", F.to_json(doc).alias("doc"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_of(table(spark, sf_dir, "events"))


def jobs_of(ev: DataFrame) -> DataFrame:
    """Status events of upload jobs; each user has seven."""
    # Stage of a job that stands for each event type.
    stage = (F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "PROCESSING")
             .when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "click", "GETTING")
             .otherwise("FAILED"))
    return ev.select(
        F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("job_id"),
        F.col("user_id").cast("string").alias("owner"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        stage.alias("status"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("results/"), F.col("event_id").cast("string"), F.lit(".json")))
        .alias("result_path"))
