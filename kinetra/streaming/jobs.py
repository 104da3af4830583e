"""Job status, waiting for results and ingest; each function takes a batch or a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kinetra.operators.sequence import Sequence, number_rows

# Order of the stages of a job.
STAGES = ("PENDING", "PROCESSING", "COMPLETED", "GETTING")


def latest_status(events: DataFrame) -> DataFrame:
    """Current status per job and the last result path that was given; streams use update or
    complete mode."""
    at = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        F.max_by("result_path", F.when(F.col("result_path").isNotNull(), at)).alias("result_path"),
        F.count(F.lit(1)).alias("updates"))


def irregular_steps(events: DataFrame, slice_: Column) -> DataFrame:
    """Updates that neither stay, advance by one stage nor fail: (job_id, event_id, before, status).

    A job starts at the first stage, also after a failure. `slice_` is a coarse time (a day).
    """
    src = number_rows(events, ["job_id"], [F.col("ts"), F.col("event_id")], slice_, "_k")
    seq = Sequence(("job_id",), "_k")
    laid = seq.lay_out(src, before=1)
    laid = seq.done(laid.withColumn("before", F.lag("status").over(seq.window())))
    place = F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))])
    now, was = F.try_element_at(place, F.col("status")), F.try_element_at(place, F.col("before"))
    first = F.col("before").isNull()
    fine = F.when(F.col("status") == "FAILED", ~first).when(first, F.col("status") == STAGES[0]) \
        .otherwise(F.coalesce((now - was).isin(0, 1), F.col("status") == STAGES[0]))
    return laid.filter(~fine).select("job_id", "event_id", "before", "status")


def wait_for_both(first: DataFrame, second: DataFrame, seconds: int = 30, late: str = "10 minutes") -> DataFrame:
    """Each first result with the second that arrives within the time, else marked partial.

    first(job_id, ts, ..); second(job_id, ts, payload). On streams the partial rows come once the
    watermark has passed the time.
    """
    a = first.withColumnRenamed("ts", "first_ts")
    b = second.select(F.col("job_id").alias("_job"), F.col("ts").alias("second_ts"), "payload")
    if first.isStreaming:
        a, b = a.withWatermark("first_ts", late), b.withWatermark("second_ts", late)
    cond = (F.col("job_id") == F.col("_job")) & (F.col("second_ts") >= F.col("first_ts")) & (
        F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    out = a.join(b, cond, "left_outer").drop("_job")
    return out.withColumn("state", F.when(F.col("payload").isNotNull(), "complete").otherwise("partial"))


def notify_once(events: DataFrame, owners: DataFrame, late: str = "40 days") -> DataFrame:
    """One row per completed job whose sender owns it."""
    done = events.filter(F.col("status") == "COMPLETED")
    done = done.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id"]) if events.isStreaming \
        else done.dropDuplicates(["job_id"])
    return done.join(owners.select("job_id", F.col("owner").alias("_o")), "job_id").filter(F.col("owner") == F.col("_o")).select("job_id", "owner")


def backfill(frames: DataFrame, results: DataFrame, deadline_s: int = 60, late: str = "10 minutes") -> DataFrame:
    """Every frame row of a request takes the result that arrives before the deadline; others keep NULL.

    frames(request_id, ts, ..); results(request_id, ts, result).
    """
    a = frames.withColumnRenamed("ts", "frame_ts")
    b = results.select(F.col("request_id").alias("_r"), F.col("ts").alias("result_ts"), "result")
    if frames.isStreaming:
        a, b = a.withWatermark("frame_ts", late), b.withWatermark("result_ts", late)
    cond = (F.col("request_id") == F.col("_r")) & (F.col("result_ts") >= F.col("frame_ts")) & (
        F.col("result_ts") <= F.col("frame_ts") + F.expr(f"INTERVAL {int(deadline_s)} SECONDS"))
    return a.join(b, cond, "left_outer").drop("_r", "result_ts")


def ingest(spark: SparkSession, source: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, manifest: str,
           checkpoint: str, path: str = "video_path") -> StreamingQuery:
    """Process new files once: rows go to `target`, one manifest row per file to `manifest`.

    Files whose processing fails are recorded and come back with the next run of `resume`;
    `process` returns its rows with a `status` (done | failed) and `error` column.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        out = process(df).withColumn("epoch", F.lit(epoch)).persist()
        try:
            # Overwriting the batch's own partition makes a repeated batch harmless.
            out.filter("status = 'done'").drop("status", "error").write.mode("overwrite").parquet(f"{target}/batch={epoch}")
            out.select(path, "status", "error", F.current_timestamp().alias("ts")).distinct() \
                .write.mode("overwrite").parquet(f"{manifest}/batch={epoch}")
        finally:
            out.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
