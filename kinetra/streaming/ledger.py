"""Ingest that lands every file exactly once, with a ledger of batches that count only when they are committed.

Below one folder: `rows/batch=<name>` holds what a batch made, `entries/batch=<name>` its files with their status, and
`commits/batch=<name>` the marker, which is written last. Readers look at committed batches only, so a batch that was cut short leaves nothing
behind: Spark repeats it under the same name, and it overwrites what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def _read(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame | None:
    """A table of the ledger; None, or empty where a schema is given, before its first batch."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None if schema is None else spark.createDataFrame([], schema)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """batch, run, epoch, files, failed of every committed batch."""
    return _read(spark, f"{folder}/commits", "batch string, run string, epoch long, files long, failed long").withColumn("batch", F.col("batch").cast("string"))


def entries(spark: SparkSession, folder: str, path: str = "video_path") -> DataFrame | None:
    """batch, path, status (done, failed), error and rows of every file in a committed batch; None before the first."""
    found = _read(spark, f"{folder}/entries")
    return None if found is None else found.join(committed(spark, folder).select("batch"), "batch", "left_semi")


def landed(spark: SparkSession, folder: str, path: str = "video_path") -> DataFrame | None:
    """The rows of files that are done, each from the one batch that finished it; None before the first."""
    rows, files = _read(spark, f"{folder}/rows"), entries(spark, folder, path)
    if rows is None or files is None:
        return None
    return rows.join(files.filter("status = 'done'").select("batch", path), ["batch", path], "left_semi").drop("batch", "status", "error")


def land(df: DataFrame, run: str, epoch: int, process: Callable[[DataFrame], DataFrame], folder: str, path: str = "video_path",
         commit: bool = True) -> None:
    """One batch of `ingest`: files that no committed batch has done are processed, written, listed and committed, in this order.

    A batch that is committed already is left alone. `commit=False` stops before the marker, as a lost driver would.
    """
    spark, name = df.sparkSession, f"{run}-{epoch}"
    if not committed(spark, folder).filter(F.col("batch") == name).isEmpty():
        return
    files = entries(spark, folder, path)
    todo = df if files is None else df.join(files.filter("status = 'done'").select(path), path, "left_anti")
    process(todo).write.mode("overwrite").parquet(f"{folder}/rows/batch={name}")
    # What is listed is read back from what was written: a file counts as failed if any of its rows says so.
    made = spark.read.parquet(f"{folder}/rows/batch={name}")
    bad = F.count(F.when(F.col("status") != "done", 1))
    made.groupBy(path).agg(F.when(bad > 0, "failed").otherwise("done").alias("status"), F.max("error").alias("error"), F.count(F.lit(1)).alias("rows")) \
        .write.mode("overwrite").parquet(f"{folder}/entries/batch={name}")
    if commit:
        listed = spark.read.parquet(f"{folder}/entries/batch={name}")
        listed.agg(F.lit(run).alias("run"), F.lit(epoch).cast("long").alias("epoch"), F.count(F.lit(1)).alias("files"),
                   F.count(F.when(F.col("status") == "failed", 1)).alias("failed")) \
            .coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={name}")


def ingest(source: DataFrame, process: Callable[[DataFrame], DataFrame], folder: str, run: str, path: str = "video_path") -> StreamingQuery:
    """Lands a stream of files (rows with a `path`) below `folder`, each file once over all runs.

    `process` returns its rows with the path, a `status` (done | failed) and an `error`. A run keeps its place in `folder`/log/<run>:
    started again, it goes on where it stopped. A run of another name reads the source from the start, passes over what is done
    and tries failed files again. Runs take turns; two at a time may both take a file.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        land(df, run, epoch, process, folder, path)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/log/{run}").trigger(availableNow=True).start()
