"""Run a stream over what is there and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetra.operators.sequence import shared_folder

#: Rows of a file of a staged table.
FILE_ROWS = 1 << 18


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir))


def run_complete(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The last full state of an aggregated stream."""
    out = scratch(spark)

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/rows")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def staged(df: DataFrame, slices: int, by: str, closing: DataFrame | None = None) -> DataFrame:
    """`df` as a stream of `slices` micro-batches that follow the range of `by`, a time or a number, written to a folder of their own.

    Every slice has the same number of files, which grows with the table, so that tasks share its writing; a sparse one is filled up with
    empty files. `closing` rows, far behind in time, make one more batch: they move the watermark past everything that waits.
    """
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    low, high, rows = df.agg(F.min(by), F.max(by), F.count(by)).first()
    files = max(1, -(-rows // (slices * FILE_ROWS)))

    def write(part: DataFrame, k: int) -> None:
        part.repartition(files).write.parquet(f"{folder}/slice={k}")
        for _ in range(files - len(spark.read.parquet(f"{folder}/slice={k}").inputFiles())):
            df.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/slice={k}")

    for k in range(slices if low is not None else 0):
        a, b = (low + (high - low) * i / slices for i in (k, k + 1))
        write(df.filter((F.col(by) >= F.lit(a)) & (F.col(by) < F.lit(b)) if k < slices - 1 else F.col(by) >= F.lit(a)), k)
    if low is None or closing is not None:
        write(df.limit(0) if closing is None else closing, slices)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(folder)


def run_append(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows that a stream appends until its source is read."""
    out = scratch(spark)
    (stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
