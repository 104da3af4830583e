"""Causal filters on live frames: between micro-batches only the last state per series is kept.

A micro-batch is filtered with the batch operators, started from the stored states, so a series that
fills most of a batch is spread over tasks like any long sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kinetra.operators.recurrence import affine_scan, step
from kinetra.operators.sequence import Sequence, number_rows
from kinetra.operators.smooth import euro_step


def _ema(rows: DataFrame, seq: Sequence, value: str, alpha: float) -> DataFrame:
    """Rows carry the state before the batch in _y; the first row of a series takes it up."""
    x, was = F.col(value), F.when(F.col(seq.order) == 0, F.col("_y"))
    start = F.when(x.isNull(), was).when(was.isNull(), x).otherwise(alpha * x + (1 - alpha) * was)
    move = step(F.when(x.isNull(), 1.0).otherwise(1 - alpha), F.coalesce(alpha * x, F.lit(0.0)), start)
    return affine_scan(rows, seq, {"filtered": move}).withColumn("_speed_now", F.lit(0.0))


def _one_euro(rows: DataFrame, seq: Sequence, value: str, dt: float, min_cutoff: float, beta: float, d_cutoff: float) -> DataFrame:
    """Each series is one chain by definition: walked in sorted order with constant memory."""
    keys = list(seq.keys)

    def walk(batches: Iterator) -> Iterator:
        current, state = None, None
        for pdf in batches:
            ys, speeds = [], []
            for *key, x, y0, s0 in pdf[[*keys, value, "_y", "_speed"]].itertuples(index=False, name=None):
                if key != current:
                    current, state = key, None if y0 is None or y0 != y0 else (y0, s0)
                if x is not None and x == x:
                    state = euro_step(x, state, dt, min_cutoff, beta, d_cutoff)
                ys.append(state[0] if state else None)
                speeds.append(state[1] if state else None)
            pdf["filtered"], pdf["_speed_now"] = ys, speeds
            yield pdf

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", filtered double, _speed_now double"
    return rows.repartition(*keys).sortWithinPartitions(*keys, seq.order).mapInPandas(walk, schema)


def filter_batch(
    rows: DataFrame, before: DataFrame | None, keys: list[str], order: list[str], slice_: Column, value: str,
    method: str = "ema", alpha: float = 0.2, fps: float = 30.0, min_cutoff: float = 1.0, beta: float = 0.007, d_cutoff: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(rows with `filtered`, state after them) of one micro-batch; `before` is the last state."""
    if method not in ("ema", "oneeuro"):
        raise ValueError(f"unknown method {method!r}")
    seq = Sequence(tuple(keys), "_k")
    src = number_rows(rows, keys, [F.col(c) for c in order], slice_, "_k")
    if before is None:
        src = src.withColumns({"_y": F.lit(None).cast("double"), "_speed": F.lit(None).cast("double")})
    else:
        src = src.join(before.select(*keys, F.col("y").alias("_y"), F.col("speed").alias("_speed")), keys, "left")
    out = _ema(src, seq, value, alpha) if method == "ema" else \
        _one_euro(src, seq, value, 1.0 / float(fps if fps and fps > 0 else 30), min_cutoff, beta, d_cutoff)
    now = out.groupBy(*keys).agg(F.max_by(F.struct(F.col("filtered").alias("y"), F.col("_speed_now").alias("speed")), "_k").alias("_s"))
    now = now.select(*keys, "_s.y", "_s.speed")
    if before is not None:
        now = now.unionByName(before.join(now.select(*keys), keys, "left_anti"))
    return out.drop("_k", "_y", "_speed", "_speed_now"), now


def live_filter(
    spark: SparkSession, stream: DataFrame, folder: str, keys: list[str], order: list[str], slice_: Column, value: str, **options,
) -> StreamingQuery:
    """Filter a stream of frames that arrive in order: rows below <folder>/rows, states per batch.

    A repeated batch overwrites its own output and starts from the same state.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        before = spark.read.parquet(f"{folder}/states/{epoch - 1}") if epoch > 0 else None
        rows, state = filter_batch(df, before, keys, order, slice_, value, **options)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={epoch}")
        state.write.mode("overwrite").parquet(f"{folder}/states/{epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
