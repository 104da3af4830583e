"""Causal filters on live frames with keyed state: one state per series, held by Spark's state store.

A series keeps its last output, its speed and the time of its last frame. Series are dealt into buckets by a hash, and a bucket is
one key of the stream that maps its series to their states: calls, timers and result batches are paid by bucket. A micro-batch reads
and writes the states of the series that it holds frames of; a bucket's event-time timer looks for idle series and removes theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kinetra.operators.smooth import euro_step

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Keys that the series of a stream are dealt into; a checkpoint holds on to their number.
BUCKETS = 4096
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WHOLE, _REAL = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


class LiveFilter(StatefulProcessor):
    """Filters the frames of each series in order of `order` (its first column is the time) from where the last batch left off."""

    def __init__(self, packed: list[str], keys: list[int], key_schema: str, order: list[int], idle_ms: int, method: str, alpha: float, dt: float,
                 min_cutoff: float, beta: float, d_cutoff: float):
        self.packed, self.keys, self.key_schema, self.order, self.idle_ms = packed, keys, key_schema, order, idle_ms
        self.method, self.alpha, self.euro = method, alpha, (dt, min_cutoff, beta, d_cutoff)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", self.key_schema, "y double, speed double, frames long, at long")

    def step(self, x: float, state: tuple[float, float] | None) -> tuple[float, float]:
        if self.method == "oneeuro":
            return euro_step(x, state, *self.euro)
        return (x if state is None else self.alpha * x + (1 - self.alpha) * state[0]), 0.0

    def due_at(self, times: list[int]) -> None:
        """Sets the bucket's timer to the first of these times and the one that it has."""
        was = list(self.handle.listTimers())
        first = min([*was, *times], default=None)
        for timer in was:
            if timer != first:
                self.handle.deleteTimer(timer)
        if first is not None and first not in was:
            self.handle.registerTimer(first)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns: dict[str, list] = {n: [] for n in (*self.packed, "packed_gone", "packed_x", "packed_at")}
        for pdf in rows:
            for n, held in columns.items():
                held.extend(pdf[n].tolist())
        gone, xs, ats = columns["packed_gone"], columns["packed_x"], columns["packed_at"]

        def marked(places: list[int]) -> list[list]:
            """(is there, value) of these columns by row: nulls first, and all alike."""
            return [[(g[p] == "0", v if g[p] == "0" else None) for g, v in zip(gone, columns[self.packed[p]])] for p in places]

        series, due = {}, []
        for i, own in enumerate(zip(*marked(self.keys))):
            series.setdefault(own, []).append(i)
        by = list(zip(*marked(self.order)))
        place, filtered, seen, numbers = [], [], [], []
        for own, rows_of in series.items():
            own = tuple(v for _, v in own)
            y, speed, frames, at = self.last.getValue(own) or (None, None, 0, None)
            state = None if y is None else (y, speed)
            for i in sorted(rows_of, key=by.__getitem__):
                now, x = ats[i], xs[i]
                if by[i][0][0]:
                    # What the timer does between batches is done here inside one, so batches may be cut anywhere.
                    if at is not None and now >= at + self.idle_ms:
                        state, frames = None, 0
                    at = now
                if x is not None and x == x:
                    state = self.step(x, state)
                frames += 1
                place.append(i)
                filtered.append(state[0] if state else None)
                seen.append(state is not None)
                numbers.append(frames)
            self.last.updateValue(own, (*(state or (None, None)), frames, at))
            if at is not None:
                due.append(at + self.idle_ms)
        self.due_at(due)
        out = {n: [columns[n][i] for i in place] for n in (*self.packed, "packed_gone")}
        yield pd.DataFrame({**out, "filtered": pd.Series(filtered, dtype="float64"), "seen": seen, "frames": numbers})

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, gone, due = timerValues.getCurrentWatermarkInMs(), [], []
        for own, (_, _, _, at) in self.last.iterator():
            if at is not None and at + self.idle_ms <= now:
                gone.append(own)
            elif at is not None:
                due.append(at + self.idle_ms)
        for own in gone:
            self.last.removeKey(own)
        if due:
            self.handle.registerTimer(min(due))
        return iter(())


def _packed(name: str, kind: str, place: int) -> tuple[Column, str, Column]:
    """A column as pandas holds it without loss, the type of that, and `packed_<place>` turned back; nulls are marked beside it."""
    col, back = F.col(f"`{name}`"), F.col(f"packed_{place}")
    if kind in _WHOLE:
        return F.coalesce(col, F.lit(0)).cast("bigint"), "bigint", back.cast(kind)
    if kind in _REAL:
        return F.coalesce(col.cast("double"), F.lit(0.0)), "double", F.coalesce(back, F.lit(float("nan"))).cast(kind)
    if kind == "timestamp":
        return F.coalesce(F.unix_micros(col), F.lit(0)), "bigint", F.timestamp_micros(back)
    if kind == "timestamp_ntz":
        return col.cast("string"), "string", back.cast(kind)
    if kind.startswith(("array", "map", "struct")):
        return F.to_json(F.struct(col.alias("v"))), "string", F.from_json(back, f"v {kind}")["v"]
    return col, kind, back


def keyed_filter(stream: DataFrame, keys: list[str], order: list[str], value: str, method: str = "ema", alpha: float = 0.2, fps: float = 30.0,
                 min_cutoff: float = 1.0, beta: float = 0.007, d_cutoff: float = 1.0, idle: int = 3600, late: str = "0 seconds") -> DataFrame:
    """The rows of a stream of frames with `filtered`, and `frames`, the number of frames of the series since its state began.

    The first column of `order` is the event time, a timestamp. Frames of a series come in order from batch to batch; inside
    one they are sorted. Missing values (null, NaN) repeat the last output. A series without frames for `idle` seconds of event time is
    forgotten and starts afresh. Frames behind the watermark (`late`) are dropped, as streams do. A bucket's frames of one
    micro-batch are in one task, so the size of a batch bounds them.
    """
    if method not in ("ema", "oneeuro"):
        raise ValueError(f"unknown method {method!r}")
    if method == "ema" and not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    names, types = stream.columns, dict(stream.dtypes)
    held = [_packed(n, t, i) for i, (n, t) in enumerate(types.items())]
    # A series is known by the packed forms of its keys, which are those of the state too.
    step = LiveFilter([f"packed_{i}" for i in range(len(names))], [names.index(n) for n in keys], ", ".join(f"`{n}` {held[names.index(n)][1]}" for n in keys),
                      [names.index(n) for n in order], int(idle * 1000), method, float(alpha), 1.0 / float(fps if fps and fps > 0 else 30),
                      min_cutoff, beta, d_cutoff)
    src = stream.withWatermark(order[0], late).select(
        F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("packed_bucket"), order[0], *[h[0].alias(f"packed_{i}") for i, h in enumerate(held)],
        F.concat(*[F.col(f"`{n}`").isNull().cast("int").cast("string") for n in names]).alias("packed_gone"),
        F.col(f"`{value}`").cast("double").alias("packed_x"),
        F.coalesce(F.unix_millis(F.col(f"`{order[0]}`").cast("timestamp")), F.lit(0)).alias("packed_at"))
    schema = ", ".join([*[f"packed_{i} {h[1]}" for i, h in enumerate(held)], "packed_gone string, filtered double, seen boolean, frames long"])
    out = src.groupBy("packed_bucket").transformWithStateInPandas(step, schema, "Append", "EventTime")
    return out.select(*[F.when(F.substring("packed_gone", i + 1, 1) == "0", held[i][2]).alias(n) for i, n in enumerate(names)],
                      F.when(F.col("seen"), F.coalesce("filtered", F.lit(float("nan")))).alias("filtered"), "frames")


def start(spark: SparkSession, stream: DataFrame, folder: str) -> StreamingQuery:
    """Writes a stream with keyed state to <folder>/rows; its state is below <folder>/log.

    Keyed state needs the RocksDB state store, which the query takes along; the session keeps its own setting.
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log")
                .outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(_PROVIDER, before)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The states that the store holds now: the keys, y, speed and frames of each series."""
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/log")
    return held.select("user_map_key.*", "user_map_value.y", "user_map_value.speed", "user_map_value.frames")
