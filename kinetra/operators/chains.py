"""Chains whose every step depends on the last output, walked in blocks that guess the state they start from.

A filter that forgets its past reaches the same state from any start after enough steps. So each block of a sequence walks a
warm-up stretch before its first row, from an empty state, and all blocks are walked at once. Where the state that a block
guessed isn't, to the last bit, the one the block before it ended in, the block is walked again from that one, and so on until all borders
agree. The result is that of the plain chain, whatever the guesses were worth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetra.operators.sequence import BLK, CORE, Sequence, cut_lineage

#: Rows of a block, and rows before it that it warms up on.
BLOCK, WARM = 2048, 512
#: Values in one matrix of chains.
_CELLS = 1 << 21


def euro_walk(x: np.ndarray, y: np.ndarray, speed: np.ndarray, has: np.ndarray, dt: float, min_cutoff: float, beta: float,
              d_cutoff: float) -> Iterator[None]:
    """Advances the states (y, speed, has; changed in place) of many chains by one column of `x` at a time; NaN is a missing value."""
    def gain(cutoff):
        return 1.0 / (1.0 + 1.0 / (2.0 * math.pi * cutoff) / dt)

    ad = gain(d_cutoff)
    with np.errstate(all="ignore"):
        for t in range(x.shape[1]):
            v = x[:, t]
            ok = ~np.isnan(v)
            fast = ad * (v - y) + (1 - ad) * speed
            a = gain(min_cutoff + beta * np.abs(fast))
            step, first = ok & has, ok & ~has
            np.copyto(y, a * v + (1 - a) * y, where=step)
            np.copyto(speed, fast, where=step)
            np.copyto(y, v, where=first)
            speed[first] = 0.0
            has |= ok
            yield


def _matrix(lists: pa.ListArray, warm: np.ndarray, rows: slice) -> tuple[np.ndarray, int, np.ndarray]:
    """Chains as rows, their first rows after the warm-up in one column; that column; and how many rows follow it."""
    offsets = np.asarray(lists.offsets)
    values = lists.values.to_numpy(zero_copy_only=False).astype(float)
    begin, end = offsets[:-1][rows], offsets[1:][rows]
    before = warm[rows]
    after = end - begin - before
    lead = int(before.max(initial=0))
    out = np.full((len(begin), lead + int(after.max(initial=0))), np.nan)
    size = end - begin
    row = np.repeat(np.arange(len(begin)), size)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[row, within + np.repeat(lead - before, size)] = values[np.repeat(begin, size) + within]
    return out, lead, after


def _walker(cols: list[str], given: bool, names: list[str], euro: tuple[float, float, float, float]):
    """Walks the blocks of record batches; with `given`, from the states that they carry and without their warm-up."""
    def states(y: np.ndarray, speed: np.ndarray, has: np.ndarray) -> list[pa.Array]:
        return [pa.array(y, mask=~has), pa.array(speed, mask=~has)]

    def chunk(batch: pa.RecordBatch, rows: slice, c: str, warm: np.ndarray) -> list[pa.Array]:
        x, lead, after = _matrix(batch.column(f"_x_{c}"), warm, rows)
        m = len(x)
        y, speed, has = np.zeros(m), np.zeros(m), np.zeros(m, bool)
        if given:
            was = [batch.column(f"_{k}_{c}")[rows].to_numpy(zero_copy_only=False).astype(float) for k in ("py", "ps")]
            x, lead, has = x[:, lead:], 0, ~np.isnan(was[0])
            y, speed = np.where(has, was[0], 0.0), np.where(has, was[1], 0.0)
        walk = euro_walk(x, y, speed, has, *euro)
        for _ in range(lead):
            next(walk)
        start = states(y.copy(), speed.copy(), has.copy())
        ys, known = np.empty((m, x.shape[1] - lead)), np.empty((m, x.shape[1] - lead), bool)
        for t in range(ys.shape[1]):
            next(walk)
            ys[:, t], known[:, t] = y, has
        here = np.arange(ys.shape[1]) < after[:, None]
        out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(after)], pa.int32()), pa.array(ys[here], mask=~known[here]))
        return [*start, *states(y, speed, has), out]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            warm = batch.column("_warm").to_numpy()
            longest = max([1] + [int(np.diff(np.asarray(batch.column(f"_x_{c}").offsets)).max(initial=0)) for c in cols])
            for at in range(0, batch.num_rows, max(1, _CELLS // longest)):
                rows = slice(at, at + max(1, _CELLS // longest))
                made = {f"_{k}_{c}": a for c in cols for k, a in zip(("sy", "ss", "ey", "es", "y"), chunk(batch, rows, c, warm))}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n)[rows] for n in names], names)
    return walk


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _numbers(c: str) -> Column:
    return F.transform("_all", lambda r: r[c].cast("double"))


def euro_chain(df: DataFrame, cols: list[str], seq: Sequence, dt: float, min_cutoff: float, beta: float, d_cutoff: float,
               block: int | None = None, warm: int | None = None) -> DataFrame:
    """`df` with `cols` replaced by the output of the One-Euro filter whose step is taken from the last output."""
    block = block or min(BLOCK, seq.block)
    warm = min(WARM, block) if warm is None else warm
    one_block = seq.longest is not None and seq.longest <= block
    keys, euro = list(seq.keys), (dt, min_cutoff, beta, d_cutoff)
    layout = Sequence(seq.keys, seq.order, block, None)
    laid = layout.lay_out(df.select(*df.columns), 0 if one_block else warm)
    row = F.struct(seq.order, F.col(CORE).alias("_core"), *[c for c in df.columns if c not in (*keys, seq.order)])
    blocks = laid.groupBy(*keys, BLK).agg(F.sort_array(F.collect_list(row)).alias("_all"))
    blocks = blocks.select(*keys, BLK, F.filter("_all", lambda r: r["_core"]).alias("_rows"), F.size(F.filter("_all", lambda r: ~r["_core"])).alias("_warm"),
                           *[_numbers(c).alias(f"_x_{c}") for c in cols])
    # A block past the end of its sequence holds warm-up rows alone.
    blocks = blocks.filter(F.size("_rows") > 0)
    kept = [*keys, BLK, "_rows", "_warm", *[f"_x_{c}" for c in cols]]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields)
    made = [f"_{k}_{c}" for c in cols for k in ("sy", "ss", "ey", "es", "y")]
    schema = fields + "".join(f", `{n}` {'array<double>' if n[:3] == '_y_' else 'double'}" for n in made)

    walked = blocks.mapInArrow(_walker(cols, False, [*kept, *made], euro), schema)
    if not one_block:
        walked = _agreeing(cut_lineage(walked), keys, cols, [*kept, *made], schema, euro)
    out = walked.select(*keys, F.inline(F.arrays_zip("_rows", *[F.col(f"_y_{c}") for c in cols])))
    return out.select(*[F.col(c) if c in keys else F.col(f"_y_{c}").alias(c) if c in cols else F.col(f"_rows.{c}").alias(c) for c in df.columns])


def _agreeing(walked: DataFrame, keys: list[str], cols: list[str], names: list[str], schema: str, euro: tuple) -> DataFrame:
    """Walked blocks after walking again those whose start isn't the end of the block before."""
    ends = [f"_{k}_{c}" for c in cols for k in ("sy", "ss", "ey", "es")]
    borders, redone = walked.select(*keys, BLK, *ends), None
    before = Window.partitionBy(*keys).orderBy(BLK)
    while True:
        wrong = F.lit(False)
        for c in cols:
            wrong = wrong | _differs(f"_sy_{c}", f"_py_{c}") | _differs(f"_ss_{c}", f"_ps_{c}")
        seen = borders.select("*", *[F.lag(f"_e{k}_{c}").over(before).alias(f"_p{k}_{c}") for c in cols for k in "ys"],
                              F.lag(F.lit(True)).over(before).alias("_later"))
        bad = cut_lineage(seen.filter(F.col("_later") & wrong).select(*keys, BLK, *[f"_p{k}_{c}" for c in cols for k in "ys"]))
        if bad.isEmpty():
            return walked if redone is None else walked.join(redone.select(*keys, BLK), [*keys, BLK], "left_anti").unionByName(redone)
        again = walked.join(bad, [*keys, BLK]).mapInArrow(_walker(cols, True, names, euro), schema)
        # A block that is walked from a state starts from that state: the next round compares it with what the block before ends in by then.
        again = cut_lineage(again)
        redone = again if redone is None else cut_lineage(redone.join(again.select(*keys, BLK), [*keys, BLK], "left_anti").unionByName(again))
        borders = walked.select(*keys, BLK, *ends).join(redone.select(*keys, BLK), [*keys, BLK], "left_anti").unionByName(redone.select(*keys, BLK, *ends))
