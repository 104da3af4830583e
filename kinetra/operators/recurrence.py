"""First-order recurrences y[t] = a[t] * y[t-1] + b[t] over sequences of any length.

Each row holds a map (a, b, s): `s` is the result where no earlier state exists (NULL keeps the
state empty). Maps compose, so every block of rows is folded on its own; block maps are folded again
to give each block its starting state. No task ever holds more than one block of a sequence, and two
levels of blocks leave n / block^2 maps per sequence for the last fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetra.operators.sequence import BLK, CORE, Sequence

FOLD_BLOCK = 512


def step(a: Column, b: Column, start: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), start.cast("double").alias("s"))


def _apply(m: Column, y: Column) -> Column:
    return F.when(y.isNull(), m["s"]).otherwise(m["a"] * y + m["b"])


def _compose(first: Column, then: Column) -> Column:
    return F.struct((then["a"] * first["a"]).alias("a"), (then["a"] * first["b"] + then["b"]).alias("b"),
                    _apply(then, first["s"]).alias("s"))


def _whole(rows: Column, name: str) -> Column:
    """The map of a whole sorted block."""
    nothing = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("s"))
    return F.aggregate(rows, nothing, lambda acc, r: _compose(acc, r[name]))


def _states(rows: Column, name: str, start: Column) -> Column:
    """The state after each row of a sorted block."""
    empty = F.struct(start.alias("y"), F.array().cast("array<double>").alias("out"))

    def push(acc: Column, r: Column) -> Column:
        y = _apply(r[name], acc["y"])
        return F.struct(y.alias("y"), F.concat(acc["out"], F.array(y)).alias("out"))

    return F.aggregate(rows, empty, push, lambda acc: acc["out"])


def affine_scan(
    df: DataFrame, seq: Sequence, steps: dict[str, Column], block: int | None = None, levels: int = 2,
) -> DataFrame:
    """Add one state column per entry of `steps` (see `step`)."""
    block = block or min(FOLD_BLOCK, seq.block)
    if seq.longest is not None and seq.longest <= block:
        levels = 0
    cols = [c for c in df.columns if c not in (BLK, CORE)]
    keys = list(seq.keys)
    rest = [c for c in cols if c not in (*keys, seq.order)]
    row = F.struct(seq.order, *rest, *[e.alias(f"_m_{n}") for n, e in steps.items()])
    # At the last level the maps of one sequence, few by construction, share one array.
    own = F.floor(F.col(seq.order).cast("long") / block) if levels > 0 else F.lit(0).cast("long")
    blocks = df.withColumn(BLK, own).groupBy(*keys, BLK).agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    starts = None
    if levels > 0:
        more = F.lead(BLK).over(Window.partitionBy(*keys).orderBy(BLK)).isNotNull()
        maps = blocks.select(*keys, F.col(BLK).alias("_at"), more.alias("_more"),
                             *[_whole(F.col("_rows"), f"_m_{n}").alias(f"_w_{n}") for n in steps])
        ends = affine_scan(maps, Sequence(seq.keys, "_at", block), {f"_y_{n}": F.col(f"_w_{n}") for n in steps},
                           block, levels - 1)
        # A sequence of one block starts no later one: the join side is then empty and AQE drops it.
        starts = ends.filter("_more").select(*keys, (F.col("_at") + 1).alias(BLK), *[f"_y_{n}" for n in steps])
    if starts is not None:
        blocks = blocks.join(starts, [*keys, BLK], "left")
    out = blocks.select(
        *keys, "_rows",
        *[_states(F.col("_rows"), f"_m_{n}",
                  F.col(f"_y_{n}") if starts is not None else F.lit(None).cast("double")).alias(f"_s_{n}")
          for n in steps])
    out = out.select(*keys, F.inline(F.arrays_zip("_rows", *[f"_s_{n}" for n in steps])))
    return out.select(*[F.col(c) if c in keys else F.col(f"_rows.{c}").alias(c) for c in cols],
                      *[F.col(f"_s_{n}").alias(n) for n in steps])

