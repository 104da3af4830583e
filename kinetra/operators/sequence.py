"""Ordered-sequence building blocks that hold up when one key owns most of the rows.

A sequence is a set of key columns plus a dense integer order column (frame 0..n-1).

When the longest sequence has been measured and fits a block, everything is a window over the keys
and one shuffle serves all of them. Otherwise rows are laid out in blocks of consecutive frames and
shuffled on (keys, block), so a long sequence is spread over many tasks:

* neighbourhood operators (lag, rolling medians, convolution, run clean-up) get the rows next to a
  block border copied into the block as a halo;
* running operators (last valid value, running sums) are computed per block and joined with one
  carry row per block;
* per-sequence values come back to the rows by a join on (keys, block), never on a hot key alone.
"""

from __future__ import annotations

import inspect
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BLK = "_blk"
CORE = "_core"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that spark.checkpoint.dir names; in local mode one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a table that several branches read, in the folder the cluster names."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


@dataclass(frozen=True)
class Sequence:
    keys: tuple[str, ...] = ("swing_id",)
    order: str = "frame"
    block: int = 4096
    # Rows of the longest sequence, where known; None takes the path for any length.
    longest: int | None = None
    # Rows are partitioned by the keys already.
    gathered: bool = False

    def on(self, *keys: str) -> Sequence:
        return replace(self, keys=keys)

    def measured(self, df: DataFrame) -> Sequence:
        """One pass over the order column to learn the longest sequence."""
        top = df.agg(F.max(self.order)).first()[0]
        return replace(self, longest=0 if top is None else int(top) + 1)

    @property
    def fits(self) -> bool:
        return self.longest is not None and self.longest <= self.block

    def gather(self, df: DataFrame) -> DataFrame:
        """Rows partitioned by the keys and settled so that Spark knows it: what is grouped by the keys afterwards needs no shuffle.

        For sequences that fit a block; a plan that adapts while it runs would not tell how its rows came to lie.
        """
        spark = df.sparkSession
        before = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return cut_lineage(df.repartition(*self.keys))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", before)

    def parts(self, df: DataFrame) -> list[tuple[DataFrame, Sequence]]:
        """The rows with the layout that suits their own sequences: whole windows where a sequence fits a block, blocks for longer ones.

        One part where nothing was measured or everything fits. Otherwise the table is settled once and cut by the blocks of
        its long sequences, so that not even the join that tells them apart gathers one of them.
        """
        if self.longest is None or self.fits:
            return [(df, self)]
        settled = cut_lineage(df).withColumn(BLK, F.floor(F.col(self.order).cast("long") / self.block))
        tops = settled.groupBy(*self.keys).agg(F.max(BLK).alias("_top")).filter(F.col("_top") > 0)
        beyond = tops.select(*self.keys, F.explode(F.sequence(F.lit(0).cast("long"), "_top")).alias(BLK))
        return [(settled.join(beyond, [*self.keys, BLK], how).drop(BLK), replace(self, longest=longest))
                for how, longest in (("left_anti", self.block), ("left_semi", None))]

    @property
    def part(self) -> list[str]:
        return list(self.keys) if self.fits else [*self.keys, BLK]

    def lay_out(self, df: DataFrame, before: int = 0, after: int = 0, gather: bool = False) -> DataFrame:
        """Assign blocks, copy border rows into the neighbouring blocks, shuffle once.

        Rows of measured sequences need no blocks: windows gather them by key, or `gather` does
        where a finer grouping comes first.
        """
        if self.fits:
            return df.repartition(*self.keys) if gather and not self.gathered else df
        if max(before, after) > self.block:
            raise ValueError("a halo may not be longer than a block")
        pos = F.col(self.order).cast("long")
        own = F.floor(pos / self.block)
        if before == 0 and after == 0:
            out = df.withColumn(BLK, own).withColumn(CORE, F.lit(True))
        else:
            inside = pos - own * self.block
            copies = [F.struct(own.alias(BLK), F.lit(True).alias(CORE))]
            if before:
                copies.append(F.when(inside >= self.block - before,
                                     F.struct((own + 1).alias(BLK), F.lit(False).alias(CORE))))
            if after:
                copies.append(F.when((inside < after) & (own > 0),
                                     F.struct((own - 1).alias(BLK), F.lit(False).alias(CORE))))
            out = df.select("*", F.inline(F.filter(F.array(*copies), lambda c: c.isNotNull())))
        return out.repartition(*self.keys, BLK)

    def window(self, start: int | None = None, end: int | None = None):
        w = Window.partitionBy(*self.part).orderBy(self.order)
        return w if start is None else w.rowsBetween(start, end)

    def core(self, df: DataFrame) -> DataFrame:
        """Drop the halo copies; the rows stay partitioned as laid out."""
        return df.filter(F.col(CORE)).drop(CORE) if CORE in df.columns else df

    def done(self, df: DataFrame) -> DataFrame:
        return self.core(df).drop(BLK)

    def scan(
        self,
        df: DataFrame,
        last: dict[str, Column] | None = None,
        prev: dict[str, Column] | None = None,
        nxt: dict[str, Column] | None = None,
        total: dict[str, Column] | None = None,
        settle: bool = False,
    ) -> DataFrame:
        """Add running columns over whole sequences to laid-out rows; halo copies are dropped.

        last: latest non-null value up to and including the row; prev: the same, row excluded;
        nxt: earliest non-null value from the row on; total: inclusive running sum. In blocks the rows
        are read twice: `settle` materialises them first where they come from another scan.
        """
        df = self.core(df)
        if settle and not self.fits:
            df = cut_lineage(df)
        last, prev, nxt, total = last or {}, prev or {}, nxt or {}, total or {}
        up = self.window(Window.unboundedPreceding, 0)
        before = self.window(Window.unboundedPreceding, -1)
        # Looking ahead is looking back in reverse order: a frame that ends at the last row would be
        # walked again for every row.
        down = Window.partitionBy(*self.part).orderBy(F.col(self.order).desc()).rowsBetween(Window.unboundedPreceding, 0)
        raw = {**last, **prev, **nxt, **total}
        src = df.select("*", *[e.alias(f"_v_{n}") for n, e in raw.items()])

        def v(name: str) -> Column:
            return F.col(f"_v_{name}")

        out = src.select(
            "*",
            *[F.last(v(n), ignorenulls=True).over(up).alias(f"_l_{n}") for n in last],
            *[F.last(v(n), ignorenulls=True).over(before).alias(f"_l_{n}") for n in prev],
            *[F.last(v(n), ignorenulls=True).over(down).alias(f"_l_{n}") for n in nxt],
            *[F.sum(v(n)).over(up).alias(f"_l_{n}") for n in total])
        cols = [F.col(c) for c in df.columns]
        if self.fits:
            cols += [F.col(f"_l_{n}").alias(n) for n in [*last, *prev, *nxt]]
            return out.select(*cols, *[F.coalesce(f"_l_{n}", F.lit(0)).alias(n) for n in total])

        at = F.col(self.order)
        parts = [F.max_by(v(n), F.when(v(n).isNotNull(), at)).alias(f"_c_{n}") for n in [*last, *prev]]
        parts += [F.min_by(v(n), F.when(v(n).isNotNull(), at)).alias(f"_c_{n}") for n in nxt]
        parts += [F.sum(v(n)).alias(f"_c_{n}") for n in total]
        summary = src.groupBy(*self.keys, BLK).agg(*parts)
        over_blocks = Window.partitionBy(*self.keys).orderBy(BLK)
        earlier = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(*self.keys).orderBy(F.col(BLK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in [*last, *prev]]
        carried += [F.last(f"_c_{n}", ignorenulls=True).over(later).alias(f"_c_{n}") for n in nxt]
        carried += [F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in total]
        # Sequences of one block carry nothing: the join side is then empty and AQE drops it.
        carry = summary.select(*self.keys, BLK, *carried).dropna("all", subset=[f"_c_{n}" for n in raw])
        out = out.join(carry, [*self.keys, BLK], "left")
        for n in [*last, *prev, *nxt]:
            cols.append(F.coalesce(f"_l_{n}", f"_c_{n}").alias(n))
        for n in total:
            cols.append((F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n))
        return out.select(*cols)

    def attach(
        self, laid: DataFrame, aggs: dict[str, Column] | None = None,
        quantiles: dict[str, tuple[Column, float]] | None = None,
    ) -> DataFrame:
        """Add aggregates of the whole sequence to each of its laid-out rows; halo copies drop."""
        from kinetra.operators import quantiles as q

        aggs, quantiles = aggs or {}, quantiles or {}
        laid = self.core(laid)
        if self.fits:
            whole = Window.partitionBy(*self.keys)
            return laid.select(
                "*", *[a.over(whole).alias(n) for n, a in aggs.items()],
                *[F.percentile(e, F.lit(p)).over(whole).alias(n) for n, (e, p) in quantiles.items()])
        keys = list(self.keys)
        # The rows feed the summary and the join back: settle them once.
        laid = cut_lineage(laid)
        summary = laid.groupBy(*keys).agg(
            F.min(BLK).alias("_from"), F.max(BLK).alias("_to"), *[a.alias(n) for n, a in aggs.items()])
        if quantiles:
            summary = summary.join(q.quantiles(laid, keys, quantiles, F.col(BLK)), keys)
        # The values are repeated once per block and joined on (keys, block): a hot key stays split.
        summary = summary.select("*", F.explode(F.sequence("_from", "_to")).alias(BLK)).drop("_from", "_to")
        return laid.join(summary, [*keys, BLK], "left")

    def summarise(self, laid: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        """One row per sequence."""
        return self.core(laid).groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()])


def by_length(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Runs an operator (table, .., seq) on each of the sequence's `parts` and puts the results together."""
    signature = inspect.signature(operator)
    table = next(iter(signature.parameters))

    @wraps(operator)
    def run(*args, **options) -> DataFrame:
        call = signature.bind(*args, **options)
        call.apply_defaults()
        out = None
        for rows, seq in call.arguments["seq"].parts(call.arguments[table]):
            call.arguments.update({table: rows, "seq": seq})
            part = operator(*call.args, **call.kwargs)
            out = part if out is None else out.unionByName(part)
        return out
    return run


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column], slice_: Column,
    name: str = "row", total: str | None = None,
) -> DataFrame:
    """0-based position of each row within its key, without one task per key.

    `slice_` is any value that never decreases along `order` (a day, the high bits of a hash):
    rows are numbered inside (key, slice) and shifted by the size of the earlier slices.
    """
    # One struct key (equal also where a field is NULL): the windows and the join share its shuffle.
    src = df.withColumn("_group_key", F.struct(*keys, slice_.alias("_slice")))
    sizes = src.groupBy("_group_key").agg(F.count(F.lit(1)).alias("_n"))
    group = [F.col(f"_group_key.{k}") for k in keys] or [F.lit(0)]
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_group_key._slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_group_key", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    local = src.withColumn("_local", F.row_number().over(Window.partitionBy("_group_key").orderBy(*order)) - 1)
    out = local.join(sizes, "_group_key")
    cols = [F.col(c) for c in df.columns] + [(F.col("_local") + F.col("_before")).cast("long").alias(name)]
    if total:
        cols.append(F.col("_total").alias(total))
    return out.select(*cols)
