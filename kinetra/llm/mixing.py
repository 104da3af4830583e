"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetra.llm.common import free_name, require, word_count
from kinetra.operators.sequence import cut_lineage

#: Rows per slice of a source and of the schedule, on average: what one task orders at a time.
SLICE = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, most: float) -> DataFrame:
    """source, source_size, target: the words each source may give.

    `sizes` has (source, size) rows. Sources in code point order, null last, take the weights in turn and share
    `budget` times all sizes. A target stops at `most` times its source's size; the excess goes to the others by
    weight until none is above. That is one water level: target = least(most * size, level * weight), and the
    level follows from the sources in order of size over weight, of which the first ones are full.
    The windows here run over one row per source, as many as the mixture has weights for.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(int(x)) for x in weights])
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("weight", F.element_at(w, (((F.row_number().over(one) - 1) % len(weights)) + 1).cast("int")))
         .withColumn("full", F.col("source_size") * F.lit(float(most))))
    order = (F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The first source in this order that its share doesn't fill sets the level; without one, all are full.
    s = s.withColumn("level", level).withColumn("open", F.col("full") > F.col("level") * F.col("weight"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("weight"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("full"), F.col("level") * F.col("weight")), F.col("full")).alias("target"))


def schedule(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, most: int = 2, seed: str = "mix",
             slice_rows: int = SLICE) -> DataFrame:
    """doc_id, source, size, source_size, target and finish, an array of each pass's virtual finish time, for each row of `docs`.

    Each source lays its documents out in an order shuffled by a seeded hash, `most` passes one after the other. A
    document's virtual finish time is the words of its source up to its own last one over the source's target. All
    sources are served at the rate of their targets, so the whole schedule has served the total budget at time 1.

    The running sums are two-level: a source is cut into slices of the hash, as many as its rows ask for, so that the
    rows of a hot source spread over tasks; slices add what the earlier ones of their source hold.
    """
    require(docs, "doc_id", "text", "source")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = cut_lineage(rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))))
    targets = source_targets(rows, weights, budget, most)
    counts = rows.groupBy(F.col("source").alias("c_source")).agg(F.count("*").alias("n"))
    per_source = cut_lineage(targets.join(counts, F.col("source").eqNullSafe(F.col("c_source")))
                             .select(F.col("source").alias("s_source"), "source_size", "target", F.ceil(F.col("n") / slice_rows).cast("long").alias("slices")))
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32)) * F.col("slices"))
    sliced = (rows.join(per_source, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
              .withColumn("slice", place.cast("long")))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = (sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
            .select(F.col("source").alias("a_source"), F.col("slice").alias("a_slice"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")))
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("ahead") + F.col("within")
    passes = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(
        F.col("target") > 0, (i * F.col("source_size") + upto) / F.col("target")).otherwise(F.lit(0.0)))
    return (sliced.withColumn("within", F.sum("size").over(inside))
            .join(sums, F.col("source").eqNullSafe(F.col("a_source")) & (F.col("slice") == F.col("a_slice")))
            .select("doc_id", "source", "size", "source_size", "target", passes.alias("finish")))


def _inside(finish: Column) -> Column:
    """Whether most of a document's words are served before the budget is: at time 1."""
    return (finish * F.col("target") - F.col("size") / 2 <= F.col("target")) & (F.col("size") > 0)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of `docs` (doc_id, text, source).

    `taken` counts the words of those of a document's passes that the schedule serves before the total budget is used
    up; the one pass of each source that the cut falls into is in if most of it lies before the cut, which leaves
    each source within half a document of its target. Options are those of `schedule`.

    Null text has size 0; documents of size 0 take nothing. A null source is a source of its own. Repeated rows are
    taken one by one, each up to `most` times. Other columns are ignored. No rows in, no rows out.
    """
    served = F.size(F.filter("finish", _inside))
    return schedule(docs, **options).select("doc_id", "source", "size", "source_size", "target", (served * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it does, range-sorted by virtual finish time.

    Written to files, they are the mixed stream: every stretch has the sources in about the proportions of their
    targets. Columns are those of `docs`. Rows that share a doc_id and a source are each taken as the one with most passes.
    """
    ident, source, finish = (free_name(docs, x) for x in ("ident", "src", "finish"))
    served = (schedule(docs, **options).select("doc_id", "source", F.filter("finish", _inside).alias("served")).where("size(served) > 0")
              .groupBy(F.col("doc_id").alias(ident), F.col("source").alias(source))
              .agg(F.max(F.struct(F.size("served"), "served"))["served"].alias(finish)))
    taken = (docs.join(served, F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(source)))
             .withColumn(finish, F.explode(finish)))
    return taken.repartitionByRange(F.col(finish), F.xxhash64(ident)).sortWithinPartitions(finish).drop(ident, source, finish)
