"""Set operations on ids and annotation sets, natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetra.operators.sequence import cut_lineage


def split_overlap(rows: DataFrame, id_: str = "id", split: str = "split") -> DataFrame:
    """Shared ids of each pair of splits, and the size of the union as (any, any).

    Each id brings its sorted list of splits, so no ids are joined with each other.
    """
    per = rows.groupBy(id_).agg(F.sort_array(F.collect_set(split)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(
        F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    shared = per.select(F.inline(pairs)).groupBy("first", "second").agg(F.count(F.lit(1)).alias("shared"))
    union = per.agg(F.count(F.lit(1)).alias("shared")).select(F.lit("any").alias("first"), F.lit("any").alias("second"), "shared")
    return shared.unionByName(union)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in exactly one of two sets, tagged with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def stack(parts: dict[str, DataFrame], tag: str = "tag") -> DataFrame:
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def merge_annotations(parts: dict[str, list[DataFrame]]) -> DataFrame:
    """Annotation sets under the split each is listed for."""
    return stack({s: _union(dfs) for s, dfs in parts.items()}, "split")


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def one_per_joint(pose: DataFrame, order: str, axes: tuple[str, ...] = ("X3", "Y3", "Z3")) -> DataFrame:
    """The first row of each (frame, person, joint), without non-finite joints.

    A minimum per column, not one of whole rows: numbers are held in place and need no sort, and columns that nobody reads go.
    """
    keys = ["swing_id", "frame", "person_idx", "joint_idx"]
    rows = pose.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in pose.columns if c not in keys])
    ok = F.lit(True)
    for a in axes:
        ok = ok & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf"))
    return rows.filter(ok)


def natural_key(name: Column) -> Column:
    """Sort key that compares digit runs as numbers of any length: array of (text, digits, number) pieces.

    A number is its count of digits without leading zeros and then the digits; a piece without one comes before those with.
    """
    pieces = F.regexp_extract_all(name, F.lit(r"(\D*)(\d*)"), F.lit(0))

    def key(p: Column) -> Column:
        run = F.regexp_extract(p, r"(\d+)$", 1)
        number = F.regexp_replace(run, "^0+", "")
        return F.struct(F.lower(F.regexp_extract(p, r"^(\D*)", 1)).alias("text"),
                        F.when(run == "", -1).otherwise(F.length(number)).alias("digits"), number.alias("number"))

    return F.transform(F.filter(pieces, lambda p: p != ""), key)


def number_in_order(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """0-based place of each row in a total order, for keys of any shape; equal keys are numbered in any order.

    Spark samples the whole key for splitters and sorts each range by itself; a range's rows then start after the rows of the
    ranges before it. The ranges are settled once, so a task that runs again finds the same ones.
    """
    kept = df.columns
    keys = [f"_sort_{i}" for i in range(len(order))]
    ranged = df.select("*", *[c.alias(k) for c, k in zip(order, keys)])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(ranged.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*kept, F.spark_partition_id().alias("_range"),
                                                                                             F.monotonically_increasing_id().alias("_at")))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    starts = sizes.select("_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(starts), "_range").select(*kept, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
