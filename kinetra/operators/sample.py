"""Sampling, balancing and splitting in a reproducible random order.

The order of rows is a hash of the id and a seed, so membership depends on the data alone and
survives any partitioning or retry. Ranks within a label are taken per slice of the hash range, so
a label with most of the rows is numbered by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kinetra.operators.sequence import number_rows


@dataclass
class Order:
    """Sort value and a coarse value that never decreases along it."""

    value: Column
    slice: Column
    tie: Column

    @staticmethod
    def hashed(id_: str = "id", seed: int = 42, bits: int = 12) -> Order:
        h = F.xxhash64(F.col(id_), F.lit(seed))
        return Order(h, F.shiftright(h, 64 - bits), F.col(id_))

    @staticmethod
    def by(value: Column, id_: str, width: int = 16) -> Order:
        return Order(value, F.floor(value / width), F.col(id_))


def ranked(df: DataFrame, keys: list[str], order: Order, rank: str = "_rank", total: str = "_n") -> DataFrame:
    src = df.withColumns({"_ov": order.value, "_os": order.slice, "_ot": order.tie})
    out = number_rows(src, keys, [F.col("_ov"), F.col("_ot")], F.col("_os"), rank, total)
    return out.drop("_ov", "_os", "_ot")


def _count(df: DataFrame, cond: Column) -> Column:
    return df.agg(F.count(F.when(cond, 1))).scalar()


def undersample(df: DataFrame, label: str = "label", order: Order | None = None) -> DataFrame:
    """As many rows of every label as the rarest one has."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    least = sizes.agg(F.min("_c")).scalar()
    out = ranked(df, [label], order or Order.hashed())
    return out.filter(F.col("_rank") < least).drop("_rank", "_n")


def undersample_exact(df: DataFrame, label: str = "label", small: int = 0, order: Order | None = None) -> DataFrame:
    """All rows of the small label and equally many others; fails where there are not enough."""
    n_small, n_other = _count(df, F.col(label) == small), _count(df, F.col(label) != small)
    out = ranked(df.withColumn("_g", F.col(label) == small), ["_g"], order or Order.hashed())
    need = F.when(n_other < n_small, F.raise_error(F.lit("too few rows of the large label")).cast("long")).otherwise(n_small)
    return out.filter(F.col("_g") | (F.col("_rank") < need)).drop("_g", "_rank", "_n")


def oversample(df: DataFrame, label: str = "label", small: int = 0, order: Order | None = None) -> DataFrame:
    """Repeat the small label to the size of the other: whole copies, then a first part."""
    n_small, n_other = _count(df, F.col(label) == small), _count(df, F.col(label) != small)
    out = ranked(df.withColumn("_g", F.col(label) == small), ["_g"], order or Order.hashed())
    whole = F.floor(n_other / F.nullif(n_small, F.lit(0)))
    copies = F.when(F.col("_g") & (n_other > n_small), whole + (F.col("_rank") < n_other - whole * n_small).cast("long")).otherwise(1)
    return out.select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))


def bootstrap(df: DataFrame, label: str = "label", small: int = 0, order: Order | None = None,
              pick: Column | None = None, seed: int = 42) -> DataFrame:
    """Draw rows of the small label with replacement, one draw per row of the other label.

    `pick` maps a draw number `_draw` to any integer; the drawn rank is that modulo the label size.
    """
    order = order or Order.hashed()
    both = ranked(df.withColumn("_g", F.col(label) == small), ["_g"], order)
    pool = both.filter("_g")
    n_small = _count(df, F.col(label) == small)
    draws = both.filter(~F.col("_g")).select(F.col("_rank").alias("_draw"))
    value = pick if pick is not None else F.xxhash64("_draw", F.lit(seed))
    draws = draws.select("_draw", F.pmod(value, F.nullif(n_small, F.lit(0))).alias("_rank"))
    return draws.join(pool, "_rank").select(*df.columns, F.col("_draw").alias("draw"))


def _uniform(*parts: Column) -> Column:
    """Reproducible number in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def augment_with_noise(df: DataFrame, vec: str, label: str = "label", small: int = 0, ratio: float = 1.0, sigma: float = 0.05,
                       id_: str = "id", order: Order | None = None, seed: int = 42) -> DataFrame:
    """floor(ratio * n) extra rows of the small label with normal noise on the vector.

    The noise is a function of id, copy and position, so a recomputed task gives the same rows.
    """
    part = ranked(df.filter(F.col(label) == small), [], order or Order.hashed(id_))
    want = F.floor(F.col("_n") * ratio)
    part = part.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.lit(ratio)).cast("long") - 1, F.lit(0)))))
    part = part.filter(F.col("copy") * F.col("_n") + F.col("_rank") < want)

    def noisy(x: Column, i: Column) -> Column:
        u = _uniform(F.col(id_), F.col("copy"), i, F.lit(seed))
        v = _uniform(F.col(id_), F.col("copy"), i, F.lit(seed + 1))
        return (x + F.lit(sigma) * F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)).cast("double")

    added = part.withColumn(vec, F.transform(vec, noisy)).select(*df.columns, F.lit(True).alias("augmented"))
    return df.withColumn(vec, F.transform(vec, lambda x: x.cast("double"))).withColumn("augmented", F.lit(False)).unionByName(added)


def stratified_holdout(df: DataFrame, ratio: float, label: str = "label", order: Order | None = None,
                       names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Per label max(1, floor(n * ratio)) rows for validation when the ratio is positive."""
    out = ranked(df, [label], order or Order.hashed())
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)) if ratio > 0 else F.lit(0)
    return out.withColumn("split", F.when(F.col("_rank") < k, names[1]).otherwise(names[0])).drop("_rank", "_n")


def ratio_split(df: DataFrame, ratio: float = 0.9, order: Order | None = None, names: tuple[str, str] = ("train", "valid")) -> DataFrame:
    """The first floor(n * ratio) rows of the shuffled table, and the rest."""
    out = ranked(df, [], order or Order.hashed())
    return out.withColumn("split", F.when(F.col("_rank") < F.floor(F.col("_n") * ratio), names[0]).otherwise(names[1])).drop("_rank", "_n")


def holdout_at_least_one(df: DataFrame, ratio: float = 0.10, order: Order | None = None) -> DataFrame:
    """max(1, floor(n * ratio)) rows for validation."""
    out = ranked(df, [], order or Order.hashed())
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))
    return out.withColumn("split", F.when(F.col("_rank") < F.col("_n") - k, "train").otherwise("val")).drop("_rank", "_n")


def three_way_split(df: DataFrame, train: float = 0.8, valid: float = 0.1, label: str = "label", order: Order | None = None) -> DataFrame:
    out = ranked(df, [label], order or Order.hashed())
    a = F.floor(F.col("_n") * train)
    b = a + F.floor(F.col("_n") * valid)
    split = F.when(F.col("_rank") < a, "train").when(F.col("_rank") < b, "valid").otherwise("test")
    return out.withColumn("split", split).drop("_rank", "_n")


def folds(df: DataFrame, k: int, label: str | None = None, order: Order | None = None) -> DataFrame:
    """Fold number per row, even within each label when one is given."""
    out = ranked(df, [label] if label else [], order or Order.hashed())
    return out.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n")


def all_validation(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.lit("xsub_val"))


def resplit(df: DataFrame, ratio: float, label: str = "label", order: Order | None = None) -> DataFrame:
    """Replace the split of an annotation set by a stratified one."""
    return stratified_holdout(df.drop("split"), ratio, label, order, ("xsub_train", "xsub_val"))


def balanced_groups(groups: DataFrame, label: str = "label", limit: int | None = None, order: Order | None = None) -> DataFrame:
    """Equally many groups (swings) of each label; keeps the rank as `group_rank`.

    `limit` bounds them where a classifier is fitted on a bounded sample.
    """
    sizes = groups.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    least = sizes.agg(F.min("_c") if limit is None else F.least(F.min("_c"), F.lit(limit))).scalar()
    out = ranked(groups, [label], order or Order.hashed())
    return out.filter(F.col("_rank") < least).withColumnRenamed("_rank", "group_rank").drop("_n")


def trim_to_equal(rows: DataFrame, label: str, group_rank: str, position: str) -> DataFrame:
    """The same number of rows of each label, in group order then position."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    least = sizes.agg(F.min("_c")).scalar()
    out = number_rows(rows, [label], [F.col(group_rank), F.col(position)], F.col(group_rank), "_row")
    return out.filter(F.col("_row") < least).drop("_row")
