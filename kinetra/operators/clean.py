"""Masking, normalising and filtering of pose rows.

A pose row is (swing_id, frame, person_idx, joint_idx, x, y, conf, X3, Y3, Z3). Missing is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetra.operators.sequence import Sequence, by_length

AXES = ("x", "y", "conf", "X3", "Y3", "Z3")
SWING = Sequence()


def _present(df: DataFrame, cols=AXES) -> list[str]:
    return [c for c in cols if c in df.columns]


def _masked(df: DataFrame, cond: Column, cols: list[str], value: float | None = None) -> DataFrame:
    return df.withColumns({c: F.when(~F.coalesce(cond, F.lit(False)), F.col(c)) if value is None
                           else F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(F.col(c)) for c in cols})


def non_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: NaN and infinities become NULL, so averages and fills skip them."""
    return df.withColumns({c: F.when(~non_finite(F.col(c)), F.col(c)) for c in _present(df)})


def zero_non_finite(df: DataFrame, cols=("x", "y", "conf")) -> DataFrame:
    return df.withColumns({c: F.when(non_finite(F.col(c)), F.lit(0.0)).otherwise(F.col(c)) for c in _present(df, cols)})


def mask_missing(df: DataFrame) -> DataFrame:
    """The extractor writes a joint it did not find as (0, 0, 0): 2D and 3D values become NULL."""
    return _masked(df, (F.col("x") == 0) & (F.col("y") == 0) & (F.col("conf") == 0), _present(df))


def mask_low_confidence(df: DataFrame, threshold: float) -> DataFrame:
    """Strictly below the threshold becomes missing in 2D and 3D; 0 switches the mask off."""
    return _masked(df, F.col("conf") < threshold, _present(df)) if threshold > 0 else df


def zero_low_confidence(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    return _masked(df, F.col("conf") < threshold, ["x", "y", "conf"], 0.0)


def normalise_to_image(df: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    return df.withColumns({"x": F.col("x") / width, "y": F.col("y") / height})


def centre_on_joint(df: DataFrame, joint: int = 8, eps: float = 1e-5) -> DataFrame:
    """Per frame and person: origin at one joint (MidHip), scaled by the spread of all x and y.

    A frame without the joint turns NULL; with any missing value it is centred but not scaled.
    """
    w = Window.partitionBy("swing_id", "frame", "person_idx")
    cx, cy = (F.max(F.when(F.col("joint_idx") == joint, F.col(c))).over(w) for c in ("x", "y"))
    df = df.withColumns({"x": F.col("x") - cx, "y": F.col("y") - cy})
    mean = (F.avg("x").over(w) + F.avg("y").over(w)) / 2
    df = df.withColumn("_mean", mean)
    var = (F.avg(F.pow(F.col("x") - F.col("_mean"), 2)).over(w) + F.avg(F.pow(F.col("y") - F.col("_mean"), 2)).over(w)) / 2
    whole = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(w) == F.count(F.lit(1)).over(w)
    df = df.withColumn("_std", F.when(whole, F.sqrt(var)))
    scaled = {c: F.when(F.col("_std") > eps, F.col(c) / F.col("_std")).otherwise(F.col(c)) for c in ("x", "y")}
    return df.withColumns(scaled).drop("_mean", "_std")


@by_length
def match_distribution(df: DataFrame, mean: float, std: float, seq: Sequence = SWING) -> DataFrame:
    """Shift all coordinates of a sample to a target mean and spread; flat samples become zero."""
    laid = seq.lay_out(zero_non_finite(df, ("x", "y")))
    out = seq.attach(laid, {"_mx": F.avg("x"), "_my": F.avg("y"), "_vx": F.var_pop("x"), "_vy": F.var_pop("y")})
    # Spread of the pooled axes: mean of the variances plus the variance of the means.
    v = (F.col("_vx") + F.col("_vy")) / 2 + F.pow((F.col("_mx") - F.col("_my")) / 2, 2)
    out = out.withColumns({"_m": (F.col("_mx") + F.col("_my")) / 2, "_s": F.sqrt(v)})
    new = {c: F.when(F.col("_s") < 1e-6, F.lit(0.0))
           .otherwise((F.col(c) - F.col("_m")) / (F.col("_s") + 1e-8) * std + mean) for c in ("x", "y")}
    return seq.done(out.withColumns(new).drop("_m", "_s", "_mx", "_my", "_vx", "_vy"))


def primary_person(df: DataFrame) -> DataFrame:
    return df.filter(F.col("person_idx") == 0)


def min_length(df: DataFrame, frames: int = 50, inclusive_drop: bool = True, seq: Sequence = SWING) -> DataFrame:
    """Drop whole sequences that have rows at no more (or fewer) than `frames` frames."""
    n = df.select(*seq.keys, seq.order).distinct().groupBy(*seq.keys).agg(F.count(F.lit(1)).alias("_n"))
    long_ = n.filter(F.col("_n") > frames if inclusive_drop else F.col("_n") >= frames)
    return df.join(long_.select(*seq.keys), list(seq.keys), "left_semi")


def reject_all_zero(df: DataFrame, seq: Sequence = SWING) -> tuple[DataFrame, DataFrame]:
    """(samples with some coordinate, ids whose every coordinate is zero)."""
    zero = F.bool_and((F.col("x") == 0) & (F.col("y") == 0))
    out = seq.attach(seq.lay_out(df), {"_zero": zero})
    kept = seq.done(out.filter(~F.coalesce("_zero", F.lit(False))).drop("_zero"))
    return kept, df.groupBy(*seq.keys).agg(zero.alias("_zero")).filter("_zero").select(*seq.keys)


def three_dimensional(df: DataFrame, seq: Sequence = SWING) -> DataFrame:
    """Whether a swing carries depth."""
    return df.groupBy(*seq.keys).agg(F.bool_or(F.col("Z3").isNotNull()).alias("is_3d"))


def coordinate_range(df: DataFrame, seq: Sequence = SWING) -> DataFrame:
    """Extent, centre and scale (1 / diagonal) per swing."""
    out = df.groupBy(*seq.keys).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    diag = F.sqrt(F.pow(F.col("max_x") - F.col("min_x"), 2) + F.pow(F.col("max_y") - F.col("min_y"), 2))
    return out.withColumn("scale", F.when(diag > 0, 1 / diag))


def normalised_flag(df: DataFrame, seq: Sequence = SWING) -> DataFrame:
    """Whether coordinates look normalised: |x| < 1 and |y| < 2 on the first ten joints."""
    r = df.filter(F.col("joint_idx") < 10).groupBy(*seq.keys).agg(
        F.max(F.abs("x")).alias("_x"), F.max(F.abs("y")).alias("_y"))
    return r.select(*seq.keys, F.coalesce((F.col("_x") < 1) & (F.col("_y") < 2), F.lit(False)).alias("is_normalised"))


@by_length
def fit_to_range(df: DataFrame, width: int, height: int, margin: float = 0.1, small: float = 2.0,
                 seq: Sequence = SWING) -> DataFrame:
    """Swings whose coordinates all lie within +-small are stretched over the image with a margin."""
    out = seq.attach(seq.lay_out(df), {"_x0": F.min("x"), "_x1": F.max("x"), "_y0": F.min("y"), "_y1": F.max("y")})
    fits = (F.abs("_x0") <= small) & (F.abs("_x1") <= small) & (F.abs("_y0") <= small) & (F.abs("_y1") <= small)

    def stretch(c: str, lo: str, hi: str, size: int) -> Column:
        span = F.when(F.col(hi) - F.col(lo) == 0, F.lit(1.0)).otherwise(F.col(hi) - F.col(lo))
        return F.when(fits, (margin + (F.col(c) - F.col(lo)) / span * (1 - 2 * margin)) * size).otherwise(F.col(c))

    out = out.withColumns({"x": stretch("x", "_x0", "_x1", width), "y": stretch("y", "_y0", "_y1", height)})
    return seq.done(out.drop("_x0", "_x1", "_y0", "_y1"))


def deproject(df: DataFrame, fx: Column, fy: Column, cx: Column, cy: Column, z: Column) -> DataFrame:
    """Pinhole camera: pixel and depth to metric coordinates, NULL without a positive finite depth."""
    ok = ~non_finite(z) & (z > 0)
    return df.withColumns({
        "X3": F.when(ok, (F.col("x") - cx) * z / fx), "Y3": F.when(ok, (F.col("y") - cy) * z / fy), "Z3": F.when(ok, z)})


def unit_scale(unit: Column) -> Column:
    """Metres per coordinate unit; unknown units count as metres."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit("m"))))
    return (F.when(u.isin("cm", "centimeter", "centimetre", "centimeters"), 1e-2)
            .when(u.isin("mm", "millimeter", "millimetre", "millimeters"), 1e-3).otherwise(1.0))


def speed_units(v: Column) -> tuple[Column, Column]:
    """(km/h, mph) of a speed in m/s."""
    return v * 3.6, v * 2.23694
