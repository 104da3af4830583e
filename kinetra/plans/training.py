"""From labelled pose rows to a split training annotation set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinetra.functions.rules import to_three
from kinetra.operators.clean import normalise_to_image, primary_person, zero_non_finite
from kinetra.operators.kinematics import static_trim
from kinetra.operators.reshape import assemble_tensor
from kinetra.operators.sample import Order, all_validation, stratified_holdout
from kinetra.operators.sequence import Sequence


def usable_samples(
    pose: DataFrame, labels: DataFrame, seq: Sequence, trim: bool = True, fps: int = 30, min_frames: int = 50,
    three_class: bool = False, lower_classes_only: bool = False,
) -> DataFrame:
    """(swing_id, label, start, end, total_frames) of the samples that are kept: long enough after
    trimming and with some coordinate. Frames are counted: a sample with gaps is as long as it has frames."""
    rows = zero_non_finite(primary_person(pose))
    spans = static_trim(rows, seq, fps) if trim else rows.groupBy(*seq.keys).agg(F.lit(0).alias("start"), F.max("frame").alias("end"))
    inside = rows.join(spans, list(seq.keys)).filter(F.col("frame").between(F.col("start"), F.col("end")))
    # Per frame first, so that neither step gathers a swing's rows.
    frames = inside.groupBy(*seq.keys, "frame").agg(F.bool_or((F.col("x") != 0) | (F.col("y") != 0)).alias("_some"))
    found = frames.groupBy(*seq.keys).agg(F.count(F.lit(1)).cast("int").alias("total_frames"), F.bool_or("_some").alias("_some"))
    spans = spans.join(found.filter((F.col("total_frames") > min_frames) & F.col("_some")).drop("_some"), list(seq.keys))
    if lower_classes_only:
        labels = labels.filter(~F.col("label").isin(3, 4))
    if three_class:
        labels = labels.withColumn("label", to_three(F.col("label")))
    return spans.join(labels, list(seq.keys))


def split_samples(samples: DataFrame, val_ratio: float = 0.1, test_mode: bool = False, order: Order | None = None) -> DataFrame:
    if test_mode:
        return all_validation(samples)
    return stratified_holdout(samples, val_ratio, "label", order or Order.hashed("swing_id"), ("xsub_train", "xsub_val"))


def training_set(
    pose: DataFrame, samples: DataFrame, width: int = 1920, height: int = 1080, normalise: bool = False,
) -> DataFrame:
    """Annotation rows of split samples: keypoint, keypoint_score, total_frames, label, split."""
    rows = zero_non_finite(primary_person(pose)).join(samples, "swing_id")
    rows = rows.filter(F.col("frame").between(F.col("start"), F.col("end"))).withColumn("frame", F.col("frame") - F.col("start"))
    if normalise:
        rows = normalise_to_image(rows, width, height)
    shape = F.array(F.lit(height), F.lit(width))
    out = assemble_tensor(rows, ["swing_id", "label", "split"])
    return out.withColumnRenamed("swing_id", "frame_dir").withColumns({"img_shape": shape, "original_shape": shape})


def training_rows(
    pose: DataFrame, labels: DataFrame, seq: Sequence, val_ratio: float = 0.1, test_mode: bool = False,
    order: Order | None = None, normalise: bool = False, **options,
) -> DataFrame:
    samples = split_samples(usable_samples(pose, labels, seq, **options), val_ratio, test_mode, order)
    return training_set(pose, samples, normalise=normalise)

