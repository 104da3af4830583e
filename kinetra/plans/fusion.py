"""From two embedding sets to scored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinetra.operators import evaluate as E, neural, vectors as V
from kinetra.operators.pairing import align_strict
from kinetra.operators.sample import oversample


def fused_features(video: DataFrame, pose_clips: DataFrame, how: str = "mean") -> DataFrame:
    """Video vectors with the reduced pose vectors of the same ids appended; a missing id fails.

    video(id, label, split, vec); pose_clips(id, clip, vec).
    """
    pose = V.reduce_clips(pose_clips, ["id"], how).withColumnRenamed("vec", "pose_vec")
    both = align_strict(video, pose)
    return both.withColumn("vec", F.concat(F.transform("vec", lambda x: x.cast("double")), F.col("pose_vec"))).drop("pose_vec")


def scaled(features: DataFrame) -> DataFrame:
    """All splits on the scale of train and valid."""
    return V.standard_scale(features.filter(F.col("split") != "test"), features)


def classify(features: DataFrame, width: int, hidden: int = 256, balance: bool = True) -> DataFrame:
    """Test rows with the probability of class 1, from a network trained on the other rows."""
    x = scaled(features)
    train = x.filter(F.col("split") != "test")
    if balance:
        train = oversample(train).drop("copy")
    return V.mlp_head(train, x.filter(F.col("split") == "test"), width, hidden)


def classify_weighted(features: DataFrame, width: int, hidden: int = 256, **options) -> DataFrame:
    """As `classify`, by a head whose loss weighs the classes and whose fit stops early; every row counts once."""
    x = scaled(features)
    head = neural.fit_head(x.filter(F.col("split") != "test"), width, hidden, **options)
    return neural.apply_head(x.filter(F.col("split") == "test"), head)


def report(predictions: DataFrame) -> DataFrame:
    """Accuracy at 0.5, exact AUC and average precision in one row."""
    rows = predictions.withColumn("pred", (F.col("prob_1") > 0.5).cast("int"))
    acc = E.accuracy(rows, "label")
    return E.auc_scores(rows, "prob_1", "label").withColumns({
        "accuracy": acc.select("accuracy").scalar(), "n": acc.select("valid").scalar()})
