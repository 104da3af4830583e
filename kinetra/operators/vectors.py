"""Embeddings: quality, clip reduction, scaling, projection, classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F


def clean_values(vec: Column) -> Column:
    """NaN and missing values become zero."""
    return F.transform(vec, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")))


def embedding_quality(emb: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows, rows with a NaN, and mean and deviation of the L2 norm with NaN read as zero."""
    norm = F.sqrt(F.aggregate(clean_values(F.col(vec)), F.lit(0.0), lambda a, x: a + x * x))
    return emb.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.exists(vec, lambda x: F.isnan(x)), 1)).alias("with_nan"),
                   F.avg(norm).alias("norm_mean"), F.stddev_pop(norm).alias("norm_std"))


def reduce_clips(emb: DataFrame, keys: list[str], how: str = "mean", vec: str = "vec", clip: str = "clip") -> DataFrame:
    """One vector per id: mean or max over clips without NaN, or all clips end to end."""
    if how == "flatten":
        rows = emb.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(clip, vec))).alias("_r"))
        return rows.select(*keys, F.flatten(F.transform("_r", lambda r: r[vec])).alias(vec))
    # Spark's vector aggregates fold each task's clips into one buffer of an id before the exchange, however many it has.
    # A position without a value counts nothing: it adds 0 to sums and counts, and is below everything for the maximum.
    width = emb.agg(F.max(F.size(vec))).scalar()
    there = F.transform(vec, lambda x: x.isNotNull() & ~F.isnan(x))

    def full(values: Column, filler: float) -> Column:
        return array_to_vector(F.concat(values, F.array_repeat(F.lit(filler), F.greatest(width, F.lit(0)) - F.size(vec))))

    def numbers(filler: float) -> Column:
        return F.transform(vec, lambda x: F.when(x.isNotNull() & ~F.isnan(x), x.cast("double")).otherwise(F.lit(filler)))

    counts = full(F.transform(there, lambda t: t.cast("double")), 0.0)
    folded = Summarizer.max(full(numbers(-float("inf")), -float("inf"))) if how == "max" else Summarizer.sum(full(numbers(0.0), 0.0))
    met = emb.withColumn(vec, F.coalesce(vec, F.array().cast(dict(emb.dtypes)[vec]))).groupBy(*keys).agg(
        Summarizer.sum(counts).alias("_n"), folded.alias("_v"), F.max(F.size(vec)).alias("_size"))
    value = F.zip_with(vector_to_array("_v"), vector_to_array("_n"), lambda v, n: F.when(n > 0, v if how == "max" else v / n))
    # As wide as the widest clip of the id: what only wider ids have is cut off again.
    return met.select(*keys, F.slice(value, F.lit(1), F.col("_size")).alias(vec))


def concat_features(a: DataFrame, b: DataFrame, id_: str = "id", vec: str = "vec") -> DataFrame:
    return a.join(b.select(id_, F.col(vec).alias("_b")), id_).withColumn(vec, F.concat(F.col(vec), F.col("_b"))).drop("_b")


def position_stats(emb: DataFrame, vec: str = "vec") -> DataFrame:
    """Per vector position: mean, population deviation, minimum, maximum."""
    tall = emb.select(F.posexplode(vec).alias("pos", "_x")).withColumn("_x", F.when(~F.isnan("_x"), F.col("_x").cast("double")))
    return tall.groupBy("pos").agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"))


def _as_row(stats: DataFrame) -> Column:
    """All positions as one sorted array: a single small row, as wide as a vector."""
    return stats.agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "std", "min", "max")))).scalar()


def standard_scale(fit: DataFrame, apply: DataFrame, vec: str = "vec") -> DataFrame:
    """Zero mean and unit population deviation as fitted; constant positions are only shifted."""
    out = apply.withColumn("_s", _as_row(position_stats(fit, vec)))
    return out.withColumn(vec, F.zip_with(
        vec, "_s", lambda x, t: (x.cast("double") - t["mean"]) / F.when(t["std"] == 0, 1.0).otherwise(t["std"]))).drop("_s")


def min_max_scale(fit: DataFrame, apply: DataFrame, vec: str = "vec") -> DataFrame:
    """Fitted range to [0, 1]; constant positions become zero for fitted values."""
    def scale(x: Column, t: Column) -> Column:
        span = t["max"] - t["min"]
        return (x.cast("double") - t["min"]) / F.when(span == 0, 1.0).otherwise(span)

    out = apply.withColumn("_s", _as_row(position_stats(fit, vec)))
    return out.withColumn(vec, F.zip_with(vec, "_s", scale)).drop("_s")


def zscore_filter(emb: DataFrame, vec: str = "vec", limit: float = 3.0, share: float = 0.95) -> DataFrame:
    """Rows with at least `share` of their positions within `limit` deviations."""
    out = emb.withColumn("_s", _as_row(position_stats(emb, vec)))
    z = F.zip_with(vec, "_s", lambda x, t: F.abs((x.cast("double") - t["mean"]) / F.when(t["std"] != 0, t["std"])) < limit)
    good = F.size(F.filter(z, lambda b: F.coalesce(b, F.lit(False))))
    return out.filter(good >= F.size(vec) * share).drop("_s")


def pca_2d(fit: DataFrame, apply: DataFrame, vec: str = "vec", k: int = 2) -> tuple[DataFrame, list[float]]:
    """Projection on the first components of the fitted set, centred on it, and explained shares.

    The sign of a component is arbitrary.
    """
    src = fit.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(src)
    means = [r["mean"] for r in position_stats(fit, vec).orderBy("pos").collect()]
    centre = F.array(*[F.lit(float(m)) for m in means])
    moved = apply.withColumn("_v", array_to_vector(F.zip_with(F.col(vec), centre, lambda x, m: x.cast("double") - m)))
    out = model.transform(moved).withColumn("projection", vector_to_array("_p")).drop("_v", "_p")
    return out, [float(v) for v in model.explainedVariance]


def scatter(emb: DataFrame, vec: str) -> np.ndarray:
    """Sum of outer products of the rows, added up in a tree over the tasks."""
    rows = emb.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "_v")).computeGramianMatrix().toArray()


def lda_1d(fit: DataFrame, apply: DataFrame, vec: str = "vec", label: str = "label") -> DataFrame:
    """Two-class Fisher projection: the class means and the pooled scatter leave the cluster as one
    vector and one D x D matrix, rows never do."""
    tall = fit.select(label, F.posexplode(vec).alias("pos", "_x"))
    means = tall.groupBy(label, "pos").agg(F.avg(F.col("_x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n")).toPandas()
    classes = sorted(means[label].unique())
    mu = {c: g.sort_values("pos")["m"].to_numpy() for c, g in means.groupby(label)}
    n = {c: int(g["n"].max()) for c, g in means.groupby(label)}
    centre = None
    for c in classes:
        arr = F.array(*[F.lit(float(v)) for v in mu[c]])
        centre = F.when(F.col(label) == c, arr) if centre is None else centre.when(F.col(label) == c, arr)
    centred = fit.select(F.zip_with(F.col(vec), centre, lambda x, m: x.cast("double") - m).alias(vec))
    sw = scatter(centred, vec) / max(sum(n.values()) - len(classes), 1)
    w = np.linalg.pinv(sw) @ (mu[classes[-1]] - mu[classes[0]])
    scale = float(np.sqrt(w @ sw @ w)) or 1.0
    w = w / scale
    total = sum(n[c] * mu[c] for c in classes) / sum(n.values())
    weights = F.array(*[F.lit(float(v)) for v in w])
    dot = F.aggregate(F.zip_with(F.col(vec), weights, lambda x, a: x.cast("double") * a), F.lit(0.0), lambda s, v: s + v)
    return apply.withColumn("projection", dot - F.lit(float(total @ w)))


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))


def logistic_baseline(train: DataFrame, test: DataFrame, vec: str = "vec", label: str = "label") -> DataFrame:
    """Unit-penalty logistic regression: probability of class 1 for train and test rows."""
    n = train.count()
    model = LogisticRegression(featuresCol="features", labelCol=label, standardization=False, regParam=1.0 / max(n, 1), maxIter=200) \
        .fit(_features(train, vec))
    parts = [_features(d, vec).withColumn("part", F.lit(p)) for p, d in (("train", train), ("test", test))]
    both = model.transform(parts[0].unionByName(parts[1], allowMissingColumns=True))
    return both.withColumn("prob_1", F.get(vector_to_array("probability"), F.lit(1))).select(
        "part", F.col(label).cast("int").alias("label"), "prob_1", F.col("prediction").cast("int").alias("pred"))


def mlp_head(train: DataFrame, test: DataFrame, width: int, hidden: int = 64, vec: str = "vec", label: str = "label",
             classes: int = 2, seed: int = 42) -> DataFrame:
    """Two-layer classifier; balance the classes beforehand by oversampling."""
    model = MultilayerPerceptronClassifier(layers=[width, hidden, classes], labelCol=label, seed=seed, maxIter=60).fit(_features(train, vec))
    out = model.transform(_features(test, vec))
    return out.withColumn("prob_1", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability") \
        .withColumn("pred", F.col("prediction").cast("int")).drop("prediction")
