"""Scores of predictions: clip votes, confusion, per-class metrics, curves, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def argmax(scores: Column) -> Column:
    """0-based position of the largest value, the first on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def mean_scores(preds: DataFrame, keys: list[str], scores: str, classes: int, keep: dict[str, Column] | None = None) -> DataFrame:
    """Mean score vector over the clips of each id; one aggregate per class, combined map-side."""
    avgs = [F.avg(F.get(F.col(scores), F.lit(i))) for i in range(classes)]
    return preds.groupBy(*keys).agg(
        F.when(F.count(scores) > 0, F.array(*avgs)).alias(scores), *[c.alias(n) for n, c in (keep or {}).items()])


def video_scores(preds: DataFrame, keys: list[str], logits: str = "scores", classes: int = 2) -> DataFrame:
    """Mean logits over clips, softmax, predicted class and probability of class 1."""
    out = mean_scores(preds, keys, logits, classes).withColumn("_p", softmax(F.col(logits)))
    return out.select(*keys, argmax(F.col("_p")).alias("pred"), F.get(F.col("_p"), F.lit(1)).alias("prob_1"))


def clip_vote(preds: DataFrame, key: str = "id", seq: str = "clip", classes: int = 5) -> DataFrame:
    """Class of the mean scores where an id has scores, else its most frequent label, the first
    seen on ties."""
    by_label = preds.filter(F.col("pred").isNotNull()).groupBy(key, "pred").agg(
        F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first"))
    votes = by_label.groupBy(key).agg(F.max_by("pred", F.struct("_n", (-F.col("_first")).alias("o"))).alias("_vote"))
    means = mean_scores(preds, [key], "scores", classes)
    return means.join(votes, key, "left").select(key, F.coalesce(argmax(F.col("scores")), F.col("_vote")).alias("pred"))


def binary_metrics(rows: DataFrame, gt: str = "gt", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts and scores; rows without a prediction do not count."""
    def n(g: int, p: int) -> Column:
        return F.count(F.when((F.col(gt) == g) & (F.col(pred) == p), 1))

    out = rows.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"),
                                F.count(pred).alias("valid"))
    out = out.withColumns({"accuracy": _ratio(F.col("tp") + F.col("tn"), F.col("valid")),
                           "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
                           "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_metrics(rows: DataFrame, classes: int = 5, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, support, precision, recall, f1 per class. A missing prediction is a miss of the true
    class; truths outside the range are left out."""
    ok = rows.filter(F.col(gt).between(0, classes - 1))
    n = ok.groupBy(gt, pred).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.col(pred).isNotNull() & (F.col(pred) == F.col(gt))
    # Each counted cell speaks for its true class and, when wrong, for its predicted one.
    roles = F.array(
        F.struct(F.col(gt).alias("class"), F.lit(True).alias("t")),
        F.when(F.col(pred).isNotNull() & ~hit, F.struct(F.col(pred).alias("class"), F.lit(False).alias("t"))),
        )
    cells = n.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    tall = cells.select("_n", "_hit", F.inline(F.filter(roles, lambda r: r.isNotNull())))
    every = F.array(*[F.struct(F.lit(c).alias("class")) for c in range(classes)])
    names = n.agg(F.count(F.lit(1))).select(F.inline(every))
    agg = tall.groupBy("class").agg(
        F.sum(F.when(F.col("t") & F.col("_hit"), F.col("_n"))).alias("tp"), F.sum(F.when(~F.col("t"), F.col("_n"))).alias("fp"),
        F.sum(F.when(F.col("t") & ~F.col("_hit"), F.col("_n"))).alias("fn"), F.sum(F.when(F.col("t"), F.col("_n"))).alias("support"))
    out = names.join(agg, "class", "left").fillna(0)
    out = out.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy(rows: DataFrame, gt: str = "gt", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of right predictions among those made (also per run or epoch)."""
    return rows.groupBy(*by).agg(F.count(pred).alias("valid"),
                                 F.coalesce(F.avg((F.col(gt) == F.col(pred)).cast("int")), F.lit(0.0)).alias("accuracy"))


def balanced_scores(per_class: DataFrame) -> DataFrame:
    """Balanced accuracy over classes with samples; macro F1 over classes seen at all."""
    seen = (F.col("support") > 0) | (F.col("fp") > 0)
    return per_class.agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
                         F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"))


def confusion(rows: DataFrame, gt: str = "gt", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Counted cells with their share of the true class."""
    n = rows.filter(F.col(pred).isNotNull()).groupBy(*by, gt, pred).agg(F.count(F.lit(1)).alias("n"))
    # A confusion matrix has classes x classes cells: the window is over those, not over rows.
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, gt)))


def score_table(rows: DataFrame, score: str, label: str, slices: int = 64) -> DataFrame:
    """Per distinct score, from the highest: its positives and negatives, and those at or above it.

    Scores are counted first; sketched bounds cut them into slices of similar size whose totals are
    summed up, so no task sorts all scores. The bounds decide the balance, never the counts.
    """
    pos = F.count(F.when(F.col(label) == 1, 1))
    n = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        pos.alias("pos"), (F.count(F.lit(1)) - pos).alias("neg"))
    grid = [i / slices for i in range(1, slices)]
    bounds = n.agg(F.percentile_approx("score", grid, 100 * slices)).scalar()
    n = n.withColumn("_b", bounds).withColumn("_slice", -F.size(F.filter("_b", lambda b: b < F.col("score")))).drop("_b")
    per = n.groupBy("_slice").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_slice", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"),
                     F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_q"))
    w = Window.partitionBy("_slice").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = n.select("*", F.sum("pos").over(w).alias("_ip"), F.sum("neg").over(w).alias("_iq"))
    return inside.join(per, "_slice").select(
        "score", "pos", "neg", (F.col("_ip") + F.col("_p")).alias("tp"), (F.col("_iq") + F.col("_q")).alias("fp"))


def curves(rows: DataFrame, score: str, label: str) -> DataFrame:
    """ROC and precision-recall points at every distinct score."""
    t = score_table(rows, score, label)
    p = rows.filter(F.col(score).isNotNull()).agg(F.count(F.when(F.col(label) == 1, 1))).scalar()
    q = rows.filter(F.col(score).isNotNull()).agg(F.count(F.when(F.col(label) == 0, 1))).scalar()
    return t.select("score", (F.col("tp") / F.nullif(p, F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif(q, F.lit(0))).alias("fpr"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def auc_scores(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve (ties count half) and average precision."""
    t = score_table(rows, score, label)
    above = F.col("tp") - F.col("pos")
    sums = t.agg(
        F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_a"))
    # With one class only the areas are not defined.
    return sums.select((F.col("_u") / F.nullif(F.col("_p") * F.col("_q"), F.lit(0))).alias("roc_auc"),
                       (F.col("_a") / F.nullif(F.col("_p"), F.lit(0))).alias("average_precision"))


def score_statistics(preds: DataFrame, scores: str = "scores") -> DataFrame:
    """Mean, deviation and range of each class's score, and whether all rows are the same."""
    tall = preds.select(F.posexplode(scores).alias("class", "_s"))
    out = tall.groupBy("class").agg(F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("std"), F.min("_s").alias("min"), F.max("_s").alias("max"))
    return out.withColumn("constant", F.col("max") - F.col("min") < 1e-6)


def class_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """Inverse frequency per class, scaled to sum to the number of classes."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = F.array(*[F.struct(F.lit(c).alias(label)) for c in range(classes)])
    total = F.col("_total")
    names = rows.agg(F.count(F.lit(1)).alias("_total")).select("_total", F.inline(every))
    w = names.join(counts, label, "left").withColumn("_w", total / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)))
    return w.select(label, (F.col("_w") * classes / F.sum("_w").over(Window.partitionBy("_total"))).alias("weight"))


def positive_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive and the reverse, for a weighted loss."""
    t, f = F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))
    return rows.agg(t.alias("n_true"), f.alias("n_false"), (f / F.nullif(t, F.lit(0))).alias("false_per_true"),
                    (t / F.nullif(f, F.lit(0))).alias("true_per_false"))
