"""Queries on embeddings and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra.catalog.registry import query, r6
from kinetra.operators import evaluate as E, neural, pairing as P, sample as SM, vectors as V
from kinetra.sources import fixtures as fx


def elements(df, keys: str):
    return df.select(*keys.split(), F.posexplode("vec").alias("pos", "x")).select(*keys.split(), "pos", r6(F.col("x").cast("double")).alias("x"))


@query("jn1_align_strict", "WITH $EMB_A, $EMB_B SELECT b.id, len(b.vec) AS width FROM emb_a a JOIN emb_b b USING (id)")
def _(spark, sf):
    a, b = fx.emb_a(spark, sf).drop("vec"), fx.emb_b(spark, sf)
    return P.align_strict(a.join(b.select("id"), "id", "left_semi"), b).select("id", F.size("vec").alias("width"))


@query("jn2_align_lenient", "WITH $EMB_A, $EMB_B SELECT id, label, len(b.vec) AS width FROM emb_a a JOIN emb_b b USING (id)")
def _(spark, sf):
    return P.align_lenient(fx.emb_a(spark, sf).drop("vec"), fx.emb_b(spark, sf)).select("id", "label", F.size("vec").alias("width"))


@query("jn2_coverage", "WITH $EMB_A, $EMB_B SELECT count(*) FILTER (WHERE b.id IS NOT NULL) AS \"both\", count(*) FILTER (WHERE b.id IS NULL) AS only_first, CAST(0 AS BIGINT) AS only_second FROM emb_a a LEFT JOIN emb_b b USING (id)")
def _(spark, sf):
    return P.coverage(fx.emb_a(spark, sf), fx.emb_b(spark, sf))


@query("src6_embedding_assembly", "WITH $EMB_A, $EMB_B SELECT b.id, CASE WHEN CAST(b.id AS INT) % 2 = 0 THEN a.label ELSE -1 END AS label FROM emb_b b JOIN emb_a a USING (id)")
def _(spark, sf):
    from kinetra.sources.readers import assemble_embeddings
    a, b = fx.emb_a(spark, sf), fx.emb_b(spark, sf)
    return assemble_embeddings(a.select("id"), b, a.filter(F.col("id").cast("int") % 2 == 0).select("id", "label")).select("id", "label")


def _whole(spark, sf):
    """Ids with labels, and ids with whole vectors."""
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", F.col("embedding").alias("vec"))
    return e.select("id", "label"), e.select("id", "vec")


_VALUES = "unnest(range(0, len(embedding)))::INT AS pos, r6(unnest(embedding)::DOUBLE) AS x FROM embeddings"


@query("jn1_aligned_vectors", f"SELECT vec_id::VARCHAR AS id, label, {_VALUES}")
def _(spark, sf):
    return elements(P.align_strict(*_whole(spark, sf)), "id label")


@query("jn2_aligned_vectors", f"SELECT vec_id::VARCHAR AS id, label, {_VALUES} WHERE vec_id % 11 <> 0")
def _(spark, sf):
    a, b = _whole(spark, sf)
    return elements(P.align_lenient(a, b.filter(F.col("id").cast("long") % 11 != 0)), "id label")


@query("src6_assembled_vectors", f"SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 2 = 0 THEN label ELSE -1 END AS label, {_VALUES}")
def _(spark, sf):
    from kinetra.sources.readers import assemble_embeddings
    a, b = _whole(spark, sf)
    return elements(assemble_embeddings(a.select("id"), b, a.filter(F.col("id").cast("long") % 2 == 0)), "id label")


@query("agg18_embedding_quality", "WITH $EMB_A, s AS (SELECT sqrt(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM emb_a) SELECT count(*) AS n, CAST(0 AS BIGINT) AS with_nan, r6(avg(l)) AS norm_mean, r6(stddev_pop(l)) AS norm_std FROM s")
def _(spark, sf):
    q = V.embedding_quality(fx.emb_a(spark, sf))
    return q.select("n", "with_nan", r6("norm_mean").alias("norm_mean"), r6("norm_std").alias("norm_std"))


_TALL = "t AS (SELECT id, label, clip, unnest(range(0, 16)) AS pos, unnest(vec)::DOUBLE AS x FROM emb_clips)"


@query("agg19_reduce_mean", f"WITH $CLIPS, {_TALL} SELECT id, pos::INT AS pos, r6(avg(x)) AS x FROM t GROUP BY 1, 2")
def _(spark, sf):
    return elements(V.reduce_clips(fx.emb_clips(spark, sf), ["id"]), "id")


@query("agg19_reduce_max", f"WITH $CLIPS, {_TALL} SELECT id, pos::INT AS pos, r6(max(x)) AS x FROM t GROUP BY 1, 2")
def _(spark, sf):
    return elements(V.reduce_clips(fx.emb_clips(spark, sf), ["id"], "max"), "id")


@query("agg19_reduce_flatten", f"WITH $CLIPS, {_TALL} SELECT id, (clip * 16 + pos)::INT AS pos, r6(x) AS x FROM t")
def _(spark, sf):
    return elements(V.reduce_clips(fx.emb_clips(spark, sf), ["id"], "flatten"), "id")


_MEAN = "pm AS (SELECT id, max(gt) AS gt, " + ", ".join(f"avg(scores[{i}]) AS s{i}" for i in range(1, 6)) + " FROM preds GROUP BY 1)"


@query("agg20_video_scores", f"""WITH $PREDS, {_MEAN} SELECT id, CASE WHEN s2 > s1 THEN 1 ELSE 0 END AS pred, r6(exp(s2) / (exp(s1) + exp(s2))) AS prob_1 FROM pm""")
def _(spark, sf):
    v = E.video_scores(fx.preds(spark, sf).withColumn("scores", F.slice("scores", 1, 2)), ["id"])
    return v.select("id", "pred", r6("prob_1").alias("prob_1"))


_ALL = "(exp(s1) + exp(s2) + exp(s3) + exp(s4) + exp(s5))"


@query("agg20_scores_of_all_classes", f"""WITH $PREDS, {_MEAN}
SELECT id, CAST(list_position([s1, s2, s3, s4, s5], greatest(s1, s2, s3, s4, s5)) - 1 AS INT) AS pred, r6(exp(s2) / {_ALL}) AS prob_1 FROM pm""")
def _(spark, sf):
    v = E.video_scores(fx.preds(spark, sf), ["id"], classes=5)
    return v.select("id", "pred", r6("prob_1").alias("prob_1"))


@query("agg21_clip_vote", f"""WITH $PREDS, m AS (SELECT * REPLACE (CASE WHEN CAST(id AS INT) % 2 = 0 THEN scores END AS scores) FROM preds),
{_MEAN.replace('FROM preds', 'FROM m')}, v AS (SELECT id, pred, count(*) AS n, min(clip) AS f FROM preds WHERE pred IS NOT NULL GROUP BY 1, 2), b AS (SELECT id, pred, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS r FROM v)
SELECT pm.id, CASE WHEN s1 IS NOT NULL THEN CAST(list_position([s1, s2, s3, s4, s5], greatest(s1, s2, s3, s4, s5)) - 1 AS INT) ELSE b.pred END AS pred FROM pm LEFT JOIN b ON b.id = pm.id AND r = 1""")
def _(spark, sf):
    p = fx.preds(spark, sf).withColumn("scores", F.when(F.col("id").cast("int") % 2 == 0, F.col("scores")))
    return E.clip_vote(p)


_BIN = "bn AS (SELECT id, clip, (gt >= 2)::INT AS gt, (pred >= 2)::INT AS pred FROM preds)"


def binary(spark, sf):
    return fx.preds(spark, sf).select("id", "clip", (F.col("gt") >= 2).cast("int").alias("gt"), (F.col("pred") >= 2).cast("int").alias("pred"),
                                      F.col("scores")[0].alias("score"))


@query("agg22_binary_metrics", f"""WITH $PREDS, {_BIN}, c AS (SELECT count(*) FILTER (WHERE gt = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE gt = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE gt = 0 AND pred = 1) AS fp,
 count(*) FILTER (WHERE gt = 1 AND pred = 0) AS fn, count(pred) AS valid FROM bn)
SELECT *, r6((tp + tn) / valid) AS accuracy, r6(tp / (tp + fp)) AS precision, r6(tp / (tp + fn)) AS recall, r6(2 * tp / (2 * tp + fp + fn)) AS f1 FROM c""")
def _(spark, sf):
    m = E.binary_metrics(binary(spark, sf))
    return m.select("tp", "tn", "fp", "fn", "valid", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_CLS = """cm AS (SELECT c AS class, count(*) FILTER (WHERE gt = c AND pred = c) AS tp, count(*) FILTER (WHERE gt <> c AND pred = c) AS fp, count(*) FILTER (WHERE gt = c AND (pred IS NULL OR pred <> c)) AS fn,
 count(*) FILTER (WHERE gt = c) AS support FROM preds, (SELECT unnest(range(0, 5))::INT AS c) GROUP BY 1),
cl AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM cm)"""


@query("agg23_class_metrics", f"WITH $PREDS, {_CLS} SELECT class, tp, fp, fn, support, r6(p) AS precision, r6(r) AS recall, r6(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f1 FROM cl")
def _(spark, sf):
    m = E.class_metrics(fx.preds(spark, sf))
    return m.select("class", "tp", "fp", "fn", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("agg24_balanced_scores", f"WITH $PREDS, {_CLS} SELECT r6(avg(r) FILTER (WHERE support > 0)) AS balanced_accuracy, r6(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) FILTER (WHERE support > 0 OR fp > 0)) AS macro_f1 FROM cl")
def _(spark, sf):
    m = E.balanced_scores(E.class_metrics(fx.preds(spark, sf)))
    return m.select(r6("balanced_accuracy").alias("balanced_accuracy"), r6("macro_f1").alias("macro_f1"))


@query("agg24_confusion", "WITH $PREDS SELECT gt, pred, count(*) AS n, r6(count(*) / sum(count(*)) OVER (PARTITION BY gt)) AS share FROM preds WHERE pred IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return E.confusion(fx.preds(spark, sf)).select("gt", "pred", "n", r6("share").alias("share"))


_SC = """sc AS (SELECT round(scores[1], 1) AS s, (gt >= 2)::INT AS y FROM preds), tot AS (SELECT sum(y) AS p, sum(1 - y) AS q FROM sc),
th AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY 1), cu AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM th)"""


def tied(spark, sf):
    return binary(spark, sf).withColumn("score", F.round("score", 1))


@query("agg25_curves", f"WITH $PREDS, {_SC} SELECT r6(s) AS score, r6(tp / p) AS tpr, r6(fp / q) AS fpr, r6(tp / (tp + fp)) AS precision FROM cu, tot")
def _(spark, sf):
    return E.curves(tied(spark, sf), "score", "gt").select(*[r6(c).alias(c) for c in ("score", "tpr", "fpr", "precision")])


@query("agg25_auc_scores", f"WITH $PREDS, {_SC} SELECT r6(sum(neg * (tp - pos + pos / 2)) / max(p * q)) AS roc_auc, r6(sum(pos * tp / (tp + fp)) / max(p)) AS average_precision FROM cu, tot")
def _(spark, sf):
    return E.auc_scores(tied(spark, sf), "score", "gt").select(r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"))


@query("agg26_score_statistics", """WITH $PREDS, t AS (SELECT unnest(range(0, 5)) AS class, unnest(scores) AS s FROM preds)
SELECT class::INT AS class, r6(avg(s)) AS mean, r6(stddev_pop(s)) AS std, r6(min(s)) AS min, r6(max(s)) AS max, max(s) - min(s) < 1e-6 AS "constant" FROM t GROUP BY 1""")
def _(spark, sf):
    s = E.score_statistics(fx.preds(spark, sf))
    return s.select("class", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")], "constant")


@query("agg27_accuracy_per_run", "WITH $PREDS SELECT clip, count(pred) AS valid, r6(avg((gt = pred)::INT)) AS accuracy FROM preds GROUP BY 1")
def _(spark, sf):
    return E.accuracy(fx.preds(spark, sf), by=("clip",)).select("clip", "valid", r6("accuracy").alias("accuracy"))


@query("agg28_class_weights", """WITH $SAMPLES, c AS (SELECT label5, count(*) AS n FROM samples GROUP BY 1), w AS (SELECT label5, (SELECT count(*) FROM samples) / n AS w FROM c)
SELECT label5, r6(w * 5 / sum(w) OVER ()) AS weight FROM w""")
def _(spark, sf):
    return E.class_weights(fx.samples(spark, sf), "label5", 5).select("label5", r6("weight").alias("weight"))


@query("agg28_positive_weight", "WITH $SAMPLES SELECT count(*) FILTER (WHERE label = 1) AS n_true, count(*) FILTER (WHERE label = 0) AS n_false, r6(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1)) AS false_per_true FROM samples")
def _(spark, sf):
    return E.positive_weight(fx.samples(spark, sf)).select("n_true", "n_false", r6("false_per_true").alias("false_per_true"))


# ---- vectors -----------------------------------------------------------------------------------

_VT = "vt AS (SELECT id, label, unnest(range(0, 32))::INT AS pos, unnest(vec)::DOUBLE AS x FROM emb_a)"


@query("ml1_concat_features", "WITH $EMB_A, $EMB_B, c AS (SELECT a.id, list_concat(a.vec, b.vec) AS vec FROM emb_a a JOIN emb_b b USING (id)) SELECT id, unnest(range(0, 64))::INT AS pos, r6(unnest(vec)::DOUBLE) AS x FROM c".replace(
    "r6(unnest(vec)::DOUBLE) AS x FROM c", "unnest(list_transform(vec, lambda v: r6(v::DOUBLE))) AS x FROM c"))
def _(spark, sf):
    return elements(V.concat_features(fx.emb_a(spark, sf), fx.emb_b(spark, sf)), "id")


@query("ml2_standard_scale", f"WITH $EMB_A, {_VT}, s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM vt WHERE CAST(id AS INT) % 4 <> 0 GROUP BY 1) SELECT id, pos, r6((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END) AS x FROM vt JOIN s USING (pos)")
def _(spark, sf):
    e = fx.emb_a(spark, sf)
    return elements(V.standard_scale(e.filter(F.col("id").cast("int") % 4 != 0), e), "id")


@query("ml3_min_max_scale", f"WITH $EMB_A, {_VT}, s AS (SELECT pos, min(x) AS a, max(x) AS b FROM vt WHERE CAST(id AS INT) % 4 <> 0 GROUP BY 1) SELECT id, pos, r6((x - a) / CASE WHEN b = a THEN 1 ELSE b - a END) AS x FROM vt JOIN s USING (pos)")
def _(spark, sf):
    e = fx.emb_a(spark, sf)
    return elements(V.min_max_scale(e.filter(F.col("id").cast("int") % 4 != 0), e), "id")


@query("win38_zscore_filter", f"""WITH $EMB_A, {_VT}, s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM vt GROUP BY 1), z AS (SELECT id, count(*) FILTER (WHERE abs((x - m) / s) < 2.0) AS g FROM vt JOIN s USING (pos) GROUP BY 1)
SELECT id FROM z WHERE g >= 32 * 0.95""")
def _(spark, sf):
    return V.zscore_filter(fx.emb_a(spark, sf), limit=2.0).select("id")


def halves(spark, sf, vec):
    e = vec.withColumn("label", (F.col("label") >= 5).cast("int"))
    test = F.col("id").cast("int") % 5 == 0
    return e.filter(~test), e.filter(test)


def quarters(spark, sf):
    e = fx.emb_a(spark, sf)
    test = F.col("id").cast("int") % 4 == 0
    return e.filter(~test), e.filter(test)


@query("ml4_pca_2d")
def _(spark, sf):
    e = fx.emb_a(spark, sf)
    s = V.standard_scale(e, e)
    out, _ = V.pca_2d(s, s)
    return out.select("id", "label", r6(F.col("projection")[0]).alias("p0"), r6(F.col("projection")[1]).alias("p1"))


@query("ml5_lda_1d")
def _(spark, sf):
    train, test = halves(spark, sf, fx.emb_a(spark, sf))
    return V.lda_1d(V.standard_scale(train, train), V.standard_scale(train, test)).select("id", "label", r6("projection").alias("projection"))


@query("ml6_logistic_baseline")
def _(spark, sf):
    train, test = halves(spark, sf, fx.emb_a(spark, sf))
    p = V.logistic_baseline(train, test)
    return p.groupBy("part").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("label") == F.col("pred")).cast("int"))).alias("accuracy"))


@query("ml7_mlp_head")
def _(spark, sf):
    train, test = halves(spark, sf, fx.emb_a(spark, sf))
    balanced = SM.oversample(train, order=SM.Order.hashed()).drop("copy")
    return V.mlp_head(balanced, test, 32, 16).select("id", "label", "pred", r6("prob_1").alias("prob_1"))


@query("ml7_weighted_head")
def _(spark, sf):
    """Ten labels as two classes of three to seven: weighted in the loss, not copied."""
    train, test = (d.withColumn("label", (F.col("label") >= 3).cast("int")) for d in quarters(spark, sf))
    return neural.apply_head(test, neural.fit_head(train, 32, 16)).select("id", "label", "pred", r6("prob_1").alias("prob_1"))


@query("ml9_projection_table")
def _(spark, sf):
    e = fx.emb_a(spark, sf)
    train, test = halves(spark, sf, e)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    out, _ = V.pca_2d(train, both)
    return out.select("id", "split", "label", r6(F.col("projection")[0]).alias("x"), r6(F.col("projection")[1]).alias("y"))


@query("plan_fusion_report")
def _(spark, sf):
    from kinetra.plans import fusion
    k = F.col("id").cast("int")
    video = fx.emb_a(spark, sf).withColumns({"label": (F.col("label") >= 3).cast("int"),
                                             "split": F.when(k % 5 == 0, "test").when(k % 5 == 1, "valid").otherwise("train")})
    feats = fusion.fused_features(video, fx.emb_clips(spark, sf).select("id", "clip", "vec"))
    out = fusion.report(fusion.classify(feats, 48, 16))
    return out.select("n", r6("accuracy").alias("accuracy"), r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"))
