import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.llm import importance as m


def corpus():
    good = [(i, f"the quick fox number{i % 7} runs over a calm field today and then rests", 1, 0) for i in range(120)]
    junk = [(200 + i, ("spam###" + " buy buy buy" * (2 + i % 5)), 0, 0) for i in range(40)]
    return good + junk


def test_weights_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(500, None), (501, "  "), (None, "the quick fox")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    raw, target = np.zeros(2 * m.BUCKETS, np.int64), np.zeros(2 * m.BUCKETS, np.int64)
    words = m._WordTokens()
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        f = m.features(t, words)
        np.add.at(raw, f, 1)
        if i is not None and i < 200:
            np.add.at(target, f, 1)
    ratios = m.log_ratios(raw, target)
    got = m.resample_by_importance(docs, labels).collect()
    for r in got:
        text = next(t for i, t in [(d.doc_id, d.text) for d in docs.collect()] if i == r.doc_id)
        assert r.log_weight == pytest.approx(ratios[m.features(text, words)].sum())
        noise = r.log_weight - r.gumbel_key
        assert -5 < math.log(max(1e-9, math.exp(min(700, noise)))) < 20
    kept = {r.doc_id for r in got}
    gone = {r.doc_id for r in docs.collect()} - kept
    share = 0.75 + 3 * (0.75 * 0.25 / 160) ** 0.5
    assert gone <= set(range(200, 240)) and len(gone) == 163 - math.ceil(share * 163)


def test_the_cut_is_the_kth_key(spark):
    df = spark.range(3000).select(((F.col("id") * 7919) % 1009).cast("double").alias("v"))
    values = sorted((i * 7919 % 1009 for i in range(3000)), reverse=True)
    for k in (1, 2, 500, 2999, 3000, 4000):
        assert m.kth_largest(df, "v", k, bins=8) == values[min(k, 3000) - 1]
    assert m.kth_largest(df, "v", 0) is None and m.kth_largest(df.limit(0), "v", 3) is None


def test_held_out_documents_are_told_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t, _, _ in rows], "doc_id long, text string, _mark int")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 2], "doc_id long, quality int, toxic int")
    out = m.drop_unlike_target(docs, labels)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    gone = {i for i, _, _, _ in rows} - kept
    assert gone <= set(range(200, 240)) and len(gone) >= 15


def test_edge_tables(spark):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in m.resample_by_importance(docs, labels).collect()) == [1, 1, 2]
    assert m.resample_by_importance(docs.limit(0), labels).collect() == []
    assert m.drop_unlike_target(docs, labels.limit(0)).count() == 3


def test_insults_in_clean_text_are_not_drawn(spark):
    rnd = np.random.RandomState(4)
    plain = [f"w{i}" for i in range(300)]

    def text(size, insults=0):
        said = [plain[j] for j in rnd.randint(0, 300, size)]
        for _ in range(insults):
            said.insert(rnd.randint(0, size), f"insult{rnd.randint(0, 4)}")
        return " ".join(said)

    clean = [(i, text(30 + 9 * (i % 100)), 1, 0) for i in range(600)]
    toxic = [(1000 + i, text(30 + 9 * (i % 100), 3), 1, 1) for i in range(160)]
    junk = [(2000 + i, "zz yy " * (5 + i % 50), 0, 0) for i in range(60)]
    rows = clean + toxic + junk
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    # Every second document has a label; the others are judged by what was learnt.
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in m.resample_by_importance(docs, labels).collect()}
    assert kept == {r.doc_id for r in m.drop_unlike_target(docs, labels).collect()}
    assert len([i for i, *_ in toxic if i in kept]) <= 3
    assert len([i for i, *_ in clean if i not in kept]) <= 6


def test_long_clean_documents_without_a_label_stay(spark):
    rnd = np.random.RandomState(8)

    def text(size):
        # Every second word is in few other documents, as in real text.
        return " ".join(f"c{rnd.randint(0, 50)} r{int(rnd.pareto(0.3) * 20) % 20000}" for _ in range(size))

    clean = [(i, text(20 if i % 4 else 400), 1, 0) for i in range(400)]
    junk = [(2000 + i, "zz yy " * (5 + i % 50), 0, 0) for i in range(100)]
    docs = spark.createDataFrame([r[:2] for r in clean + junk], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in clean + junk if i // 4 % 2], "doc_id long, quality int, toxic int")
    scored, cut = m.importance_keys(docs, labels)
    rows = {r.doc_id: r for r in scored.collect()}
    assert [i for i, *_ in clean if rows[i].gumbel_key < cut] == []
    keys = [[rows[i].gumbel_key for i, *_ in clean if i % 4 == 0 and bool(i // 4 % 2) is fitted] for fitted in (False, True)]
    assert abs(np.median(keys[0]) - np.median(keys[1])) < 0.5 * np.std(keys[0])
    # A bucket of which the target would hold a hundredth of a token says next to nothing by being absent.
    raw, target = np.full(2 * m.BUCKETS, 100), np.full(2 * m.BUCKETS, 1)
    raw[0], target[0] = 1, 0
    assert abs(m.log_ratios(raw, target)[0]) < 0.02
