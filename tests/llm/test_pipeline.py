import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P


def tables(folder, spark):
    """Good, junk, copied and nearly copied documents of three sources, with labels for some."""
    rnd = random.Random(11)
    vocabulary = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(240):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 120))]
        docs.append([i, " ".join(words), i % 3, "good"])
    for i in range(240, 300):
        docs.append([i, " ".join(f"{rnd.choice(vocabulary)}###" for _ in range(60)), i % 3, "junk"])
    for i in range(300, 330):  # copies but for white space, and near copies
        docs.append([i, docs[i - 300][1].replace(" ", "\n", 3) + "  ", i % 3, "copy"])
    for i in range(330, 360):
        words = docs[100 + i - 330][1].split()
        docs.append([i, " ".join(words + words[:1]), i % 3, "near"])
    labels = [(i, int(kind != "junk"), 0) for i, _, _, kind in docs if i % 2]
    docs += [[400, None, 0, "good"], [401, "", 1, "good"]]
    spark.createDataFrame([(i, t, "en", f"s{s}", len(t or "")) for i, t, s, _ in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {i: (t, s, kind) for i, t, s, kind in docs}


def test_stages_do_what_they_say(spark, tmp_path):
    all_ = tables(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        assert name == P.STAGES[-1][0] or docs.columns == columns
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    good = {i for i, (_, _, kind) in all_.items() if kind != "junk"}
    assert good <= set(kept["quality_classifier"]) and len(set(kept["quality_classifier"]) - good) < 45
    junk = set(kept["quality_classifier"]) - good
    # Copies have the longer original text, so they stay and what they copy goes; the two empty texts are one.
    assert set(kept["exact_dedup"]) == (good | junk) - set(range(30)) - {401}
    assert set(kept["ngram_jaccard_join"]) == set(kept["exact_dedup"]) - set(range(330, 360))
    assert set(kept["mix_sources"]) <= set(kept["ngram_jaccard_join"]) and max(map(kept["mix_sources"].count, kept["mix_sources"])) == 2
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    tokens = sum(len(encode(all_[i][0] or "", add_special_tokens=False).ids) + 1 for i in kept["mix_sources"])
    pieces = docs.collect()
    assert sum(r.length for r in pieces) == tokens
    used = {}
    for r in pieces:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-tokens // 2048) + 1
    assert sorted(r.doc_id for r in P.run(spark, str(tmp_path)).collect()) == kept["best_fit_packing"]


def test_empty_documents_pass_through(spark, tmp_path):
    tables(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == [], name
