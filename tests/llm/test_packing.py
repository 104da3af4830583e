import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetra.llm.packing import Encoder, best_fit, pack_documents, pack_pieces, token_pieces

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["a  b", "  a", "a   b ", "x\n\n y", " ", "", None, "a<|endoftext|>b", "it's 12 5'll", "é b 　c", "a \x1cb", "\n a", "a \n b", "日本語 テスト " * 3,
         "a" * 3000 + " b", "word " * 5000, "same text", "same text"]


def ids_of(text):
    return Tokenizer.from_file(JSON).encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_the_tokenizers(spark):
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("ab 1'\n.é日\t") for _ in range(40)) for _ in range(300)]
    with_ranks, without = Encoder(JSON, RANKS), Encoder(JSON)
    for t in texts:
        want = np.array(ids_of(t)[:-1], dtype="<u4").tobytes()
        assert with_ranks.encode(t or "") == want == without.encode(t or ""), repr(t)


def test_pieces_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "no id")], "doc_id long, text string")
    got = {}
    for r in token_pieces(df, JSON, RANKS, limit=64).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(TEXTS) + 1
    for doc_id, pieces in got.items():
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and all(p.length == 64 for p in pieces[1:])
        assert all(0 < p.length <= 64 and len(p.ids) == 4 * p.length for p in pieces)
        ids = np.frombuffer(b"".join(p.ids for p in pieces), dtype="<u4").tolist()
        assert ids == ids_of("no id" if doc_id is None else TEXTS[doc_id])
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()


@pytest.mark.parametrize("rule, weights", [("norm", (1, 0, 0)), ("norm", (1, 0.5, 0.5)), ("dot", (1, 0.2, 0.2))])
def test_every_capacity_holds(rule, weights):
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.geometric(0.004, 1500))
    bins = best_fit(lengths, 2048, 6, 2.5e6 + 2048 ** 2 / 2, rule, weights) if lengths.max() ** 2 <= 2.5e6 + 2048 ** 2 / 2 else best_fit(lengths, 2048, 6, 2048.0 ** 2, rule, weights)
    assert np.bincount(bins, lengths).max() <= 2048 and np.bincount(bins).max() <= 6
    assert np.bincount(bins, lengths.astype(float) ** 2).max() <= 2.5e6 + 2048 ** 2 / 2
    assert sorted(set(bins)) == list(range(bins.max() + 1))
    free = best_fit(lengths, 2048, 2048, 2048.0 ** 2)
    assert free.max() + 1 <= 1.01 * -(-lengths.sum() // 2048) + 1
    with pytest.raises(ValueError):
        best_fit(np.array([10]), 2048, 6, 50.0)


def test_sequences_are_gapless_and_whole(spark):
    rows = [(i % 50 if i % 9 else None, 0, 0, 1 + i * 37 % 2048, f"n{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, shard string")
    for shard_docs in (4096, 60):
        out = pack_pieces(df, 500, shard_docs=shard_docs).collect()
        assert len(out) == 500
        bins = {}
        for r in out:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
    assert pack_pieces(df.limit(0), 0).collect() == []


def test_packed_documents_hold_all_ids(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = pack_documents(df, JSON, RANKS, limit=512, columns=("ids", F.crc32("ids").alias("ids_crc32")))
    total = sum(len(ids_of(t)) for t in TEXTS)
    rows = out.collect()
    assert sum(r.length for r in rows) == total and len({r.sequence_id for r in rows}) <= -(-total // 512) + 1
