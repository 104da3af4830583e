import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kinetra.llm.fill_in_middle import fim_pieces, fim_report, fim_texts, unit_ends

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def expected(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        form, out, sizes = "plain", text, (None, None)
    else:
        form, sizes = ("spm" if h4 % 100 < spm else "psm"), (len(prefix), len(middle))
        out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, form, *sizes, sha(out), sha(text)), out


def texts(seed):
    rnd = random.Random(seed)
    fixed = [None, "", " ", "\n\t \r\x0b\x0c", "a", " a", "a ", "é日本  x　 y", "<P>", "a <S> b", "x<M>", "<P", "P>", "<", "< P>< <S", "a" * 300_000,
             "word " * 60_000, "日本語 " * 40_000, "<<<>>> " * 50, "\U0001f600 \U0001f601"]
    return fixed + ["".join(rnd.choice("ab <>PSM\n\té日\U0001f600") for _ in range(rnd.randint(1, 80))) for _ in range(400)]


def by(row):
    return [(x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row]


@pytest.mark.parametrize("piece", [1 << 16, 7])
def test_report_matches_brute_force(spark, piece):
    rows = [(i, t) for i, t in enumerate(texts(piece)) if piece > 7 or len(t or "") < 1000]
    rows += [(None, "no id at all"), (None, "no id at all"), (None, None), (-5, "minus five here"), (50, "another row of the same id"), (50, rows[50][1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("row", F.lit(1))
    got = fim_report(df, piece=piece).collect()
    assert sorted(map(tuple, got), key=by) == sorted((expected(*r)[0] for r in rows), key=by)
    assert {"plain", "spm", "psm"} == {r.form for r in got}


@pytest.mark.parametrize("rate, spm", [(100, 0), (100, 100), (0, 50)])
def test_texts_are_what_the_digests_say(spark, rate, spm):
    rows = list(enumerate(texts(3)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.form, r.output) for r in fim_texts(df, rate=rate, spm=spm).collect()}
    for doc_id, text in rows:
        row, out = expected(doc_id, text, rate, spm)
        assert got[doc_id] == (row[2], out)


def test_pieces_hold_whole_units_within_their_size(spark):
    text = " ".join(f"w{i}" for i in range(5000)) + " " + "long" * 500 + " end"
    df = spark.createDataFrame([(i, text) for i in range(10)], SCHEMA)
    pieces = fim_pieces(df, piece=200, rate=100).collect()
    assert all(len(p.data) <= 200 or b"long" * 500 in p.data and len(p.data) <= 2001 for p in pieces)
    ends = set(unit_ends(text.encode()).tolist())
    assert len(ends) == len(UNIT.findall(text)) and len(pieces) > 1000
    at = 0
    for p in sorted((p for p in fim_pieces(df.limit(1), piece=200, rate=0).collect()), key=lambda p: p.at):
        at += len(p.data)
        assert at in ends


def test_a_repeated_row_keeps_its_number(spark):
    df = spark.createDataFrame([(1, "one two three")] * 500 + [(None, None)] * 100, SCHEMA).repartition(3)
    out = fim_report(df).groupBy("doc_id").count().collect()
    assert {(r.doc_id, r["count"]) for r in out} == {(1, 500), (None, 100)}
    assert fim_texts(df).count() == 600


def test_empty_and_missing(spark):
    df = spark.createDataFrame([(1, "a")], SCHEMA).limit(0)
    assert fim_report(df).collect() == [] and fim_texts(df).collect() == []
    with pytest.raises(ValueError, match="text"):
        fim_report(df.drop("text"))
