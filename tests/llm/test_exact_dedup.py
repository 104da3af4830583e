import hashlib
import re

from pyspark.sql import functions as F

from kinetra.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

ROWS = [(5, "a b c"), (3, "abc"), (9, "a  b\tc\n"), (2, "a  b\x0bc\x0c"), (7, None), (8, ""), (6, " \r\n"), (1, "ABC"), (4, "a\u00a0bc"),
        (10, "x" * 200000), (11, "x " * 200000), (12, "é e\u0301"), (None, "only"), (None, "abc"), (13, "twice"), (13, "twice")]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append((len(text or ""), doc_id))
    out, used = [], set()
    for doc_id, text in rows:
        group = groups[norm(text)]
        size, low = min(group, key=lambda g: (-g[0], g[1] is None, g[1] or 0))
        best = (doc_id, len(text or "")) == (low, size) and norm(text) not in used
        used |= {norm(text)} if best else set()
        out.append((doc_id, low, len(group), best, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted(map(tuple, exact_duplicates(df).collect()), key=str) == expected(ROWS)
    assert exact_duplicates(df.limit(0)).collect() == []


def test_colliding_digests_stay_apart(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    short = exact_duplicates(df, digest=lambda c: F.length(c) % 2)
    assert sorted(map(tuple, short.collect()), key=str) == expected(ROWS)


def test_kept_rows_have_all_columns(spark):
    rows = [(d, t, i, "s") for i, (d, t) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ident int, kept string")
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns
    want = sorted(((d, k) for d, _, _, kept, k in expected(ROWS) if kept), key=str)
    assert sorted(((r.doc_id, hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in out.collect()), key=str) == want
