import random

import pytest

from kinetra.llm.ngram_join import drop_similar_documents, similar_documents

SCHEMA = "doc_id long, text string"


def words(text):
    return (text or "").encode().lower().split()


def grams(text, width):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def expected(rows, width, keep):
    sets = [grams(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            if keep[1] * len(s & sets[j]) >= keep[0] * len(s | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted((r[0], len(s), low.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def corpus(seed, n=260):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = [rnd.choice(vocabulary) for _ in range(14)]
    base = [rnd.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            w = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))]
        elif kind == 1:  # near copies of one text, and copies of those
            w = list(rows[rnd.randrange(len(rows))][1].split()) if rows and rnd.random() < 0.4 else list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        elif kind == 2:  # a line that many share
            w = line + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))]
        elif kind == 3 and rows:
            w = rows[rnd.randrange(len(rows))][1].upper().split()
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.randint(400, 900))]
            if rows and rnd.random() < 0.5:
                w = max(rows, key=lambda r: len(r[1]))[1].split()
                for _ in range(rnd.randint(0, 30)):
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rnd.shuffle(rows)
    return rows


def got(spark, rows, **options):
    df = similar_documents(spark.createDataFrame(rows, SCHEMA), **options)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed, width, keep, crowd", [(1, 3, (90, 100), 3), (2, 5, (80, 100), 16), (4, 1, (75, 100), 2)])
def test_components_match_brute_force(spark, seed, width, keep, crowd):
    rows = corpus(seed)
    assert got(spark, rows, width=width, keep=keep, crowd=crowd) == expected(rows, width, keep)


def test_chains_in_a_crowd_match_brute_force(spark):
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    texts = [list(base)]
    for i in range(200):  # copies of the text or of earlier copies, each with a few changes
        w = list(rnd.choice(texts) if rnd.random() < 0.5 else base)
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(3000)}"
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want = expected(rows, 3, (90, 100))
    assert len({c for _, _, c in want}) > 10
    assert got(spark, rows, crowd=4) == want == got(spark, rows, crowd=10 ** 9)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\x0btwo"), (7, "ONE\x0btwo"),
            (8, "é one"), (9, "É one"), (10, "a " * 30000), (11, "a a a a")]
    assert got(spark, rows) == expected(rows, 3, (90, 100))
    assert got(spark, []) == []


def test_missing_ids_never_name_a_component(spark):
    df = similar_documents(spark.createDataFrame([(None, "a b c d"), (9, "a b c d"), (None, "x y z q")], SCHEMA))
    assert sorted(map(tuple, df.collect()), key=str) == [(9, 2, 9), (None, 2, 9), (None, 2, None)]


def test_one_row_of_each_group_stays_with_all_columns(spark):
    text = " ".join(f"t{i}" for i in range(200))
    rows = [(5, text, "x", 1), (3, text + " end", "y", 2), (8, "other words of a text", "z", 3), (None, text, "n", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ident string, n long")
    out = drop_similar_documents(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted(df.where("doc_id is null or doc_id in (3, 8)").collect(), key=str)
