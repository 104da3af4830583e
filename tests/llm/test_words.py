import random

import numpy as np
import pyarrow as pa

from kinetra.llm import words as m


def plain(texts):
    out = []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").encode().lower().split(b"\n")):
            out += [(i, k, w) for w in line.split()]
    return out


def check(texts, sliced=0):
    h, row, line = m.Words().of(pa.array(texts, pa.string()).slice(sliced))
    want = plain(texts[sliced:])
    assert [(r, k) for r, k, _ in want] == list(zip(row.tolist(), line.tolist()))
    names = {}
    for x, (_, _, w) in zip(h.tolist(), want):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_words_match_plain_splitting(monkeypatch):
    rnd = random.Random(1)
    texts = [None, "", " ", "a", "A a\nb", "\n\n x\x0by \x1c z w ", "é É ß", "ab ba aab aba", "end\n"]
    texts += ["".join(rnd.choice("aAb \n\té") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(m, "CHUNK", size)
        check(texts)
        check(texts, sliced=5)
    check([])
    check([None])
    check(["x" * 500 + " y " * 300, "tail"])


def test_a_chunk_more_or_less_changes_no_hash(monkeypatch):
    text = pa.array([" ".join(f"word{i}" for i in range(5000))])
    whole = m.Words().of(text)[0]
    monkeypatch.setattr(m, "CHUNK", 100)
    assert (m.Words().of(text)[0] == whole).all() and len(np.unique(whole)) == 5000
