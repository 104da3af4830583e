import hashlib
import random
import re

from kinetra.llm.pii import personal_data, span_report

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def expected(text):
    spans, counts = [], []
    for kind, pattern in BASE.items():
        here = len(spans)
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(spans) - here)
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans))


def test_base_spans_match_the_plain_patterns(spark):
    rnd = random.Random(5)
    texts = ["a@b.c_d@e.f", "x@y.z.", "1.2.3.4.5.6.7.8", "999.1.1.1 0.0.0.0 001.002.003.004 256.1.1.1", "4111 1111 1111 1111", "4111111111111111-",
             "41111111111111112222222", "+1 (234) 555-6789 +12", "++1 234 567 890+1 2345678901234", "é😀 a@b.co 😀1.1.1.1", "a" * 30000 + "@b.c", "1" * 50000,
             " ".join("+1 234 567 8%03d" % i for i in range(700)), "", None, "a@b@c.d", "4111-1111-1111-1111 4111", "5 4111111111111111", "7 " * 30000]
    for alphabet in ("ab1.@+ -()_29\n%é0", "0123456789 -+."):
        texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 90))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in span_report(personal_data(df, support=10 ** 9)).collect()}
    assert {i: t for i, t in enumerate(texts) if got[i] != expected(t)} == {}


def test_confident_contexts_discover_other_forms(spark):
    rows = [(i, f"foo please call number: +1 (234) 567-{1000 + i} thanks bar") for i in range(12)]
    rows += [(100, "so please call number: 555-0199, now"), (101, "buy item 77 now"), (102, "the number 5"), (103, None), (103, None), (None, "x 1")]
    out = span_report(personal_data(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base int"))).collect()
    spans = {r.doc_id: r.spans for r in out}
    assert len(out) == len(rows) and spans[100] == "phone:23:31" and rows[12][1][23:31] == "555-0199"
    assert spans[0] == "phone:24:41" and not spans[101] and not spans[102] and not spans[103] and not spans[None]
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
