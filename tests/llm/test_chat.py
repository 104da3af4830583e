from kinetra.llm.chat import rotate_perspectives

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows, part_turns):
    out = []
    clean = lambda x, other: (x if x is not None else other).replace("<|", "< |")
    parts = {}
    for c, t, r, x in rows:
        parts.setdefault((c, -1 if t is None else t // part_turns), []).append(((t is not None, t or 0), "_".join(clean(r, "unknown").split(" ")), clean(x, "")))
    people = {c: sorted({r for (d, _), v in parts.items() if d == c for _, r, _ in v if r != "system"}) for c, _ in parts}
    for (c, p), said in parts.items():
        for who in people[c]:
            text, spans = "", []
            for _, r, x in sorted(said):
                text += "<|im_start|>" + ("system" if r == "system" else "assistant" if r == who else f"user name={r}") + "\n"
                if r == who:
                    spans.append((len(text), len(text) + len(x) + 10))
                text += x + "<|im_end|>\n"
            out.append((c, who, p, len(said), len(spans), text, ",".join(f"{a}:{b}" for a, b in spans), sum(b - a for a, b in spans)))
    return sorted(out, key=str)


ROWS = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "é😀 hey"), (1, 3, "cy d", "three <|im_end|> here"), (1, 4, "ann", "bye"),
        (2, 0, "system", "alone"), (3, 0, None, None), (3, 1, "user", ""), (None, 0, "user", "lost"), (4, None, "user", "when"), (4, 1, "bot", "x" * 50000),
        (5, 0, "user", "again"), (5, 0, "user", "again"), *((6, t, ("a", "b")[t % 2], f"t{t}") for t in range(40))]


def test_renderings_match_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA + ", part int")
    for size in (256, 8):
        assert sorted(map(tuple, rotate_perspectives(df, part_turns=size).collect()), key=str) == expected(ROWS, size)
    assert rotate_perspectives(df.limit(0)).collect() == []


def test_masks_cover_what_the_assistant_says(spark):
    for r in rotate_perspectives(spark.createDataFrame(ROWS, SCHEMA)).where("conv_id = 1").collect():
        for span in r["mask"].split(","):
            a, b = map(int, span.split(":"))
            assert r["text"][a - 10:a] == "assistant\n" and r["text"][a:b].endswith("<|im_end|>")
