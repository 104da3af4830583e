"""Personal data: base patterns, and contexts bootstrapped from what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinetra.llm.common import require
from kinetra.operators.sequence import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Where a run of one character class can match at its start or not at all, `\G` and a look-behind say so, which
#: saves trying every later place in the run; a run that an earlier match cut goes on behind that match.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: Whole chains of 13 to 19 digits; longer and shorter chains fail as a whole.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words that may be identifiers: those with a digit or an @.
_WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Matches whose places are summed up at once.
_BLOCK = 256
_NONE = "array<struct<start:int,end:int,text:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """start, end (code points) and text of the leftmost non-overlapping matches.

    The gaps come from splitting by the same pattern, the places from running sums over gaps and matches, taken
    in blocks so that a text of any number of matches costs little more than its length.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), found,
                       lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("text")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")),
                         lambda k: F.slice(pairs, k * _BLOCK + 1, _BLOCK))
    whole = F.transform(blocks, lambda b: F.struct(b.alias("rows"), F.aggregate(b, F.lit(0), lambda a, p: a + p["gap"] + p["len"]).alias("chars")))
    placed = F.aggregate(
        whole, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_NONE}>").alias("out")),
        lambda s, b: F.struct((s["at"] + b["chars"]).alias("at"), F.concat(s["out"], F.array(F.aggregate(
            b["rows"], F.struct(s["at"].alias("at"), F.array().cast(_NONE).alias("out")),
            lambda t, p: F.struct((t["at"] + p["gap"] + p["len"]).alias("at"), F.concat(t["out"], F.array(F.struct(
                (t["at"] + p["gap"]).alias("start"), (t["at"] + p["gap"] + p["len"]).alias("end"), p["text"].alias("text")))).alias("out")))["out"])).alias("out")))
    return F.when(F.size(found) > 0, F.flatten(placed["out"])).otherwise(F.array().cast(_NONE))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    back = F.reverse(_digits(m))
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(
        i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
        F.floor(F.substring(back, i, F.lit(1)).cast("int") / 5).cast("int") + F.substring(back, i, F.lit(1)).cast("int") * 2 % 10))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<kind int, start int, end int, text string>>: the base matches, by kind and start."""
    has = lambda ch, c: F.when(F.contains(text, F.lit(ch)), c).otherwise(F.array().cast(_NONE))
    found = {
        "email": has("@", _matches(text, _EMAIL)),
        "ip": has(".", F.filter(_matches(text, _IP), lambda m: m["text"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))),
        "card": F.filter(_matches(text, _CARD), lambda m: _luhn(m["text"])),
        "phone": has("+", F.filter(_matches(text, _PHONE), lambda m: F.length(_digits(m["text"])).between(9, 15))),
    }

    def of_kind(i: int, k: str) -> Column:
        return F.transform(found[k], lambda m: F.struct(F.lit(i).alias("kind"), m["start"], m["end"], m["text"]))

    return F.concat(*[of_kind(i, k) for i, k in enumerate(KINDS)])


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """The lexical patterns of a place: the two words before it, and the words on either side."""
    # A hash would do for joining; the words themselves show what was learnt.
    before = F.lower(F.substring(text, F.greatest(F.lit(1), start - 63), F.least(start, F.lit(64))))
    after = F.lower(F.substring(text, end + 1, F.lit(40)))
    two = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)
    one = F.regexp_extract(before, r"(\S+)\s*$", 1)
    next_ = F.regexp_extract(after, r"^\s*(\S+)", 1)
    return F.filter(F.array(F.when(two != "", F.concat(F.lit("< "), F.regexp_replace(two, r"\s+", " "))),
                            F.when((one != "") & (next_ != ""), F.concat(F.lit("<> "), one, F.lit(" _ "), next_))), lambda p: p.isNotNull())


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """doc_id, base and added spans (arrays of kind, start, end, text; kind by number in KINDS) for each row of `docs`.

    Base spans are seeds. Their contexts become patterns, and all identifier-like words (with a digit or an @) in those
    contexts are instances; patterns and instances form a graph of distinct pairs. In each of `rounds` rounds a
    pattern's confidence for a kind is the share of its distinct instances known to be of that kind, and an unknown
    instance scores 1 less the product of what its patterns leave open. Patterns need `support` known instances and
    `confidence`; instances that score as much join the known ones. In the end every identifier-like word in a
    confident pattern is added as that pattern's kind, without the punctuation around it, unless a base span
    touches it; of several kinds the most confident, then the first.

    Null and empty text: no spans. Repeated rows and null doc_ids are searched one by one. Other columns are ignored.
    No rows in, no rows out.
    """
    require(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    free = F.filter(_matches(F.col("text"), _WORD), lambda w: ~F.exists("base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    lead = lambda w: F.length(F.regexp_extract(w, r"^[^\p{L}\p{N}+@]*", 0))
    tail = lambda w: F.length(F.regexp_extract(w, r"[^\p{L}\p{N})]*$", 0))
    trimmed = F.transform(free, lambda w: F.struct(F.lit(-1).alias("kind"), (w["start"] + lead(w["text"])).alias("start"),
                                                   (w["end"] - tail(w["text"])).alias("end"),
                                                   F.regexp_replace(w["text"], r"^[^\p{L}\p{N}+@]+|[^\p{L}\p{N})]+$", "").alias("text")))
    rows = rows.withColumn("words", F.filter(trimmed, lambda w: w["start"] < w["end"]))
    places = F.transform(F.concat("base", "words"), lambda s: F.struct(s["kind"], s["start"], s["end"], s["text"],
                                                                      _contexts(F.col("text"), s["start"], s["end"]).alias("patterns")))
    rows = cut_lineage(rows.select("doc_id", "base", places.alias("places")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    seen = (rows.select("row", F.explode("places").alias("p")).select("row", "p.kind", "p.start", "p.end", F.lower("p.text").alias("instance"), "p.patterns"))
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance").distinct()
    known = seen.where("kind >= 0").select("instance", "kind").distinct()
    edges, known = cut_lineage(edges), cut_lineage(known)
    size = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    good = None
    for _ in range(rounds):
        good = (edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("hits"))
                .where(F.col("hits") >= support).join(size, "pattern")
                .withColumn("conf", F.col("hits") / F.col("instances")).where(F.col("conf") >= confidence))
        good = cut_lineage(good.select("pattern", "kind", "conf"))
        score = (edges.join(good, "pattern").groupBy("instance", "kind")
                 .agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("score")).where(F.col("score") >= confidence))
        fresh = score.select("instance", "kind").join(known.select("instance"), "instance", "left_anti")
        if fresh.isEmpty():
            break
        known = cut_lineage(known.unionByName(fresh))
    hits = (seen.where("kind < 0").withColumn("pattern", F.explode("patterns")).drop("kind").join(good, "pattern")
            .groupBy("row", "start", "end", "instance").agg(F.max(F.struct("conf", (-F.col("kind")).alias("kind"))).alias("best"))
            .groupBy(F.col("row").alias("a_row"))
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("best.kind")).alias("kind"), "start", "end", F.col("instance").alias("text")))).alias("added")))
    return (rows.join(hits, F.col("row") == F.col("a_row"), "left")
            .select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int,text:string>>")).alias("added")))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_report(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of their list, and the list of all spans."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    everything = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(everything).alias("spans"))
