"""N-gram Jaccard join by prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetra.llm.common import free_name, give_back, require, roughly_in, settle
from kinetra.llm.components import connected_components
from kinetra.operators.sequence import cut_lineage

#: Words whose hashes a task remembers.
REMEMBERED = 300_000
#: Sizes at which the classes of set sizes begin; neighbouring classes overlap as far as a link may reach.
_STEPS = (1, 45, 300, 1200, 4800)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class _Words(dict):
    """Word (bytes) -> its 64-bit hash (bytes)."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _B
    x = (x ^ (x >> _HALF)) * _B
    return x ^ (x >> _HALF)


def shingles(text: str | None, words: _Words, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words, lower-cased in A-Z; of all words if there are fewer."""
    raw = (text or "").encode("utf-8", "replace").lower().split()
    h = np.frombuffer(b"".join(map(words.__getitem__, raw)), dtype="<u8")
    if not len(h):
        return h
    m = min(width, len(h))
    acc = np.full(len(h) - m + 1, m, dtype=np.uint64)
    for j in range(m):
        acc = _mix(acc * _A + h[j:len(h) - m + 1 + j])
    return np.unique(acc)


def _size_classes(keep: tuple[int, int]) -> list[tuple[int, int, float]]:
    """(smallest size, largest size, part of the hash range that is counted) of each class of set sizes.

    Two linked sets share a class: a class reaches down by the threshold's factor. The part leaves a prefix's worth of
    tokens in nearly all sets of the class; a set that has fewer adds its next ones.
    """
    num, den = keep
    q = 1 - num / den
    out = []
    for first, after in zip(_STEPS, (*_STEPS[1:], None)):
        low = -(-first * num // den) if first > 1 else 1
        part = 1.0 if low < 20 else min(1.0, q + 3 * sqrt(q * (1 - q) / low) + 1 / low)
        out.append((low, (after - 1) if after else 1 << 62, part))
    return out


def _prefix(n: int, keep: tuple[int, int]) -> int:
    """Of a set of n tokens in any order, the first so many hold one of any linked set's first so many."""
    return n - -(-n * keep[0] // keep[1]) + 1


def _token_rows(width: int, keep: tuple[int, int]):
    classes = _size_classes(keep)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            values, ends = [], [0]
            for doc_id, mark, text in zip(*(batch.column(i) for i in range(3))):
                s = shingles(text.as_py(), words, width)
                n = len(s)
                name = int(np.add.reduce(_mix(s + _A)).astype(np.int64)) if n else 0
                mine = [k for k, (low, high, _) in enumerate(classes) if low <= n <= high] or [-1]
                for first, k in enumerate(mine):
                    counted = sure = 0
                    if n:
                        part = classes[k][2]
                        sure = n if part >= 1 else int(np.searchsorted(s, np.uint64(int(part * 2 ** 64))))
                        counted = max(sure, _prefix(n, keep))
                    values.append((s[:counted] ^ np.uint64((k + 1) * int(_A) % 2 ** 64)).astype(np.int64))
                    ends.append(ends[-1] + counted)
                    for c, v in zip(cols, (doc_id.as_py(), mark.as_py(), name, n, k, first == 0, sure)):
                        c.append(v)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), tokens],
                                             ["doc_id", "mark", "cls", "n", "part", "main", "sure", "tokens"])
        words.clear()
        give_back()
    return rows


def _whole_sets(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            names, values, ends = [], [], [0]
            for text in batch.column(0):
                s = shingles(text.as_py(), words, width)
                names.append(int(np.add.reduce(_mix(s + _A)).astype(np.int64)))
                values.append(s.astype(np.int64))
                ends.append(ends[-1] + len(s))
            if names:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))], ["cls", "tokens"])
        words.clear()
        give_back()
    return rows


def _may_link(n: Column, m: Column, i: Column, j: Column, keep: tuple[int, int]) -> Column:
    """Length and positional filter for sets of n and m tokens that meet at places i and j of their prefixes."""
    num, den = F.lit(keep[0]).cast("long"), F.lit(keep[1]).cast("long")
    most = 1 + F.least(n - i, m - j)
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (most * (num + den) >= num * (n + m))


def _profiles(rows: DataFrame, keep: tuple[int, int]) -> DataFrame:
    """cls, part, n, first (token, pos) and the tokens of the prefixes under two other orders, of sets that may link."""
    posts = (rows.select("cls", "part", "n", "sure", F.posexplode("tokens").alias("at", "token"))
             .select("cls", "part", "n", "sure", "token", F.when(F.col("at") >= F.col("sure"), F.col("at") + 1).otherwise(0).alias("beyond")))
    seen = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("token", "d_token")
    shared = (posts.join(seen, F.col("token") == F.col("d_token"))
              .groupBy("cls", "part", "n", "sure").agg(F.collect_set(F.struct("beyond", "df", "token")).alias("t")))
    prefix = (F.col("n") - F.ceil(F.col("n") * keep[0] / F.lit(keep[1])) + 1).cast("int")
    shared = (shared.withColumn("p", prefix)
              .withColumn("inner", F.filter("t", lambda t: t["beyond"] == 0))
              .withColumn("outer", F.filter("t", lambda t: (t["beyond"] > 0) & (t["beyond"] <= F.col("p"))))
              .withColumn("alone", F.col("sure") - F.size("inner"))
              .withColumn("room", F.greatest(F.lit(0), F.least(F.size("inner"), F.col("p") - F.col("alone"))))
              .where("room > 0 or size(outer) > 0"))

    def ordered(seed: int, coarse: Column | None = None) -> Column:
        """The tokens of the prefix: tokens that few sets have come first; a seeded hash orders those alike."""
        rank = (lambda t: t["df"]) if coarse is None else (lambda t: F.floor(F.log2(t["df"].cast("double")) / coarse).cast("long"))
        order = F.array_sort(F.transform("inner", lambda t: F.struct(rank(t).alias("r"), F.xxhash64(t["token"], F.lit(seed)).alias("h"), t["token"])))
        return F.transform(F.slice(order, F.lit(1), F.col("room")), lambda t: t["token"])

    first = F.concat(F.transform(ordered(1), lambda t, i: F.struct(t.alias("token"), (F.col("alone") + i + 1).alias("pos"))),
                     F.transform("outer", lambda t: F.struct(t["token"], t["beyond"].alias("pos"))))
    others = [F.concat(ordered(s, F.lit(c)), F.transform("outer", lambda t: t["token"])) for s, c in ((2, 1.0), (3, 2.0))]
    return shared.select("cls", "part", F.col("n").cast("long").alias("n"), first.alias("first"), others[0].alias("second"), others[1].alias("third"))


def _filtered(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (part, a, b) whose prefixes meet under the other orders too."""
    side = lambda x: (roughly_in(profiles, F.col("cls"), pairs, F.col(x))
                      .select(F.col("part").alias(f"{x}_part"), F.col("cls").alias(f"{x}_cls"),
                              F.col("second").alias(f"{x}_second"), F.col("third").alias(f"{x}_third")))
    both = (pairs.join(side("a"), (F.col("part") == F.col("a_part")) & (F.col("a") == F.col("a_cls")))
            .join(side("b"), (F.col("part") == F.col("b_part")) & (F.col("b") == F.col("b_cls"))))
    return both.where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third")).select("a", "b").distinct()


def _compared(pairs: DataFrame, sets: DataFrame, keep: tuple[int, int]) -> DataFrame:
    """a, b, whether they link by their whole sets, b's size and the tokens that only one has."""
    side = lambda x: (roughly_in(sets, F.col("cls"), pairs, F.col(x))
                      .select(F.col("cls").alias(f"{x}_cls"), F.col("tokens").alias(f"{x}_tokens")))
    both = pairs.join(side("a"), F.col("a") == F.col("a_cls")).join(side("b"), F.col("b") == F.col("b_cls"))
    total = (F.size("a_tokens") + F.size("b_tokens")).cast("long")
    both = both.withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")).withColumn("total", total)
    return both.select("a", "b", (F.col("common") * (keep[0] + keep[1]) >= keep[0] * F.col("total")).alias("linked"),
                       F.size("b_tokens").cast("long").alias("n"),
                       F.concat(F.array_except("a_tokens", "b_tokens"), F.array_except("b_tokens", "a_tokens")).alias("differs"))


def _by_difference(compared: DataFrame, groups: DataFrame, keep: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components that were compared to the same set, not both linked to it, and may link.

    Sets x and y that differ from a set l by dx and dy tokens differ by dx + dy less twice the tokens that their
    differences share. Linked to l are all that could link without sharing any, so the others must share some:
    rarest first, differences meet in an early place or are too far apart.
    """
    # A pair that was compared to several same sets is looked for at the least of them alone.
    compared = compared.withColumn("leads", F.collect_set("a").over(Window.partitionBy("b")))
    rows = compared.select(F.col("a").alias("l"), F.col("b").alias("x"), "n", "linked", "leads", F.size("differs").cast("long").alias("d"), F.explode("differs").alias("token"))
    times = rows.groupBy("l", "token").agg(F.count("*").alias("times")).select(F.col("l").alias("t_l"), F.col("token").alias("t_token"), "times")
    # Tokens of one difference alone come first in its order; they are counted, not moved on.
    rows = rows.join(times.where("times > 1"), (F.col("l") == F.col("t_l")) & (F.col("token") == F.col("t_token"))).drop("t_l", "t_token")
    mine = Window.partitionBy("l", "x")
    rows = rows.withColumn("pos", F.col("d") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("times", "token")))
    rows = rows.join(groups, F.col("x") == F.col("node"), "left").withColumn("component", F.coalesce("component", "x")).drop("node", "times")
    side = lambda s: rows.select(*[F.col(c).alias(f"{s}_{c}") for c in ("l", "x", "n", "d", "token", "pos", "component", "linked", "leads")])
    p, q = side("p"), side("q")
    shared = 1 + F.least(F.col("p_d") - F.col("p_pos"), F.col("q_d") - F.col("q_pos"))
    near = (F.col("p_d") + F.col("q_d") - 2 * shared) * (keep[1] + keep[0]) <= (F.col("p_n") + F.col("q_n")) * (keep[1] - keep[0])
    return p.join(q, (F.col("p_l") == F.col("q_l")) & (F.col("p_token") == F.col("q_token")) & (F.col("p_component") < F.col("q_component"))
                  & ~(F.col("p_linked") & F.col("q_linked")) & near
                  & (F.array_min(F.array_intersect("p_leads", "q_leads")) == F.col("p_l"))) \
        .select(F.col("p_x").alias("a"), F.col("q_x").alias("b"))


def similar_documents(docs: DataFrame, width: int = 3, keep: tuple[int, int] = (90, 100), crowd: int = 16) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of `docs` (doc_id, text).

    A document's set holds its distinct runs of `width` words (its whole sequence, if shorter); sets link when
    keep[1] * intersection >= keep[0] * union, and components follow links. component_id is the smallest doc_id of
    the component.

    Equal sets are one class, named by a 64-bit sum of their tokens' hashes. Three global orders sort tokens: those of
    few sets first, by the exact count, its power of two or of four, then by a seeded hash. Linked sets share a token in
    their prefixes under each order. The counts cover the tokens with the smallest hashes, enough to hold the prefixes
    of nearly all sets; sets with too few add their next ones in hash order, which is part of each global order.
    Tokens that one set alone has take up places of a prefix, but are never sent on.

    Sets that meet under the first order and pass the length and positional filters are candidates if they also meet
    under the two others; candidates are verified on whole sets. A token with more than `crowd` sets is not expanded
    into all its pairs: its sets are first compared to its most central one. Then pairs that this doesn't connect
    follow: those compared to the same set with `crowd` followers or more by an index of what they differ from it in
    (those that share no difference would have linked to it), all others directly. So components are exact, and a group
    of near copies costs about one comparison a member and one for each pair that shares its own changes.

    Null, empty and wordless texts: no shingles, component_id is their own doc_id. Null doc_ids are never the smallest.
    Repeated rows are in one class. Other columns are ignored. No rows in, no rows out.
    """
    require(docs, "doc_id", "text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    rows = cut_lineage(source.mapInArrow(
        _token_rows(width, keep), "doc_id long, mark long, cls long, n int, part int, main boolean, sure int, tokens array<long>"))
    light = rows.where("main").select("doc_id", "mark", "cls", "n")
    profiles = cut_lineage(_profiles(rows.where("n > 0"), keep))

    meets = profiles.select("part", "cls", "n", F.inline("first"))
    sizes = meets.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select(F.col("token").alias("c_token"), "sets")
    few = meets.join(sizes.where(F.col("sets") <= crowd), F.col("token") == F.col("c_token")).drop("c_token", "sets")
    p, q = (few.select(*[F.col(c).alias(f"{x}_{c}") for c in ("part", "token", "n", "pos", "cls")]) for x in "pq")
    few = cut_lineage(p.join(q, (F.col("p_token") == F.col("q_token")) & (F.col("p_cls") < F.col("q_cls"))
                             & _may_link(F.col("p_n"), F.col("q_n"), F.col("p_pos"), F.col("q_pos"), keep))
                      .select(F.col("p_part").alias("part"), F.col("p_cls").alias("a"), F.col("q_cls").alias("b")).distinct())
    meets = cut_lineage(meets.join(sizes.where(F.col("sets") > crowd), F.col("token") == F.col("c_token")).drop("c_token", "sets"))

    lowest = F.lit(-2 ** 63).cast("long")
    meeting = (meets.select(F.col("cls").alias("w_cls")).unionByName(few.select(F.col("a").alias("w_cls"))).unionByName(few.select(F.col("b").alias("w_cls")))
               .distinct())
    stands = cut_lineage(light.join(meeting, F.col("cls") == F.col("w_cls")).groupBy("cls")
                         .agg(F.min(F.struct(F.coalesce("doc_id", lowest).alias("w_id"), F.col("mark").alias("w_mark"))).alias("w")).select("cls", "w.*"))

    def compared(pairs: DataFrame) -> DataFrame:
        """Whole sets are made again from the texts of the documents that stand for the pairs' classes."""
        inside = pairs.select(F.col("a").alias("i_cls")).unionByName(pairs.select(F.col("b").alias("i_cls"))).distinct()
        wanted = cut_lineage(stands.join(inside, F.col("cls") == F.col("i_cls")).select("w_id", "w_mark").distinct())
        near = roughly_in(source, F.coalesce("doc_id", lowest), wanted, F.col("w_id"))
        here = (F.coalesce("doc_id", lowest) == F.col("w_id")) & (F.col("mark") == F.col("w_mark"))
        sets = cut_lineage(near.join(wanted, here, "left_semi").select("text").mapInArrow(_whole_sets(width), "cls long, tokens array<long>"))
        return _compared(pairs, sets, keep)

    # A token that few sets have gives all its pairs. A crowded one's most central set, the one with the fewest tokens that others lack, is compared to all others there.
    lead = (meets.groupBy("token").agg(F.min(F.struct("pos", "n", "cls")).alias("s"))
            .select(F.col("token").alias("l_token"), F.col("s.pos").alias("l_pos"), F.col("s.n").alias("l_n"), F.col("s.cls").alias("l_cls")))
    led = meets.join(lead, F.col("token") == F.col("l_token")).drop("l_token")
    led = led.withColumn("may", _may_link(F.col("n"), F.col("l_n"), F.col("pos"), F.col("l_pos"), keep) & (F.col("cls") != F.col("l_cls")))
    pairs = cut_lineage(few.unionByName(led.where("may").select("part", F.col("l_cls").alias("a"), F.col("cls").alias("b"))).distinct())
    pairs = cut_lineage(_filtered(pairs, profiles))
    crowded = pairs.groupBy(F.col("a").alias("c_a")).agg(F.count("*").alias("c_n")).where(F.col("c_n") >= crowd).select("c_a")
    stars = compared(pairs).join(crowded, F.col("a") == F.col("c_a"), "left")
    stars = cut_lineage(stars.select("a", "b", "linked", "n", F.when(F.col("c_a").isNotNull(), F.col("differs")).alias("differs")))
    links = stars.where("linked").select("a", "b")
    # Enough to leave out most pairs that are connected by now: a linked set goes by one leader's name, a leader by its own.
    groups = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    groups = cut_lineage(groups.join(links.select(F.col("a").alias("lead")).distinct(), F.col("node") == F.col("lead"), "left_anti"))

    # Sets compared to the same crowded one meet by what they differ in; all other pairs of a token directly.
    around = stars.where("differs is not null")
    follows = around.select(F.col("a").alias("f_a"), F.col("b").alias("f_b"))
    now = (led.join(follows, (F.col("l_cls") == F.col("f_a")) & (F.col("cls") == F.col("f_b")), "left")
           .select("part", "token", "n", "pos", "cls", (F.col("f_a").isNotNull() | (F.col("cls") == F.col("l_cls"))).alias("known"))
           .join(groups, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls")).drop("node"))
    spread = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(F.col("token").alias("s_token"))
    now = cut_lineage(now.join(spread, F.col("token") == F.col("s_token")).drop("s_token"))
    p, q = (now.select(*[F.col(c).alias(f"{x}_{c}") for c in ("part", "token", "n", "pos", "cls", "known", "component")]) for x in "pq")
    direct = (p.join(q, (F.col("p_token") == F.col("q_token")) & (F.col("p_component") < F.col("q_component")) & ~(F.col("p_known") & F.col("q_known"))
                     & _may_link(F.col("p_n"), F.col("q_n"), F.col("p_pos"), F.col("q_pos"), keep))
              .select(F.col("p_part").alias("part"), F.col("p_cls").alias("a"), F.col("q_cls").alias("b")).distinct())
    pairs = cut_lineage(_filtered(direct, profiles).unionByName(_by_difference(around, groups, keep)).distinct())
    more = cut_lineage(compared(pairs).where("linked").select("a", "b"))
    groups = connected_components(links.unionByName(more))
    classes = light.groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = classes.join(groups, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id")).withColumnRenamed("component", "c_component")
    named = (named.join(lows, F.col("component") == F.col("c_component")).select(F.col("cls").alias("n_cls"), "component_id"))
    return (light.join(named, F.col("cls") == F.col("n_cls"), "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def drop_similar_documents(docs: DataFrame, width: int = 5, keep: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of `docs` whose doc_id names their component, with all their columns; rows without doc_id stay."""
    ident = free_name(docs, "ident")
    gone = cut_lineage(similar_documents(docs, width, keep).where("component_id is not null and doc_id <> component_id")
                       .select(F.col("doc_id").alias(ident)).distinct())
    key = F.col("doc_id").cast("long")
    return settle(docs, key, gone, F.col(ident), lambda rows: rows.join(gone, key == F.col(ident), "left_anti"))
