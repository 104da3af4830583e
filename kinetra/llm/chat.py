"""Chat formatting from the perspective of every participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinetra.llm.common import require

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns per rendered part: what one row holds of a conversation, however long it is.
PART = 256


def _unmarked(c: Column) -> Column:
    """Text that can't be read as a control marker."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, directors: tuple[str, ...] = ("system",), part_turns: int = PART) -> DataFrame:
    """Renders each conversation (conv_id, turn, role, text) once for every participant.

    In a rendering the perspective's own turns are the assistant's, turns of other participants are a user's with
    the participant's name, and turns of `directors` stay system turns. `mask` lists start:end spans, in code points
    of the rendered text, of what the assistant says with the closing marker: the tokens to learn.

    Result: conv_id, perspective, part (long), n_turns, n_own, text, mask, mask_chars (long). A part holds the turns
    with one value of floor(turn / part_turns), in order of (turn, role, text), so a conversation of any length
    spreads over rows of bounded size; most have part 0 alone. Turns are gathered once per part and then rendered for
    each participant.

    Null role: a participant called `unknown`. Null text: empty. Null turn: part -1, null conv_id: one conversation.
    Repeated rows are rendered as often as they come. Markers within text or names are broken by a space.
    Conversations that only directors speak in give no rows. Other columns are ignored.
    """
    require(turns, "conv_id", "turn", "role", "text")
    role = F.regexp_replace(_unmarked(F.coalesce(F.col("role"), F.lit("unknown"))), r"\s", "_")
    rows = turns.select("conv_id", "turn", role.alias("role"), _unmarked(F.col("text")).alias("text"),
                        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"))
    parts = (rows.groupBy("conv_id", "part")
             .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said")))
    people = (rows.select(F.col("conv_id").alias("p_conv"), F.col("role").alias("perspective")).distinct()
              .where(~F.col("perspective").isin(*directors)))
    both = parts.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv")))

    def head(t: Column) -> Column:
        return F.concat(F.lit(OPEN), F.when(t["role"].isin(*directors), F.lit("system"))
                        .when(t["role"] == F.col("perspective"), F.lit("assistant"))
                        .otherwise(F.concat(F.lit("user name="), t["role"])), F.lit("\n"))

    own = lambda t: t["role"] == F.col("perspective")
    pieces = F.transform("said", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), own(t).alias("own")))
    both = both.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("chars"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
                        F.when(p["own"], acc["chars"] + F.length(p["body"])).otherwise(acc["chars"]).alias("chars"))

    both = both.withColumn("masks", F.aggregate("pieces", start, step))
    return both.select(
        "conv_id", "perspective", "part", F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.array_join("masks.spans", ",").alias("mask"), F.col("masks.chars").cast("long").alias("mask_chars"))
