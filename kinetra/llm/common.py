"""Small pieces that several operators of this package share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from kinetra.operators.sequence import shared_folder

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


def unspaced(c: Column) -> Column:
    """The text without its white space; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), SPACES, "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have yet."""
    taken, n = {c.lower() for c in df.columns}, 0
    while (name := f"_{base}{n or ''}").lower() in taken:
        n += 1
    return name


def quoted(name: str) -> Column:
    return F.col("`" + re.sub("`", "``", name) + "`")


def roughly_in(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, cells: int = 1 << 19, how: str = "left_semi") -> DataFrame:
    """Rows of `df` whose key hashes to a cell that a key of `wanted` hashes to: all that match, and few others.

    It spares the shuffle most rows before an exact join. What is broadcast are cell numbers, `cells` at most; more
    keys than cells make it let more pass. With `left_anti`, the other rows, none of which match.
    """
    cell = free_name(df, "cell")
    hit = wanted.select(F.pmod(F.xxhash64(wanted_key), F.lit(cells)).alias(cell)).distinct()
    mine = free_name(df, "mycell")
    return (df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(cells))).join(F.broadcast(hit), F.col(mine) == F.col(cell), how).drop(mine))


def settle(docs: DataFrame, key: Column, doubted: DataFrame, doubted_key: Column, exact) -> DataFrame:
    """`docs` after `exact`, a filter by a join that can only drop rows whose key is in `doubted`.

    Only rows that share a cell with a doubted key go through it; the others stay where they are, without a shuffle.
    """
    sure = roughly_in(docs, key, doubted, doubted_key, how="left_anti")
    return sure.unionByName(exact(roughly_in(docs, key, doubted, doubted_key)))


def settled(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Like a checkpoint, but compressed: a table in the shared folder, with `rows` rows a file at most where given."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """At the end of a Python task: memory that Arrow and the allocator hold but don't use goes back to the system."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
