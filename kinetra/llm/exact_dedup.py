"""Exact duplicates by content hash, with the bytes compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinetra.llm.common import free_name, require, settle, unspaced
from kinetra.operators.sequence import cut_lineage


#: One code point more outweighs any doc_id; a missing doc_id comes after all others.
_STEP = 2 ** 64
_LAST = 2 ** 63


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, digest=_md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of `docs` (doc_id, text).

    Texts are equal when they are after deleting white space; null counts as empty. The row with the most code
    points in the original text stays, of those the one with the smallest doc_id (null last).

    Groups form on the 128-bit digest and, inside it, on the bytes of the text: both are grouping keys, so texts
    whose digests collide stay apart. Each task first folds its own copies, so a group of any size reaches the
    shuffle as one row per task. Rows then find their group by digest and SHA-256 in a join of slim rows, whose
    hot keys Spark splits.

    Rows that repeat a doc_id with the same text are counted in group_size; one of them is kept at most.
    `digest` is a parameter for tests with short digests. Other columns are ignored. No rows in, no rows out.
    """
    require(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), unspaced(F.col("text")).alias("norm"),
                       F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    rank = F.col("size").cast("decimal(12,0)") * _whole(_STEP) - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), _whole(_LAST))
    groups = (rows.groupBy("digest", "norm")
              .agg(F.count("*").alias("group_size"), F.max("size").alias("keep_size"), F.max(rank).alias("rank"))
              .withColumn("low", F.col("keep_size").cast("decimal(12,0)") * _whole(_STEP) - F.col("rank"))
              .select(F.col("digest").alias("g_digest"), F.sha2("norm", 256).alias("g_sha"), "group_size", "keep_size",
                      F.when(F.col("low") < _whole(_LAST), F.col("low").cast("long")).alias("keep_id")))
    slim = rows.groupBy("doc_id", "digest", F.sha2("norm", 256).alias("sha"), "size").agg(F.count("*").alias("copies"))
    joined = slim.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("sha") == F.col("g_sha")))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return (joined.select("doc_id", "keep_id", "group_size", "size", "keep_size", "sha", copy)
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size")) & (F.col("copy") == 1)).alias("kept"),
                    F.col("sha").alias("text_sha256")))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with all their columns, whatever they are called.

    A repeated row comes once. A doc_id of -2**63 counts as missing here.
    """
    none = F.lit(-2 ** 63).cast("long")
    ident, sha, k_id, k_sha = (free_name(docs, x) for x in ("ident", "sha", "keptident", "keptsha"))
    found = cut_lineage(exact_duplicates(docs).where("not kept or group_size > 1")
                        .select(F.coalesce("doc_id", none).alias(k_id), F.col("text_sha256").alias(k_sha), "kept"))

    def exact(rows: DataFrame) -> DataFrame:
        kept = found.where("kept").drop("kept")
        marked = rows.withColumn(ident, F.coalesce(F.col("doc_id").cast("long"), none)).withColumn(sha, F.sha2(unspaced(F.col("text")), 256))
        alone = marked.join(found.select(F.col(k_sha)).distinct(), F.col(sha) == F.col(k_sha), "left_anti")
        return (alone.unionByName(marked.join(kept, (F.col(ident) == F.col(k_id)) & (F.col(sha) == F.col(k_sha)), "left_semi").dropDuplicates([ident, sha]))
                .drop(ident, sha))

    return settle(docs, F.coalesce(F.col("doc_id").cast("long"), none), found, F.col(k_id), exact)
