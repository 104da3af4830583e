"""Importance resampling of documents: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetra.llm.common import free_name, give_back, require, settle
from kinetra.operators.sequence import cut_lineage

#: Hash buckets of single tokens; token pairs have as many.
BUCKETS = 1 << 16
#: Labelled rows that the target model may use, chosen by hash: the size that is broadcast.
LABELLED = 32768
#: Words whose token hashes a task remembers.
REMEMBERED = 200_000
#: Folds of doc_id. What judges a document is fitted without the labels of its own fold, so labelled and other documents are judged alike.
FOLDS = 4
#: Labelled documents that count as evidence of no difference, standard errors from which a feature speaks for the text
#: to avoid, and how many of a document's features that speak loudest are summed.
EVIDENCE, ERRORS, LOUDEST = 3.0, 2.0, 3
#: Features up to which a document's weight is a sum; a longer one weighs as this many of its average.
LENGTH = 128
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordTokens(dict):
    """Lower-cased word (bytes) -> the 32-bit hashes of its word and punctuation tokens (bytes)."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        tokens = [word] if word.isalnum() else [t.encode() for t in _TOKEN.findall(word.decode("utf-8", "replace"))]
        self[word] = got = b"".join(zlib.crc32(t).to_bytes(4, "little") for t in tokens)
        return got


def features(text: str | None, words: _WordTokens, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all tokens, then of all pairs of neighbours; empty for a text without tokens."""
    raw = (text or "").encode("utf-8", "replace").lower().split()
    h = np.frombuffer(b"".join(map(words.__getitem__, raw)), dtype="<u4").astype(np.uint64)
    pair = (h[:-1] * _MIX + h[1:]) * _MIX >> np.uint64(40)
    return np.concatenate([h % np.uint64(buckets), pair % np.uint64(buckets) + np.uint64(buckets)]).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by cell: `_tables` of features by text, wanted, avoided (null without a label) and fold."""
    words, cells = _WordTokens(), np.zeros(_CELLS, np.int64)
    raw, target, avoided, clean, n = _tables(cells)
    for batch in batches:
        for text, wanted, avoid, fold in zip(*batch.columns):
            f, k = features(text.as_py(), words), fold.as_py()
            np.add.at(raw, f, 1)
            if wanted.as_py():
                np.add.at(target[k], f, 1)
            if avoid.is_valid:
                here = np.unique(f)
                (avoided if avoid.as_py() else clean)[k, here] += 1
                n[0 if avoid.as_py() else 1, k] += 1
    words.clear()
    give_back()
    at = np.flatnonzero(cells)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])


_CELLS = 2 * BUCKETS * (1 + 3 * FOLDS) + 2 * FOLDS


def _tables(cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """Views: features of all text, of target text by fold; documents with a feature by fold, to avoid and not; such documents by fold."""
    size = 2 * BUCKETS
    return cells[:size], *cells[size:-2 * FOLDS].reshape(3, FOLDS, size), cells[-2 * FOLDS:].reshape(2, FOLDS)


def harm_ratios(avoided: np.ndarray, clean: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per fold and bucket, from the labelled documents of the other folds: how much a feature speaks for the text to avoid.

    It is the log of its documents to avoid over those that its share of the others would make, both with EVIDENCE
    added; 0 within ERRORS standard errors of that.
    """
    got, others = avoided.sum(0) - avoided, clean.sum(0) - clean
    n_got, n_others = (n.sum(1, keepdims=True) - n)[:, :, None]
    due = others * (n_got / np.maximum(n_others, 1))
    loud = (got - due >= ERRORS * np.sqrt(due + 1)) & (n_others > 0)
    return np.where(loud, np.log((got + EVIDENCE) / (due + EVIDENCE)), 0.0)


def loudest(values: np.ndarray) -> float:
    """Sum of the LOUDEST largest: a few insults count the same in a short text and in a long one."""
    return float((np.partition(values, -LOUDEST)[-LOUDEST:] if len(values) > LOUDEST else values).sum())


def log_ratios(raw: np.ndarray, target: np.ndarray, smooth: float = 1.0, without: np.ndarray | int = 0) -> np.ndarray:
    """Per bucket log p(target) - log p(raw); tokens and pairs are two models, smoothed by the count that raw text would make.

    Counts `without` are left out of the target, and the others scaled up to its size.
    """
    out = np.zeros(len(raw))
    half = len(raw) // 2
    for part in (slice(0, half), slice(half, None)):
        r, t = raw[part].astype(float), (target - without)[part].astype(float)
        if r.sum() and t.sum():
            t *= target[part].sum() / t.sum()
            # A bucket of which the target would hold next to nothing either way has a ratio near 1.
            out[part] = np.log((t + smooth) / (t.sum() * (r / r.sum()) + smooth))
    return out


def _scorer(ratios: np.ndarray, others: np.ndarray, harms: np.ndarray):
    """doc_id, mark, text and fold to doc_id, mark, log weight, that by other folds, and harm; the ratios travel with the task, tables of fixed size."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordTokens()
        for batch in batches:
            weight, held, harm = np.zeros((3, batch.num_rows))
            for i, (text, fold) in enumerate(zip(batch.column(2), batch.column(3))):
                f, k = features(text.as_py(), words), fold.as_py()
                weight[i], held[i], harm[i] = ratios[f].sum(), others[k][f].sum() * min(1.0, LENGTH / max(len(f), 1)), loudest(harms[k][f])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight), pa.array(held), pa.array(harm)],
                                             ["doc_id", "mark", "log_weight", "held_weight", "harm"])
        words.clear()
        give_back()
    return score


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest value of a column without nulls; None if k is 0 or the table empty, the smallest if k exceeds the rows.

    Each round counts equal-width bins between two values and goes on inside the bin that holds the rank.
    """
    if k < 1:
        return None
    low, high, n = df.agg(F.min(column), F.max(column), F.count("*")).first()
    if low is None or k >= n:
        return low
    left = k
    while low < high:
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1))
        found = (df.where(F.col(column).between(F.lit(low), F.lit(high))).groupBy(place.alias("bin"))
                 .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect())
        for b in sorted(found, key=lambda b: -b["bin"]):
            if left <= b["n"]:
                low, high = b["low"], b["high"]
                break
            left -= b["n"]
    return low


def importance_keys(docs: DataFrame, labels: DataFrame, target=None, recall: float = 0.999, labelled: int = LABELLED,
                    seed: int = 17, avoid=None) -> tuple[DataFrame, float | None]:
    """doc_id, mark, log_weight, held_weight, harm and gumbel_key of all `docs` (doc_id, text), and the key from which on they are drawn.

    Drawn documents look like the target and not like what is labelled as text to avoid.

    Text becomes hashed lower-case words, punctuation runs and neighbouring pairs. The raw model counts them over all
    documents, the target model over the labelled documents that `target` (a condition on `labels`; quality 1 and not
    toxic by default) picks, of which `labelled` rows at most take part, chosen by a hash of doc_id. A document's log
    weight is the sum of the log ratios of its features. Its held weight is that without the labels of its own fold of
    doc_id, so that a labelled document has no advantage, and as LENGTH average features if it has more, so that a long
    document isn't judged by the noise of its length. Its key adds Gumbel noise hashed from doc_id to the held
    weight, and the k largest keys are the sample, drawn without replacement in proportion to these weights.

    Documents to `avoid` (a condition on `labels`; toxic by default, none if only `target` is given) have a model of
    their own, of features that are in more of them than in other labelled documents. A document's `harm` is the sum of
    its loudest few, so that a few insults show in a text of any length. It comes from the labels of other folds of
    doc_id, for labelled and other documents alike. The limit is the harm that a `recall` part of the target documents
    doesn't exceed; above it the key is minus infinity: such documents are never drawn and don't count in k.

    k is the number of documents times the share of labelled ones that weigh at least as much as the lightest of a
    `recall` part of the target documents, less the noise's lower tail, plus three standard errors of that share.

    Rows whose key equals the k-th are in. `mark` is xxhash64 of the text, to tell apart rows that share a doc_id.
    Null or wordless text: weight 0. Without labelled targets all weights are 0 and every row is drawn. Repeated
    rows count and are drawn alike. Other columns are ignored. No rows in, no rows out.
    """
    require(docs, "doc_id", "text")
    avoid = avoid if avoid is not None else F.col("toxic") == 1 if target is None else F.lit(False)
    target = (F.col("quality") == 1) & (F.col("toxic") == 0) if target is None else target
    sample = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id"))
              .agg(F.min(F.coalesce(target, F.lit(False))).alias("wanted"), F.max(F.coalesce(avoid, F.lit(False))).alias("avoided"))
              .orderBy(F.xxhash64("l_id"), "l_id").limit(labelled))
    sample = cut_lineage(sample)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    # Not more than `labelled` rows of three small columns: the one table that is sent to all tasks.
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"), "left")
    sums = (marked.select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"), "avoided", fold)
            .mapInArrow(_counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))).toArrow()
    cells = np.zeros(_CELLS, np.int64)
    cells[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    raw, wanted, *by_fold = _tables(cells)
    others = np.stack([log_ratios(raw, wanted.sum(0), without=w) for w in wanted])

    scored = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").select("*", fold)
              .mapInArrow(_scorer(log_ratios(raw, wanted.sum(0)), others, harm_ratios(*by_fold)),
                          "doc_id long, mark long, log_weight double, held_weight double, harm double"))
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2 ** 53))
    scored = cut_lineage(scored.withColumn("gumbel_key", F.col("held_weight") - F.log(-F.log(unit))))

    known = scored.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("held_weight", "harm", "wanted")
    n_targets = known.where("wanted").count()
    if not n_targets:
        return scored, None
    limit = max(0.0, kth_largest(known.where("wanted"), "harm", int(n_targets * (1 - recall)) + 1))
    harmless = F.col("harm") <= F.lit(limit)
    scored = scored.withColumn("gumbel_key", F.when(harmless, F.col("gumbel_key")).otherwise(F.lit(float("-inf"))))
    known, rest = known.where(harmless), scored.where(harmless)
    targets = known.where("wanted")
    n_targets, n_known, n = targets.count(), known.count(), rest.count()
    least = kth_largest(targets, "held_weight", max(1, int(np.ceil(n_targets * recall))))
    share = known.where(F.col("held_weight") >= F.lit(least - np.log(np.log(max(n, 3))))).count() / n_known
    share = min(1.0, share + 3 * (share * (1 - share) / n_known) ** 0.5)
    cut = kth_largest(rest, "gumbel_key", int(np.ceil(share * n)))
    return scored, cut


def resample_by_importance(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, mark, log_weight, held_weight, harm and gumbel_key of the documents that `importance_keys` draws; options are the same."""
    scored, cut = importance_keys(docs, labels, **options)
    return scored if cut is None else scored.where(F.col("gumbel_key") >= F.lit(cut))


def drop_unlike_target(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `resample_by_importance` draws, with all their columns, whatever they are called."""
    scored, cut = importance_keys(docs, labels, **options)
    if cut is None:
        return docs
    ident, mark = free_name(docs, "ident"), free_name(docs, "mark")
    gone = scored.where(F.col("gumbel_key") < F.lit(cut)).select(F.col("doc_id").alias(ident), F.col("mark").alias(mark)).distinct()
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(mark))
    return settle(docs, F.col("doc_id").cast("long"), gone, F.col(ident), lambda rows: rows.join(gone, here, "left_anti"))
