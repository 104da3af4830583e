"""Tokenising documents and packing the pieces into sequences by vector best-fit."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetra.llm.common import give_back, require

#: Words whose ids a task remembers, and the longest text that is remembered or given to the fast encoder.
REMEMBERED, LONG_WORD = 200_000, 400
#: Documents per packing task, on average.
SHARD = 4096
#: Bytes of ids in one output batch.
_FLUSH = 8 << 20
_SPECIAL = "<|endoftext|>"
#: A space that no visible character follows.
_RUN = re.compile(r" (?:\s|\Z)")


class Encoder(dict):
    """Text to little-endian unsigned 32-bit ids, equal to those of the tokenizer file.

    In byte-level BPE with this split pattern, a space before a visible character always begins a new piece, so
    the ids of a text are those of its space-led words in a row. Each word is encoded once and remembered. Texts
    with runs of white space, special tokens or very long words go to the tokenizer whole.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None):
        super().__init__()
        self.tokenizer = tokenizer
        self.words = self._ranked(ranks) if ranks else None

    @cached_property
    def whole(self):
        """The tokenizer itself, where a text asks for it."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.tokenizer)

    @staticmethod
    def _ranked(ranks: str):
        import public_tokenizers
        import tiktoken
        with open(ranks, "rb") as f:
            pairs = dict(line.split() for line in f if line.strip())
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={base64.b64decode(k): int(v) for k, v in pairs.items()})

    def _full(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _some(self, text: str) -> bytes:
        return array("I", self.words.encode_ordinary(text)).tobytes() if self.words and len(text) <= LONG_WORD else self._full(text)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self._some(" " + word)
        if len(word) <= LONG_WORD:
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if _SPECIAL in text or _RUN.search(text):
            return self._full(text)
        first, *rest = text.split(" ")
        return self._some(first) + b"".join(map(self.__getitem__, rest))


_ENCODERS: dict[tuple, Encoder] = {}


def _pieces(tokenizer: str, ranks: str | None, limit: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One encoder for each Python worker, which runs many tasks.
        enc = _ENCODERS.get((tokenizer, ranks)) or _ENCODERS.setdefault((tokenizer, ranks), Encoder(tokenizer, ranks))
        tail = array("I", [end]).tobytes()
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            ids, piece, start, length, data = map(list, zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(data, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = enc.encode(text.as_py() or "") + tail
                n = len(data) // 4
                ends = range((n - 1) % limit + 1, n + 1, limit)
                at = 0
                for k, stop in enumerate(ends):
                    rows.append((doc_id.as_py(), k, at, stop - at, data[4 * at:4 * stop]))
                    at = stop
                held += len(data)
                if held >= _FLUSH:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()
        rows.clear()
        enc.clear()
        give_back()
    return cut


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, limit: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each document (doc_id, text).

    A document's ids are the tokenizer's without special ones added, then `end`. Those of more than `limit` ids
    are cut into pieces of `limit`, of which the first may be shorter. `ranks` may name the same vocabulary in
    rank form, which encodes single words faster. Null text counts as empty: the end id alone.
    """
    require(docs, "doc_id", "text")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_pieces(tokenizer, ranks, limit, end), "doc_id long, piece int, start long, length long, ids binary"))


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: float, rule: str = "norm",
             weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> np.ndarray:
    """The bin of each item, longest items first.

    An item takes (length, 1, length**2) of a bin's tokens, documents and attention cost. Of the bins where all
    three still fit, rule `norm` takes the one with the least weighted norm of what would be left, `dot` the one
    with the greatest weighted dot product of item and residual; the oldest on ties. Else a new bin opens.
    """
    cap = np.array([tokens, documents, attention], dtype=float)
    w = np.asarray(weights, dtype=float)
    left = np.empty((3, max(1, len(lengths))))
    bins = np.empty(len(lengths), dtype=np.int64)
    live = np.empty(max(1, len(lengths)), dtype=np.int64)
    n = used = 0
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min() if len(lengths) else 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if (need > cap).any():
            raise ValueError(f"an item of {lengths[i]} tokens fits no bin")
        room = left[:, :n] - need[:, None]
        fits = (room >= 0).all(axis=0)
        if fits.any():
            if rule == "norm":
                score = -((room / cap[:, None]) ** 2 * w[:, None]).sum(axis=0)
            else:
                score = (left[:, :n] / cap[:, None] * (need / cap * w)[:, None]).sum(axis=0)
            b = int(np.argmax(np.where(fits, score, -np.inf)))
            left[:, b] -= need
        else:
            b, n = n, n + 1
            left[:, b] = cap - need
            live[b] = used
            used += 1
        bins[i] = live[b]
        if left[0, b] < least or left[1, b] < 1:  # full: out of the search, the order of the others stays
            left[:, b:n - 1] = left[:, b + 1:n].copy()
            live[b:n - 1] = live[b + 1:n].copy()
            n -= 1
    return bins


def pack_pieces(pieces: DataFrame, documents: int, limit: int = 2048, most_docs: int | None = None, attention: float | None = None,
                rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0), shard_docs: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length and any others).

    Pieces are dealt by a hash of what identifies them to shards of about `shard_docs` documents, `documents` being
    the number of all; a shard has one short piece per document at most, and each is packed on its own by
    `best_fit` under the capacities for tokens, documents (`limit` of them by default) and attention cost
    (`limit`**2, the cost of one document that fills a sequence). A shard leaves one half-filled sequence or two.
    Offsets run from 0 without gaps; ids of sequences are unique, their values mean nothing.

    Repeated rows and null doc_ids are packed like others. A column called shard, sequence_id or offset is replaced.
    """
    require(pieces, "doc_id", "piece", "start", "length")
    most_docs = limit if most_docs is None else most_docs
    attention = float(limit) ** 2 if attention is None else attention
    shards = max(1, -(-documents // shard_docs))
    names = [c for c in pieces.columns if c not in ("shard", "sequence_id", "offset")]
    rows = pieces.select(*names, F.pmod(F.xxhash64("doc_id", "piece", "start", "length"), F.lit(shards)).alias("shard"))
    schema = rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("shard").schema

    def pack(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.drop_columns(["shard"]).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        bins = best_fit(lengths, limit, most_docs, attention, rule, weights)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        new = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
        base = np.repeat((ends - lengths[order])[new], np.diff(np.r_[new, len(order)]))
        offset = np.empty(len(order), np.int64)
        offset[order] = ends - lengths[order] - base
        return (table.append_column("sequence_id", pa.array(bins + (shard << 32), pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    return rows.groupBy("shard").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, limit: int = 2048, columns=("ids",), **options) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset and `columns` (names or expressions over ids) of all pieces.

    Documents are counted, tokenised and packed; no rows in, no rows out.
    """
    pieces = token_pieces(docs, tokenizer, ranks, limit).select("doc_id", "piece", "start", "length", *columns)
    return pack_pieces(pieces, docs.count(), limit, **options)
