"""Fill-in-middle documents, assembled and restored from sorted pieces."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kinetra.llm.common import give_back, require

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Most bytes of a piece, but for a unit that is longer by itself.
PIECE = 1 << 16
#: Bytes of pieces in one output batch.
_FLUSH = 4 << 20
#: A document's last row, after all its pieces.
_END = 1 << 62
#: Where a section's pieces begin in the restored text.
_SECTION = {PREFIX: 0, MIDDLE: 1 << 40, SUFFIX: 2 << 40}

_PIECES = "row binary, at long, data binary, doc_id long, n long, form string"
_RESTORED = _PIECES + ", prefix_chars long, middle_chars long, output_sha256 string, copies long"
_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_TEXTS = "doc_id long, n long, form string, output string"


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit of a UTF-8 text ends: white space with the visible characters after it, or white space at the end."""
    if not text:
        return np.zeros(0, np.int64)
    b = np.frombuffer(text, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(b))


def _chars(data: bytes) -> int:
    """Code points that begin in these UTF-8 bytes."""
    b = np.frombuffer(data, np.uint8)
    return int(((b & 0xC0) != 0x80).sum())


def layout(doc_id: int | None, text: bytes, seed: int, rate: int, spm: int) -> tuple[np.ndarray, str, list]:
    """Unit ends, form, and the output as sections: a sentinel (or None) and the range of bytes that follows it."""
    ends = unit_ends(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = struct.unpack(">4I", digest[:16])
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return ends, "plain", [(None, 0, len(text))]
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (a, b))
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, len(text))
    return ends, *(("spm", [suffix, prefix, middle]) if h4 % 100 < spm else ("psm", [prefix, suffix, middle]))


def _chunks(ends: np.ndarray, start: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole units of at most `size` bytes, or one unit, from `start` to `stop`."""
    while start < stop:
        if stop - start <= size:
            yield start, stop
            return
        k = np.searchsorted(ends, start + size, side="right") - 1
        cut = int(ends[k]) if k >= 0 and ends[k] > start else int(ends[np.searchsorted(ends, start, side="right")])
        yield start, min(cut, stop)
        start = cut


class _Out:
    """Rows that go out as record batches of a bounded number of bytes."""

    def __init__(self, schema: str):
        kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        fields = [f.split() for f in schema.split(", ")]
        self.names, self.kinds = [f[0] for f in fields], [kinds[f[1]] for f in fields]
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, row: tuple, size: int) -> bool:
        """True where it is time to flush."""
        self.rows.append(row)
        self.held += size + 64
        return self.held >= _FLUSH

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), self.kinds)], self.names)
        self.rows, self.held = [], 0


def fim_pieces(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, piece: int = PIECE) -> DataFrame:
    """The pieces of each document's output: row, at (place in the output), data (UTF-8), and doc_id, n and form with the first.

    n is the number of units of the text (null counts as empty); h1 to h4 are the first 32-bit numbers of the sha256 of
    `seed:doc_id` (a missing doc_id is empty there). They choose where the middle begins and ends, and the form: `plain`, as it
    is, for empty texts, texts with a sentinel and 100 - `rate` of 100 others; of the rest `spm` of 100 are spm, the others
    psm. A piece is a sentinel or whole units of at most `piece` bytes (a longer unit is a piece).

    `row` names a document by its id, text and the task that read it, so that a row read again after a lost executor has the same
    name; equal rows of one task have equal pieces, which are counted later. Other columns are ignored.
    """
    require(docs, "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = struct.pack(">I", TaskContext.get().partitionId())
        out = _Out(_PIECES)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id, text = doc_id.as_py(), text.as_buffer().to_pybytes() if text.is_valid else b""
                ends, form, sections = layout(doc_id, text, seed, rate, spm)
                row = struct.pack(">q", doc_id or 0) + hashlib.sha256(text).digest()[:16] + task + (b"" if doc_id is not None else b"-")
                at = 0
                for sentinel, start, stop in sections:
                    data = [] if sentinel is None else [sentinel]
                    for x in (*data, *_chunks(ends, start, stop, piece)):
                        x = x if isinstance(x, bytes) else text[x[0]:x[1]]
                        if out.add((row, at, x, None if at else doc_id, None if at else len(ends), None if at else form), len(x)):
                            yield from out.flush()
                        at += 1
                if not at:  # an empty text
                    out.add((row, 0, b"", doc_id, 0, form), 0)
        yield from out.flush()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted output pieces to a digest of the output, and to pieces numbered for the original text.

    What is a sentinel and which section follows is read off the output itself: no text with a form but plain holds one.
    """
    out = _Out(_RESTORED)
    row = None

    def end() -> tuple:
        return (row, _END, None, doc_id, n, form, *((None, None) if form == "plain" else (chars[PREFIX], chars[MIDDLE])), digest.hexdigest(), copies)

    for name, at, data, *first in _stream(batches):
        if name != row:
            if row is not None:
                out.add(end(), 0)
            row, last = name, -1
            (doc_id, n, form), copies, digest = first, 0, hashlib.sha256()
            section, chars = PREFIX, dict.fromkeys(_SECTION, 0)
        copies += at == 0
        if at == last:  # the same piece of an equal row
            continue
        last = at
        digest.update(data)
        if form != "plain" and data in _SECTION:
            section = data
            continue
        chars[section] += _chars(data)
        if out.add((row, _SECTION[section] + at, data, *[None] * 7), len(data)):
            yield from out.flush()
    if row is not None:
        out.add(end(), 0)
    yield from out.flush()
    give_back()


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the original text to its digest: one row for each document."""
    out = _Out(_DIGESTS)
    digest = hashlib.sha256()
    for _, at, data, doc_id, n, form, prefix, middle, output, copies in _stream(batches):
        if at < _END:
            digest.update(data)
            continue
        for _ in range(copies):
            if out.add((doc_id, n, form, prefix, middle, output, digest.hexdigest()), 200):
                yield from out.flush()
        digest = hashlib.sha256()
    yield from out.flush()
    give_back()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(_TEXTS)
    row, parts = None, []

    def whole() -> Iterator[pa.RecordBatch]:
        text = b"".join(parts).decode()
        for _ in range(copies):
            if out.add((*first, text), len(text)):
                yield from out.flush()

    for name, at, data, *head in _stream(batches):
        if name != row:
            if row is not None:
                yield from whole()
            row, first, parts, copies, last = name, head, [], 0, -1
        copies += at == 0
        if at != last:
            parts.append(data)
        last = at
    if row is not None:
        yield from whole()
    yield from out.flush()
    give_back()


def _sorted(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("row").sortWithinPartitions("row", "at")


def fim_texts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form and output: each document's whole output text; see `fim_pieces`."""
    return _sorted(fim_pieces(docs, **options)).mapInArrow(_joined, _TEXTS)


def fim_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 for each row of `docs` (doc_id, text).

    A secondary sort: pieces are partitioned by document and sorted by their place in the output, so that a task streams them into
    an incremental digest and never holds a whole text. Pieces of the text are then sorted again, without another
    exchange, by the place that the output's own sentinels give them in the original, and streamed into the digest
    of what is restored. prefix_chars and middle_chars (code points) are null for plain ones.

    Null texts count as empty: plain, no units. Repeated rows come out as often as they go in. No rows in, no rows out.
    """
    return (_sorted(fim_pieces(docs, **options)).mapInArrow(_assembled, _RESTORED)
            .sortWithinPartitions("row", "at").mapInArrow(_restored, _DIGESTS))
