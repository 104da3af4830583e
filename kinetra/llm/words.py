"""Words of whole Arrow text columns as 64-bit hashes, by array operations over their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; longer texts are cut at white space.
CHUNK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_B = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _HALF)) * _B
    x = (x ^ (x >> _HALF)) * _B
    return x ^ (x >> _HALF)


#: A number for each byte, A-Z as a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))
_BYTE[65:91] = _BYTE[97:123]


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a text column, in order: `hashes` (64 bits, A-Z lower-cased), `row` and `line` (line feeds before it in its text)."""

    def __init__(self) -> None:
        self._up, self._down = _powers(_FACTOR, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)

    def _hashed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        up, down = (self._up, self._down) if n < len(self._up) else (_powers(_FACTOR, n + 1), _powers(_INVERSE, n + 1))
        # A word's hash is the sum of its bytes' numbers by powers of the factor, counted from its start.
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    @staticmethod
    def _cuts(offsets: np.ndarray, data: np.ndarray) -> list[int]:
        """Places between rows, or at white space within long ones, about CHUNK bytes apart."""
        cuts, at, end = [int(offsets[0])], int(offsets[0]), int(offsets[-1])
        while end - at > CHUNK:
            row = int(np.searchsorted(offsets, at + CHUNK, "right")) - 1
            stop = int(offsets[row])
            if stop <= at:
                # Within a long text: at the next white space or row after a chunk's worth of bytes.
                limit, stop = int(offsets[row + 1]), at + CHUNK
                while stop < limit and not _SPACE[data[stop]]:
                    stop += 1
            cuts.append(stop)
            at = stop
        return cuts + [end]

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hashes, row, line of all words of a string array; null counts as empty."""
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        _, where, values = column.buffers()
        offsets = np.frombuffer(where, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, np.uint8)
        hashes, rows, lines = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        feeds_before = 0
        cuts = self._cuts(offsets, data) if len(column) else []
        feed_at_row = np.zeros(len(column), np.int64)
        for lo, hi in zip(cuts, cuts[1:]):
            part = data[lo:hi]
            n = hi - lo
            first, last = np.searchsorted(offsets, (lo, hi))
            edges = offsets[first:last + 1] - lo
            edges = edges[edges < n]
            solid = ~_SPACE[part]
            opens, closes = solid.copy(), solid.copy()
            opens[1:] &= ~solid[:-1]
            closes[:-1] &= ~solid[1:]
            opens[edges] |= solid[edges]
            inner = edges[edges > 0] - 1
            closes[inner] |= solid[inner]
            starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            hashes.append(self._hashed(part, starts, ends))
            row = np.searchsorted(offsets, starts + lo, "right") - 1
            feeds = np.flatnonzero(part == 10)
            # Line feeds of the whole column before a row's first byte, for the rows that begin here.
            begins = np.flatnonzero((offsets[:-1] >= lo) & (offsets[:-1] < hi)) if first < len(column) else np.empty(0, np.int64)
            feed_at_row[begins] = feeds_before + np.searchsorted(feeds, offsets[begins] - lo)
            rows.append(row)
            lines.append(feeds_before + np.searchsorted(feeds, starts) - feed_at_row[row])
            feeds_before += len(feeds)
        return np.concatenate(hashes), np.concatenate(rows), np.concatenate(lines)


def portions(batch: pa.RecordBatch, column: int, size: int = 4 << 20):
    """The batch in slices of whole rows with about `size` bytes of text each."""
    lengths = batch.column(column).cast(pa.large_string()).fill_null("")
    _, where, _ = lengths.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[lengths.offset:lengths.offset + len(lengths) + 1] if len(lengths) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
