"""Word spans and hashes of Arrow string columns, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All of these
are ASCII, so cutting UTF-8 bytes gives the same words as cutting characters.
Everything works on the column's own value buffer; a document costs a few
vectorised passes, and temporary arrays are bounded by ``STEP`` bytes of text
(or one word, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed, or rows' texts that are handled, at once.
STEP = 1 << 20
#: Arrow rows a batch: bounds what a Python worker holds when texts are long.
BATCH_ROWS = 512

U64 = np.uint64
MUL = {0: 0x9E3779B97F4A7C15, 1: 0xD1342543DE82EF95}
NGRAM = {0: 0xF1357AEA2E62A9C5, 1: 0xAEF17502108EF2D9}


class Cache(dict):
    """A dict that is pickled empty: functions that use it are sent to executors, what the driver put in is not."""

    def __reduce__(self) -> tuple:
        return dict, ()


_POWERS = Cache()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_table(lane: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(256, dtype=U64) + U64(1 + 1000 * lane)) | U64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's multiplier and of its inverse, mod 2**64."""
    if lane not in _POWERS or len(_POWERS[lane][0]) < n:
        n = max(n, STEP + 4096)
        both = []
        for base in (MUL[lane], pow(MUL[lane], -1, 1 << 64)):
            p = np.full(n, U64(base))
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        _POWERS[lane] = tuple(both)
    return _POWERS[lane]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, first is 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with at most ``STEP`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(text)
        if not len(column):
            continue
        _, offsets = buffers(column)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _bytes_but(outside) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


#: Bytes of words, and of runs of ASCII letters and bytes of longer characters.
WORD = _bytes_but((32, 9, 10, 11, 12, 13))
LETTERS = _bytes_but(x for x in range(128) if not chr(x).isalpha())


def word_spans(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and row of each longest run of the given bytes in a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = of[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word; lower: A-Z count as a-z."""
    table, out = _byte_table(lane, lower), np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STEP, "right")))
        base = start[i]
        power, inverse = _powers(lane, int(end[j - 1] - base) + 1)
        values = table[data[base : end[j - 1]]]
        values *= power[: len(values)]
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(values, out=total[1:])
        out[i:j] = (total[end[i:j] - base] - total[start[i:j] - base]) * inverse[start[i:j] - base]
        i = j
    return mix(out)


def ngram_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of words i .. i+n-1 for each i, across row ends too (see ``ngram_rows``)."""
    if len(words) < n:
        return np.zeros(0, U64)
    out, size, done = np.zeros(len(words) - n + 1, U64), len(words) - n + 1, 0
    block, width, q = words, 1, NGRAM[lane]
    factor = 1
    while True:
        if n >> (width.bit_length() - 1) & 1:
            out += block[done : done + size] * U64(factor)
            factor = factor * pow(q, width, 1 << 64) % (1 << 64)
            done += width
        if done == n:
            return mix(out + U64(n))
        block = block[:-width] + block[width:] * U64(pow(q, width, 1 << 64))
        width *= 2


def ngram_rows(rows: np.ndarray, n: int) -> np.ndarray:
    """Positions of those n-grams that lie in one row."""
    if len(rows) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's words begin, and the end of the last."""
    return np.searchsorted(rows, np.arange(n_rows + 1))
