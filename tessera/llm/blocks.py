"""Questions that blocks of documents ask of the whole corpus, in two exchanges.

A block is a run of documents with about so many tokens, as a task reads them.
It sends the distinct keys of its tokens as sorted lists in packed rows, one
for each part of the key space, to the tasks that own the parts; these answer
each list with one value a key.  The texts of the block, compressed, and its
answers then meet in one task.  A key costs a block one entry, however often
its documents have it, so that no key is a hot one.

The name of a block says what it holds, so the documents must come in the same
order whenever they are read, as files do; else the answers do not fit, and an
error says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import tokens

U64 = np.uint64
#: Rows on their way to a block: its texts (kind 0) and the answers (kind 1).
ROW = "block long, kind int, at long, data binary"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers: the lowest bytes of all, then the next ones, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Block:
    """A run of documents: its slices, and the hash and row (numbered through) of each token."""

    def __init__(self, slices: list[pa.RecordBatch], words: np.ndarray, rows: np.ndarray):
        self.slices, self.words, self.rows = slices, words, rows
        self.n = sum(b.num_rows for b in slices)

    def column(self, name: str) -> pa.Array:
        return pa.chunked_array([b.column(name) for b in self.slices]).combine_chunks()

    def name(self) -> int:
        ids = self.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
        sums = [np.sum(tokens.mix(x ^ tokens.mix(np.arange(len(x), dtype=U64))), dtype=U64) for x in (self.words, ids)]
        return int(np.array(sums).sum(dtype=U64).view(np.int64))


def cut(batches: Iterator[pa.RecordBatch], sequence: Callable, size: int) -> Iterator[Block]:
    """Blocks of about ``size`` tokens; sequence(texts) gives the hash and row of each."""
    held, words, rows, total, n = [], [], [], 0, 0
    for batch in tokens.row_slices(batches):
        w, r = sequence(batch.column("text"))
        held.append(batch), words.append(w), rows.append(r + n)
        total, n = total + len(w), n + batch.num_rows
        if total >= size:
            yield Block(held, np.concatenate(words), np.concatenate(rows))
            held, words, rows, total, n = [], [], [], 0, 0
    if held:
        yield Block(held, np.concatenate(words), np.concatenate(rows))


def texts(documents: DataFrame, sequence: Callable, size: int) -> DataFrame:
    """The slices of each block, compressed, on their way to the block's answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for block in cut(batches, sequence, size):
            name = block.name()
            for at, batch in enumerate(block.slices):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch)
                data = squeeze.compress(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([0], pa.int32()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["block", "kind", "at", "data"])

    return documents.mapInArrow(run, ROW)


def answered(requests: DataFrame, report: Callable, schema: str) -> DataFrame:
    """report(part, rows) as record batches, for all rows of each part together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["part"] != part:
                    yield report(part, held)
                    held = []
                part = r["part"]
                held.append(r)
        if held:
            yield report(part, held)

    return requests.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def finished(texts: DataFrame, answers: DataFrame, sequence: Callable, finish: Callable, schema: str) -> DataFrame:
    """finish(block, answers by part) gives a function of a slice and its first row; blocks with the same documents have one name, and give their rows each."""

    def block(parts: dict[int, list[bytes]], got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        import zstandard

        slices = [pa.ipc.open_stream(zstandard.decompress(parts[at][0])).read_all().combine_chunks().to_batches()[0] for at in sorted(parts)]
        sequences = [sequence(b.column("text")) for b in slices]
        first = np.cumsum([0, *(b.num_rows for b in slices)])
        whole = Block(slices, np.concatenate([w for w, _ in sequences]), np.concatenate([r + n for (_, r), n in zip(sequences, first, strict=False)]))
        rows = finish(whole, got)
        for at, batch, low in zip(sorted(parts), slices, first, strict=False):
            out = rows(batch, int(low))
            for _ in parts[at]:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, got = None, {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != name and parts:
                    yield from block(parts, got)
                    parts, got = {}, {}
                name = r["block"]
                if r["kind"]:
                    got[r["at"]] = r["data"]
                else:
                    parts.setdefault(r["at"], []).append(r["data"])
        if parts:
            yield from block(parts, got)

    return texts.union(answers).repartition("block").sortWithinPartitions("block", "kind", "at").mapInArrow(run, schema)


def joined(got: dict[int, bytes], expected: int, wanted: Callable[[int], bool] = lambda at: True) -> np.ndarray:
    """The answers of the wanted parts in order, one for each of the expected keys."""
    out = np.concatenate([np.zeros(0, U64), *(unpack(got[at]) for at in sorted(got) if wanted(at))])
    if len(out) != expected:
        raise ValueError("the documents came in another order when they were read again; write them to a table first")
    return out
