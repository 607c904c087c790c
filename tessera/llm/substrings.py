"""Substring dedup: prefix-partitioned suffix trees over word sequences.

A passage of ``length`` words repeats if the same words start at a place of a
document with a smaller id.  Every word from which ``length`` words are left
begins a suffix.  The suffix tree of all of them, cut off at that depth, is
never in one place:

1. The suffixes are counted by their first word.  Words are put together, in
   the order of the tree's edges, until a group has ``GROUP`` suffixes; a word
   that begins more of them is extended by two more, and its subtree is split
   below these.  So prefixes are as long as it takes for a group to fit memory.
2. A suffix is a path of edges: the first word (16 bits of a hash), the first
   three (16 bits) and all words (48 bits).  Each block of documents sends its
   different paths, in the tree's order, to the tasks of their groups, with the
   smallest id below each.
3. A group's subtree is the merged, sorted list of paths, its internal nodes the
   runs that agree down to a depth.  The nodes of full depth with leaves of
   several documents are the repeats; each block is told at which of its paths
   a document with a smaller id is below the node.
4. With the answers a block marks its repeated passages; passages that follow
   each other make up the maximal repeats, whose words go.

A passage in a third of all documents is one path for each block, and no group
is larger for it.

Defined cases: null and empty texts have no words and lose none; very long
texts are read whole; repeated rows have one id and do not make each other
lose words, each gives a row; rows without an id are kept as they are and
remove nothing; an empty table gives an empty result; other columns, whatever
their names, are ignored or, where documents are returned, kept; a text that
loses all its words is empty.  The documents must come in the same order
whenever they are read, as files do; else an error says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import blocks, shared, tokens

#: Words of a block, and suffixes (about) of a group.
BLOCK, GROUP = 3 << 18, 1 << 20
#: Words of a longer prefix.
LONGER = 3
U64 = np.uint64


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    data, offsets = tokens.buffers(column)
    start, end, row = tokens.word_spans(data, offsets)
    return tokens.word_hashes(data, start, end), row


class Paths:
    """The suffixes of a block's documents that have an id: where they start, their ids, and their paths, whose lowest 16 bits are kept apart."""

    def __init__(self, block: blocks.Block, length: int):
        ids = block.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        at = tokens.ngram_rows(block.rows, length)
        self.at = at[known[block.rows[at]]]
        self.doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[block.rows[self.at]]
        whole, longer = (tokens.ngram_hashes(block.words, min(n, length))[self.at] for n in (length, LONGER))
        first = block.words[self.at]
        self.path = first >> U64(48) << U64(48) | longer >> U64(48) << U64(32) | whole >> U64(32)
        self.rest = whole & U64(0xFFFF)

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in the order of the tree, and where each different path begins."""
        order = np.lexsort((self.rest, self.path))
        path, rest = self.path[order], self.rest[order]
        return order, np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (rest[1:] != rest[:-1])][: len(path)])


def prefixes(documents: DataFrame, length: int) -> np.ndarray:
    """The first 32 bits of the path at which each group of suffixes begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in tokens.row_slices(batches):
            words, rows = sequence(batch.column("text"))
            total += np.bincount((words[tokens.ngram_rows(rows, length)] >> U64(48)).astype(np.int64), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["edge", "n"])

    counted = documents.mapInArrow(run, "edge long, n long").groupBy("edge").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    return group_bounds(counted.column("edge").to_numpy(), counted.column("n").to_numpy())


def group_bounds(edges: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """See ``prefixes``: light edges are put together, a heavy one is split by its longer prefixes."""
    bounds, held = [0], 0
    for edge, n in sorted(zip(edges.tolist(), counts.tolist(), strict=True)):
        if held and held + n > GROUP:
            bounds.append(edge << 16)
            held = 0
        held += n
        if n > GROUP:
            parts = min(1 << 16, -(-n // GROUP))
            bounds += [(edge << 16) + (k << 16) // parts for k in range(1, parts)] + [(edge + 1) << 16]
            held = 0
    return np.array(bounds, np.int64)


def requests(documents: DataFrame, length: int, bounds: np.ndarray) -> DataFrame:
    """part, block, paths, rests, low, docs (less low): the different paths of each block under each prefix, and the smallest id below each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.cut(batches, sequence, BLOCK):
            p, name = Paths(block, length), block.name()
            order, first = p.order()
            if not len(first):
                continue
            low = np.minimum.reduceat(p.doc[order], first)
            path, rest = p.path[order][first], p.rest[order][first]
            part = np.searchsorted(bounds, (path >> U64(32)).astype(np.int64), "right") - 1
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, b in zip(starts, np.append(starts[1:], len(path)), strict=True):
                least = int(low[a:b].min())
                columns = [pa.array(part[a : a + 1]), pa.array([name], pa.int64()), *(pa.array([blocks.pack(x)], pa.binary()) for x in (np.diff(path[a:b], prepend=U64(0)), rest[a:b])), pa.array([least], pa.int64()), pa.array([blocks.pack((low[a:b] - least).view(U64))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "paths", "rests", "low", "docs"])

    return documents.mapInArrow(run, "part long, block long, paths binary, rests binary, low long, docs binary")


def subtree(part: int, rows: list[dict]) -> pa.RecordBatch:
    """For each block's paths under a prefix whether a document with a smaller id is below the same node."""
    paths = [np.cumsum(blocks.unpack(r["paths"]), dtype=U64) for r in rows]
    path, rest = np.concatenate(paths), np.concatenate([blocks.unpack(r["rests"]) for r in rows])
    doc = np.concatenate([blocks.unpack(r["docs"]).view(np.int64) + r["low"] for r in rows])
    order = np.lexsort((rest, path))
    path, rest = path[order], rest[order]
    first = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (rest[1:] != rest[:-1])])
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(path))))
    smaller = np.zeros(len(path), U64)
    smaller[order] = least < doc[order]
    cut = np.cumsum([0, *(len(p) for p in paths)])
    answers = [blocks.pack(smaller[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.array([1] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array(answers, pa.binary())], names=["block", "kind", "at", "data"])


def covered(block: blocks.Block, got: dict[int, bytes], length: int) -> np.ndarray:
    """Which words of a block a repeated passage covers."""
    p = Paths(block, length)
    order, first = p.order()
    smaller = blocks.joined(got, len(first)).astype(bool)
    doc, times = p.doc[order], np.diff(np.append(first, len(order)))
    gone = np.repeat(smaller, times) | (doc > np.repeat(np.minimum.reduceat(doc, first), times)) if len(first) else np.zeros(0, bool)
    at = p.at[order[gone]]
    change = np.bincount(at, minlength=len(block.words) + 1) - np.bincount(at + length, minlength=len(block.words) + 1)
    return np.cumsum(change)[:-1] > 0


def without_repeats(documents: DataFrame, length: int, rows: Callable, schema) -> DataFrame:
    """rows(batch, for each row the numbers of words that go, or None) of all documents; reads text and doc_id."""
    shared.prepare(documents.sparkSession)
    answers = blocks.answered(requests(documents, length, prefixes(documents, length)), subtree, blocks.ROW)

    def finish(block: blocks.Block, got: dict[int, bytes]) -> Callable:
        at = np.flatnonzero(covered(block, got, length))
        starts, bounds = tokens.row_bounds(block.rows, block.n), np.searchsorted(block.rows[at], np.arange(block.n + 1))
        return lambda batch, low: rows(batch, [at[bounds[r] : bounds[r + 1]] - starts[r] if bounds[r + 1] > bounds[r] else None for r in range(low, low + batch.num_rows)])

    return blocks.finished(blocks.texts(documents, sequence, BLOCK), answers, sequence, finish, schema)


def kept_words(text: str, gone: np.ndarray | None) -> tuple[int, list[bytes]]:
    """Number of words, and those that stay."""
    words = text.encode().split()
    if gone is None:
        return len(words), words
    stays = np.ones(len(words), bool)
    stays[gone] = False
    return len(words), [w for w, s in zip(words, stays.tolist(), strict=True) if s]


def digests(documents: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def rows(batch: pa.RecordBatch, gone: list) -> pa.RecordBatch:
        total, removed, digest = [], [], []
        for text, own in zip(batch.column("text").to_pylist(), gone, strict=True):
            n, kept = kept_words(text, own)
            total.append(n), removed.append(n - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return without_repeats(shared.texts(documents), length, rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeats(documents: DataFrame, length: int = 13) -> DataFrame:
    """doc_id, first_word, n_words: the longest runs of words that repeated passages cover."""

    def rows(batch: pa.RecordBatch, gone: list) -> pa.RecordBatch:
        out = [(doc_id, int(run[0]), len(run)) for doc_id, own in zip(batch.column("doc_id").to_pylist(), gone, strict=True) if own is not None for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "first_word", "n_words"])

    return without_repeats(shared.texts(documents), length, rows, "doc_id long, first_word long, n_words long")


def deduplicated(documents: DataFrame, length: int = 13) -> DataFrame:
    """The documents with all their columns; a text that loses words is what is left, joined by blanks (n_chars follows, if there)."""
    names = documents.columns

    def rows(batch: pa.RecordBatch, gone: list) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        changed = {i: b" ".join(kept_words(texts[i], own)[1]).decode() for i, own in enumerate(gone) if own is not None}
        columns = dict(zip(names, batch.columns, strict=True))
        if changed:
            columns["text"] = pa.array([changed.get(i, x) for i, x in enumerate(texts)], batch.schema.field("text").type)
            if "n_chars" in names:
                counts = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(counts)], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return without_repeats(documents, length, rows, documents.schema)
