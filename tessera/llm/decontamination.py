"""Benchmark decontamination: rare-word seeds, then Smith-Waterman alignment.

Words are lower-case runs of letters and digits.  An alignment that scores the
threshold holds a certain number of the item's different words within a certain
number of words, so it holds some of any set of them that leaves out fewer than
that number.  The seeds of an item are such a set of the words that are rarest
in the training documents; which they are changes what has to be looked at, but
never the result.  Where a document holds enough seeds close together, and
enough of the item's words, it is aligned with the item: a match counts 1
(shared among the places of a word that the item repeats), a mismatch or gap
-0.5, and the best local alignment's sum over the item's different words is the
score.  Items are handled in blocks of a fixed number of words, so what is sent
to the executors is bounded whatever the size of the benchmark.

An item of fewer than ``MIN_WORDS`` words is found where its whole sequence
stands; one of fewer than ``FEWEST`` words and ``SHORTEST`` signs names no
passage and is not searched.  The index of a block goes to the executors (its
size is bounded by ``BLOCK``) instead of every document's words to a join: on
whole tables that would deal each word that some item holds.

Defined cases: null and empty texts match nothing; very long documents are read
whole; documents that occur repeatedly are reported each, and so are repeated
items; of several places with the best score the first is told; an empty table
on either side gives an empty result; other columns are ignored or, where
documents are returned, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import shared, tokens

MIN_WORDS, FEWEST, SHORTEST = 8, 3, 12
#: Words of items sent to the executors at once.
BLOCK = 1 << 20
#: Seeds that must lie close together; the more, the more seeds there are.
TOGETHER = 4
MATCH, OTHER, THRESHOLD = 1.0, -0.5, 0.5
SCHEMA = "doc_id long, item_id long, score double, n_words int, first_word long, last_word long"
_RUNS = tokens.LETTERS.copy()
_RUNS[48:58] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    data, offsets = tokens.buffers(column)
    start, end, row = tokens.word_spans(data, offsets, _RUNS)
    return tokens.word_hashes(data, start, end, lower=True), row


def word_weights(item: np.ndarray) -> np.ndarray:
    """Each word of an item counts 1 in all, however often it occurs there."""
    _, inverse, count = np.unique(item, return_inverse=True, return_counts=True)
    return 1 / count[inverse]


def align(item: np.ndarray, passage: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, int, int]:
    """Best local alignment: its sum, and the first and last aligned word of the passage.

    weights: what a match of each word of the item counts; others and gaps cost
    in proportion, words between them that the item lacks at the mean weight.

    Row by row; a gap along the passage costs the same for each word, so the
    best way into a cell from its left is a running maximum of values less
    their distance.
    """
    n = len(passage)
    weights = np.ones(len(item)) if weights is None else weights
    above, origin = np.zeros(n + 1), np.arange(n + 1)
    best, place, slope = 0.0, (0, -1), -OTHER * weights.mean() * np.arange(n + 1)
    for word, weight in zip(item, weights, strict=True):
        diagonal = above[:-1] + weight * np.where(passage == word, MATCH, OTHER)
        down = above[1:] + weight * OTHER
        value, source = np.zeros(n + 1), np.arange(n + 1)
        value[1:] = np.maximum(np.maximum(diagonal, down), 0)
        source[1:] = np.where(value[1:] <= 0, source[1:], np.where(diagonal >= down, origin[:-1], origin[1:]))
        lifted = value + slope
        peak = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == peak, np.arange(n + 1), 0))
        value, origin = peak - slope, source[at]
        above = value
        end = int(value.argmax())
        if value[end] > best:
            best, place = float(value[end]), (int(origin[end]), end - 1)
    return best, *place


class Items:
    """A block of test items with its seeds."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids, self.words, self.weights = ids, words, [word_weights(w) for w in words]
        self.distinct = [np.unique(w) for w in words]
        self.key = np.unique(np.concatenate(words))

    def choose(self, frequency: np.ndarray, threshold: float) -> None:
        """Takes the rarest words as seeds; frequency: by key."""
        self.threshold = [threshold if len(w) >= MIN_WORDS else 1.0 for w in self.words]
        self.need = np.array([max(1, int(np.ceil(t * len(d) - 1e-9))) for t, d in zip(self.threshold, self.distinct, strict=True)])
        self.together = np.minimum(self.need, TOGETHER)
        #: Words that an alignment can span: gaps cost what the matches leave above the threshold.
        self.span = np.array([len(w) + int(max(0.0, MATCH - t) / -OTHER * len(w) + 1e-9) for t, w in zip(self.threshold, self.words, strict=True)])
        seeds = []
        for d, need, together in zip(self.distinct, self.need, self.together, strict=True):
            rarest = d[np.argsort(frequency[np.searchsorted(self.key, d)], kind="stable")]
            seeds.append(rarest[: max(0, len(d) - need + together)] if need <= len(d) else rarest[:0])
        item, seed = np.repeat(np.arange(len(self.ids)), [len(s) for s in seeds]), np.concatenate(seeds)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item = seed[order], item[order]

    def places(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and place of each seed that is followed by enough more of its item's within the span."""
        first, last = np.searchsorted(self.seed, words, "left"), np.searchsorted(self.seed, words, "right")
        hit = np.flatnonzero(last > first)
        times = (last - first)[hit]
        place = np.repeat(hit, times)
        item = self.item[np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[hit], times)]
        order = np.lexsort((place, item, row[place]))
        place, item = place[order], item[order]
        of = row[place]
        end = np.arange(len(place)) + self.together[item] - 1
        inside = end < len(place)
        end = np.minimum(end, len(place) - 1)
        inside &= (of[end] == of) & (item[end] == item) & (place[end] - place < self.span[item])
        return of[inside], item[inside], place[inside]

    def enough(self, i: int, passage: np.ndarray) -> bool:
        """Whether some span of the passage holds as many different words of the item as the threshold needs."""
        own = self.distinct[i]
        which = np.minimum(np.searchsorted(own, passage), len(own) - 1)
        at = np.flatnonzero(own[which] == passage)
        if len(at) < self.need[i]:
            return False
        order = np.argsort(which[at], kind="stable")
        at, which = at[order], which[at][order]
        before = np.where(np.r_[False, which[1:] == which[:-1]], np.r_[-1, at[:-1]], -1)
        change = np.bincount(np.maximum(before + 1, np.maximum(at - self.span[i] + 1, 0)), minlength=len(passage) + 1) - np.bincount(at + 1, minlength=len(passage) + 1)
        return int(np.cumsum(change).max()) >= self.need[i]

    def matches(self, words: np.ndarray, row: np.ndarray, n_rows: int) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, last word) of every item found in a row."""
        bounds, out = tokens.row_bounds(row, n_rows), []
        of, item, place = self.places(words, row)
        cuts = [*np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (item[1:] != item[:-1])][: len(of)]).tolist(), len(of)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r, i, best = int(of[a]), int(item[a]), (0.0, 0, -1)
            begins, span = place[a:b].tolist(), int(self.span[i])
            k = 0
            while k < len(begins):
                begin = last_begin = begins[k]
                while k < len(begins) and begins[k] <= last_begin + span and begins[k] <= begin + 8 * span:
                    last_begin = begins[k]
                    k += 1
                low, high = max(bounds[r], begin - span), min(bounds[r + 1], last_begin + span)
                if self.enough(i, words[low:high]):
                    found = align(self.words[i], words[low:high], self.weights[i])
                    if found[0] > best[0]:
                        best = (found[0], found[1] + low - bounds[r], found[2] + low - bounds[r])
            score = round(best[0] / self.weights[i].sum(), 9)
            if score >= self.threshold[i]:
                out.append((r, i, score, int(best[1]), int(best[2])))
        return out


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of at most ``BLOCK`` words (or one item), read one after the other."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text")
    ids, words, size = [], [], 0
    for r in rows.toLocalIterator():
        own, _ = words_of(pa.array([r["text"]]))
        if not len(own) or len(own) < FEWEST and len(r["text"].strip()) < SHORTEST:
            continue
        if ids and size + len(own) > BLOCK:
            yield Items(ids, words)
            ids, words, size = [], [], 0
        ids.append(r["item_id"]), words.append(own)
        size += len(own)
    if ids:
        yield Items(ids, words)


def _seeded(documents: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator[Items]:
    for block in blocks(benchmark):
        key = block.key

        def count(batches: Iterator[pa.RecordBatch], key: np.ndarray = key) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(key), np.int64)
            for batch in tokens.row_slices(batches):
                words, _ = words_of(batch.column("text"))
                place = np.minimum(np.searchsorted(key, words), len(key) - 1)
                total += np.bincount(place[key[place] == words], minlength=len(key))
            seen = np.flatnonzero(total)
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["k", "n"])

        counted = shared.texts(documents).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        frequency = np.zeros(len(key))
        frequency[counted.column("k").to_numpy()] = counted.column("n").to_numpy()
        block.choose(frequency, threshold)
        yield block


def scan(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, n_words of the item, first_word, last_word: each item found in each document."""
    spark = shared.prepare(documents.sparkSession)
    parts = []
    for block in _seeded(documents, benchmark, threshold):

        def find(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in tokens.row_slices(batches):
                found = block.matches(*words_of(batch.column("text")), batch.num_rows)
                if found:
                    row, item, score, first, last = (list(x) for x in zip(*found, strict=True))
                    columns = [batch.column("doc_id").take(pa.array(row)), pa.array([block.ids[i] for i in item], pa.int64()), pa.array(score), pa.array([len(block.words[i]) for i in item], pa.int32()), pa.array(first), pa.array(last)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "n_words", "first_word", "last_word"])

        parts.append(shared.texts(documents).mapInArrow(find, SCHEMA))
    out = spark.createDataFrame([], SCHEMA)
    for part in parts:
        out = out.unionByName(part)
    return out if len(parts) != 1 else parts[0]


def keep_clean(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, unchanged and with all their columns, in which no item is found."""
    shared.prepare(documents.sparkSession)
    for block in _seeded(documents, benchmark, threshold):

        def clean(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in tokens.row_slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in block.matches(*words_of(batch.column("text")), batch.num_rows)]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(clean, documents.schema)
    return documents
