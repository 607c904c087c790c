"""Language-model scores by a weighted backoff automaton.

States are the n-grams of up to two words that the training texts hold, arcs
add a token, a failure arc drops a state's oldest word.  Every n-gram up to
three tokens is kept, whatever its count, so the model grows with the corpus.
An arc's weight is the smoothed probability

    P(w | h) = (c(hw) + PRIOR * P(w | h')) / (c(h) + PRIOR),

h' being h without its oldest word, and a failure arc's PRIOR / (c(h) + PRIOR);
the empty state has add-one unigrams over the training words and one more.
Each state's arcs and failure arc give probabilities that sum to 1.

The automaton is never gathered.  Documents are taken in blocks of about
``BLOCK`` tokens (see ``blocks``).  Each block sends its distinct n-grams, with their counts in
its training texts, to the tasks that own their hash ranges, as sorted keys in
packed rows, and gets back the counts over all blocks.  With these it holds the
part of the automaton that its documents can reach, and walks it: from left to
right every token takes the arc of the state that the words before it lead to,
or failure arcs until there is one, and the logarithms of all weights add up.
An n-gram is one key of a block, however often it occurs, so none is a hot key.

Defined cases: null counts as empty, and an empty text is the end token alone;
very long texts are read whole; repeated rows each give a row and each count;
rows without an id are scored but not learned from; an empty table gives an
empty result, and without training documents every word is unknown (N = V = 0);
other columns are ignored.  The documents must come in the same order whenever
they are read, as files do; else an error says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm import blocks, sampling, shared, tokens

ORDER = 3
#: Weight of the shorter context for contexts of one and of two words.
PRIOR = (300.0, 30.0)
#: Tokens of a block, and n-grams (about) whose counts are added up together.
BLOCK, RANGE = 3 << 18, 1 << 20
#: Bits of an n-gram's key beyond those that number all n-grams: an n-gram is taken for another once in 2**SPARE.
SPARE = 22
#: Parts for n-grams for each part for words, of which a block has far fewer.
WORD_PARTS = 16
U64 = np.uint64
END = U64(0x5BD1E995CAFEF00D)


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token: a row's words, then its end."""
    data, offsets = tokens.buffers(column)
    start, end, row = tokens.word_spans(data, offsets)
    words = tokens.word_hashes(data, start, end, lower=True)
    n = len(column)
    out = np.full(len(words) + n, END)
    rows = np.repeat(np.arange(n), np.bincount(row, minlength=n) + 1)
    out[np.arange(len(words)) + row] = words
    return out, rows


class Keys:
    """How the n-grams of a corpus are named: words by all 64 bits, longer ones by as many bits as their number needs.

    size: bytes of all texts, which bound the number of tokens.
    """

    def __init__(self, size: int):
        self.bits = (64, min(64, SPARE + max(10, (ORDER * size // 4).bit_length())))
        parts = max(1, ORDER * size // 6 // RANGE)
        self.parts = (-(-parts // WORD_PARTS), parts)

    def of(self, words: np.ndarray, rows: np.ndarray) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        """Keys of the words, and of all longer n-grams that lie in one row; for each order the tokens at which they end."""
        at = [tokens.ngram_rows(rows, n) for n in range(2, ORDER + 1)]
        longer = [tokens.mix(tokens.ngram_hashes(words, n)[a] + U64(n)) >> U64(64 - self.bits[1]) for n, a in enumerate(at, 2)]
        return [words, np.concatenate(longer)], [[np.arange(len(words))], [a + n - 1 for n, a in enumerate(at, 2)]]

    def parts_of(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Which hash range each key is in; those of words come first."""
        return ((keys >> U64(self.bits[kind] - 32)) * U64(self.parts[kind]) >> U64(32)).astype(np.int64) + kind * self.parts[0]


class Automaton:
    """The part of the model that a block's documents reach.

    c: for each order the count of the n-gram that ends at each token (0: it is
    not in the model, so it is neither an arc nor a state).
    """

    def __init__(self, c: list[np.ndarray], rows: np.ndarray, total: int, distinct: int):
        self.c, self.rows = c, rows
        #: What the empty state gives each token.
        self.base = (c[0] + 1) / (total + distinct + 1)

    def states(self) -> list[np.ndarray]:
        """For each number of words the count of the state that the words before each token lead to, 0 where there is none."""
        out = []
        for n in range(1, ORDER):
            before = np.zeros(len(self.rows))
            before[1:] = np.where(self.rows[1:] == self.rows[:-1], self.c[n - 1][:-1], 0)
            out.append(before)
        return out

    def walk(self) -> np.ndarray:
        """log10 of the weights on each token's way from the state before it: failure arcs, and the first arc found."""
        states, weights, failures = self.states(), [self.base], [np.ones(len(self.rows))]
        for count, c, prior in zip(states, self.c[1:], PRIOR, strict=True):
            failures.append(np.where(count > 0, prior / (count + prior), 1.0))  # 1: the walk does not pass there
            weights.append(np.where(count > 0, (c + prior * weights[-1]) / (count + prior), weights[-1]))
        log, pending = np.zeros(len(self.rows)), np.ones(len(self.rows), bool)
        for n in reversed(range(ORDER)):  # from the longest state down its failure arcs
            arc = pending & ((states[n - 1] > 0) & (self.c[n] > 0) if n else True)
            log[arc] += np.log10(weights[n][arc])
            pending &= ~arc
            log[pending] += np.log10(failures[n][pending])
        return log


def requests(documents: DataFrame, names: Keys) -> DataFrame:
    """part, block, keys, counts: the distinct n-grams of each block in each hash range, and how often its training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.cut(batches, sequence, BLOCK):
            name, learn = block.name(), block.column("learn").to_numpy(zero_copy_only=False).astype(bool)[block.rows]
            for kind, (keys, ends) in enumerate(zip(*names.of(block.words, block.rows), strict=True)):
                order = np.argsort(keys, kind="stable")
                keys, trained = keys[order], learn[np.concatenate(ends)[order]]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
                if not len(first):
                    continue
                counts, keys = np.add.reduceat(trained.astype(np.int64), first), keys[first]
                part = names.parts_of(keys, kind)
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                for a, b in zip(cut, np.append(cut[1:], len(keys)), strict=True):
                    columns = [pa.array(part[a : a + 1]), pa.array([name], pa.int64()), *(pa.array([blocks.pack(x)], pa.binary()) for x in (np.diff(keys[a:b], prepend=U64(0)), counts[a:b]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "keys", "counts"])

    return documents.mapInArrow(run, "part long, block long, keys binary, counts binary")


def _summed(words: int):
    """The counts over all blocks, for each block's keys in a part; of the first parts, which hold words, all tokens and different ones, too."""

    def report(part: int, rows: list[dict]) -> pa.RecordBatch:
        keys = [np.cumsum(blocks.unpack(r["keys"]), dtype=U64) for r in rows]
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate([blocks.unpack(r["counts"]) for r in rows]), minlength=len(every)).astype(np.int64)
        cut, n = np.cumsum([0, *(len(k) for k in keys)]), len(rows)
        sums = [[int(x) * (part < words)] + [0] * (n - 1) for x in (total.sum(), (total > 0).sum())]
        return pa.RecordBatch.from_arrays(
            [pa.array([r["block"] for r in rows], pa.int64()), pa.array([1] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array([blocks.pack(total[of[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), *(pa.array(x, pa.int64()) for x in sums)],
            names=["block", "kind", "at", "data", "n", "v"],
        )

    return report


def _scored(total: int, distinct: int, names: Keys):
    def finish(block: blocks.Block, got: dict[int, bytes]):
        c, n = [], len(block.words)
        for kind, (keys, ends) in enumerate(zip(*names.of(block.words, block.rows), strict=True)):
            every, of = np.unique(keys, return_inverse=True)
            counts = blocks.joined(got, len(every), lambda at, kind=kind: (at >= names.parts[0]) == bool(kind))
            value, low = counts[of].astype(float), 0
            for at in ends:
                c.append(np.zeros(n))
                c[-1][at] = value[low : low + len(at)]
                low += len(at)
        automaton = Automaton(c, block.rows, total, distinct)
        sums = [np.bincount(block.rows, weights=x, minlength=block.n) for x in (np.ones(n), c[0] > 0, np.log10(automaton.base), automaton.walk())]

        def rows(batch: pa.RecordBatch, low: int) -> pa.RecordBatch:
            own = [x[low : low + batch.num_rows] for x in sums]
            columns = [batch.column("doc_id"), batch.column("learn"), *(pa.array(x.astype(np.int64)) for x in own[:2]), *(pa.array(x) for x in own[2:])]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "learn", "n_tokens", "n_known", "base_score", "score"])

        return rows

    return finish


def score(documents: DataFrame, learn: Column) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, base_score, score, train_tokens of every document; the model learns from those where ``learn`` holds."""
    spark = shared.prepare(documents.sparkSession)
    rows = shared.texts(documents, F.coalesce(learn, F.lit(False)).alias("learn"))
    names = Keys(rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
    answers = shared.cut(blocks.answered(requests(rows, names), _summed(names.parts[0]), f"{blocks.ROW}, n long, v long"))
    got = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = got["n"] or 0, got["v"] or 0
    schema = "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double"
    out = blocks.finished(blocks.texts(rows, sequence, BLOCK), answers.drop("n", "v"), sequence, _scored(total, distinct, names), schema)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def evaluate(documents: DataFrame, of: int = 7, remainder: int = 2) -> DataFrame:
    """Learns from the documents outside a fold and scores all."""
    held = sampling.held_out(F.col("doc_id"), of, remainder)
    rows = score(documents, F.col("doc_id").isNotNull() & ~held)
    return rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), ~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
