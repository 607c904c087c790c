"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters look at a document's letter runs: two hand-written lexicons, lexicons of
words and of 4- and 5-byte stems mined from one half of the labelled sample
that vote on the other half, patterns (insult beside a second person, shouting),
a voter for texts without any suspicious token, and the given label.  The label
model is a mixture of two classes over vote patterns: voters that are
correlated within the majority's classes are joined to cliques with one table
of joint votes, and EM estimates these tables and with them each voter's
accuracy.  Its posterior, not the label, trains a logistic regression over the
mined tokens, which scores any text.

Only a bounded sample of labelled rows outside the held-out fold is learned
from; scoring reads whole texts and looks every letter run up.

Defined cases: null texts count as empty, and an empty text gets the score of
a text without known tokens; very long texts are read whole; repeated rows are
scored each on their own; an empty table gives an empty result; without labels
of both classes every score is their share of toxic rows (0 without any); other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import sampling, shared, tokens

#: Labelled documents to learn from at most; this bounds what the driver gathers, mined tokens included.
SAMPLE = 30_000
#: Least share of toxic documents among those with a mined token.
PURITY = 0.6
#: Copies are found in the sample by so many minima of hashes.
SKETCHES = 4
NOUNS = ("idiot", "moron", "loser", "clown", "scum", "trash", "imbecile", "fool", "scumbag", "bastard", "garbage")
ADJECTIVES = ("stupid", "pathetic", "worthless", "disgusting", "dumb", "moronic", "idiotic", "despicable", "vile", "filthy")
STEMS = (4, 5)
VOTERS = ("nouns", "adjectives", "words_0", "words_1", "stem4_0", "stem4_1", "stem5_0", "stem5_1", "address", "shouting", "nothing_found", "label")
_ADDRESS = re.compile(r"\b(?:you|your|he|she|they)\W+(?:\w+\W+){0,3}(?:" + "|".join(NOUNS + ADJECTIVES) + r")", re.IGNORECASE)
_SHOUT = re.compile(r"(?:\b[A-Z]{4,}\b\W+){5}|[!?]{3,}")


def token_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, rows and kinds (0 word, else bytes of the stem) of all letter runs and their stems."""
    start, end, row = tokens.word_spans(data, offsets, tokens.LETTERS)
    keys, rows, kinds = [tokens.word_hashes(data, start, end, lower=True)], [row], [np.zeros(len(row), np.int8)]
    for n in STEMS:
        longer = end - start > n
        keys.append(tokens.mix(tokens.word_hashes(data, start[longer], start[longer] + n, lower=True) + np.uint64(n)))
        rows.append(row[longer])
        kinds.append(np.full(longer.sum(), n, np.int8))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(kinds)


def word_keys(words: tuple[str, ...]) -> np.ndarray:
    data, offsets = tokens.buffers(pa.array(words))
    start, end, _ = tokens.word_spans(data, offsets, tokens.LETTERS)
    return np.sort(tokens.word_hashes(data, start, end, lower=True))


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _half(doc_id: np.ndarray) -> np.ndarray:
    return (tokens.mix(doc_id.astype(np.uint64)) & np.uint64(1)).astype(np.int64)


#: Documents with a token: clean and toxic ones of either half, then of both without copies.
COUNTS = ("c0", "t0", "c1", "t1", "c", "t")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``SKETCHES`` minima of differently mixed hashes of a text's word triples (of its words, if fewer)."""
    for batch in tokens.row_slices(batches):
        data, offsets = tokens.buffers(batch.column("text"))
        start, end, row = tokens.word_spans(data, offsets)
        words = tokens.word_hashes(data, start, end, lower=True)
        at = tokens.ngram_rows(row, 3)
        hashes, rows = np.append(tokens.ngram_hashes(words, 3)[at], words), np.append(row[at], row)
        single = np.bincount(row, minlength=batch.num_rows)[rows] < 3
        use = np.append(np.ones(len(at), bool), np.zeros(len(words), bool)) | single
        least = np.full((SKETCHES, batch.num_rows), np.iinfo(np.uint64).max)
        for k in range(SKETCHES):
            np.minimum.at(least[k], rows[use], tokens.mix(hashes[use] + np.uint64(k)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.view(np.int64)) for x in least)], names=[*batch.schema.names, *(f"m{k}" for k in range(SKETCHES))])


def mark_copies(rows: DataFrame) -> DataFrame:
    """Adds ``own``: 1 for one row of each group of rows that agree in any sketch, else 0; copies are no independent witnesses."""
    names = [f"m{k}" for k in range(SKETCHES)]
    rows = shared.cut(rows.mapInArrow(_sketch, "doc_id long, text string, label int, " + ", ".join(f"{x} long" for x in names)))
    first = rows.select("doc_id", *names)
    for x in names:
        first = first.join(rows.groupBy(x).agg(F.min("doc_id").alias("doc_id")), ["doc_id", x], "left_semi")
    first = first.select("doc_id", F.lit(1).alias("own")).distinct()
    return shared.cut(rows.select("doc_id", "text", "label").join(first, "doc_id", "left").fillna(0, ["own"]))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a token, by half of the sample and label; added up within a slice."""
    for batch in tokens.row_slices(batches):
        keys, rows, kinds = token_keys(*tokens.buffers(batch.column("text")))
        group = _half(batch.column("doc_id").to_numpy()) * 2 + batch.column("label").to_numpy().astype(np.int64)
        order = np.lexsort((rows, keys))
        keys, rows, kinds = keys[order], rows[order], kinds[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows, kinds = keys[new], rows[new], kinds[new]
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        table = np.bincount(inverse * 4 + group[rows], minlength=4 * len(unique)).reshape(-1, 4)
        single = batch.column("own").to_numpy()[rows] == 1
        alone = np.bincount(inverse[single] * 2 + group[rows[single]] % 2, minlength=2 * len(unique)).reshape(-1, 2)
        columns = [pa.array(unique.view(np.int64)), pa.array(kinds[first].astype(np.int32)), *(pa.array(x) for x in (*table.T, *alone.T))]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "kind", *COUNTS])


def votes(found: list[np.ndarray], half: np.ndarray, label: np.ndarray, flags: np.ndarray, lexicons: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """-1 clean, 0 no opinion, 1 toxic; by row and voter. lexicons: by (kind, half) which tokens are in it."""
    out = np.zeros((len(found), len(VOTERS)), np.int8)
    for i, own in enumerate(found):
        for j, kind in enumerate((0, *STEMS)):
            for h in (0, 1):
                if half[i] != h:  # a lexicon says nothing about the rows that it comes from
                    out[i, 2 + 2 * j + h] = lexicons[kind, h][own].any()
    out[:, [0, 1, 8, 9]] = flags
    out[:, 10] = -(~out[:, :9].any(1)).astype(np.int8)
    out[:, 11] = 2 * label - 1
    return out


def label_model(table: np.ndarray, rounds: int = 40, joined: float = 0.5) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of votes; accuracies of the voters and cliques of correlated ones."""
    patterns, inverse, counts = np.unique(table, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    posterior = 1 / (1 + np.exp(-2.0 * patterns.sum(1)))

    def run(cliques: list[list[int]], posterior: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        codes = [np.unique(patterns[:, c], axis=0, return_inverse=True)[1].ravel() for c in cliques]
        for _ in range(rounds):
            weight = np.stack([counts * (1 - posterior), counts * posterior])
            prior = np.log((weight.sum(1) + 1) / (counts.sum() + 2))
            log_p, tables = np.repeat(prior[:, None], len(patterns), 1), []
            for code in codes:
                joint = np.stack([np.bincount(code, weights=w, minlength=code.max() + 1) for w in weight]) + 0.1
                tables.append(joint / joint.sum(1, keepdims=True))
                log_p += np.log(tables[-1])[:, code]
            posterior = 1 / (1 + np.exp(np.clip(log_p[0] - log_p[1], -50, 50)))
        return posterior, tables

    m = table.shape[1]
    parent, x = list(range(m)), patterns.astype(float)
    within = np.zeros((m, m))  # covariance within the classes of the majority
    for y in (posterior, 1 - posterior):
        w = counts * y / max(1e-9, (counts * y).sum())
        centred = x - w @ x
        within += (centred * w[:, None]).T @ centred * (counts * y).sum() / counts.sum()
    spread = np.sqrt(np.maximum(np.diag(within), 1e-3))
    for j in range(m):
        for k in range(j):
            if within[j, k] > joined * spread[j] * spread[k]:
                parent = [parent[k] if p == parent[j] else p for p in parent]
    cliques = [[j for j in range(m) if parent[j] == p] for p in sorted(set(parent))]
    posterior, _ = run(cliques, posterior)
    accuracy = [float((counts * np.where(patterns[:, j] > 0, posterior, 1 - posterior) * (patterns[:, j] != 0)).sum() / max(1, (counts * (patterns[:, j] != 0)).sum())) for j in range(m)]
    return posterior[inverse], {"accuracy": accuracy, "cliques": cliques}


def logistic_regression(found: list[np.ndarray], target: np.ndarray, size: int, penalty: float = 1e-5, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias over binary tokens, by Adam on the whole sample."""
    row, token = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    weights, bias = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    state = np.zeros((2, size + 1))
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=weights[token], minlength=len(found)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        gradient = np.append(np.bincount(token, weights=error[row], minlength=size) / len(found) + penalty * weights, error.mean())
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        step = 0.1 * state[0] / (1 - 0.9**t) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, float(bias)


def fit(documents: DataFrame, labels: DataFrame, of: int = 5, remainder: int = 0, sample: int = SAMPLE) -> dict:
    """Learns from about ``sample`` labelled documents whose id is not held out."""
    chosen = F.broadcast(sampling.labelled(labels, "toxic", of, remainder, sample))
    rows = mark_copies(shared.texts(documents).join(chosen, "doc_id").select("doc_id", "text", "label"))
    counted = rows.mapInArrow(_token_counts, "token long, kind int, " + ", ".join(f"{x} long" for x in COUNTS))
    counted = shared.cut(counted.groupBy("token", "kind").agg(*(F.sum(x).alias(x) for x in COUNTS)))
    totals = {(r["own"], r["label"]): r["n"] for r in rows.groupBy("own", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = (totals.get((0, k), 0) + totals.get((1, k), 0) for k in (0, 1))
    if not n_clean or not n_toxic:
        return {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": 0.0, "constant": float(n_toxic > 0)}
    share = max(1e-6, totals.get((1, 1), 0) / max(1, totals.get((1, 0), 0) + totals.get((1, 1), 0)))
    part = F.col("t") / (F.col("t") + F.col("c"))
    # twice the log likelihood ratio against the overall share; beyond the bound, of all counted tokens a tenth of one is expected to get in by chance
    ratio = 2 * (F.col("t") * F.log(part / share) + F.col("c") * F.log(F.greatest(1 - part, F.lit(1e-9)) / (1 - share)))
    bound = 2 * (math.log(max(2, counted.count())) + math.log(10))
    pure = (F.col("t0") + F.col("t1")) / (F.col("t0") + F.col("t1") + F.col("c0") + F.col("c1")) >= PURITY
    mined = counted.where((F.col("t") > 0) & (part >= max(PURITY, share)) & pure & (ratio >= bound)).toArrow()
    mined = mined.set_column(0, "token", pa.array(mined.column("token").to_numpy().view(np.uint64))).sort_by("token")
    keys, kind = mined.column("token").to_numpy(), mined.column("kind").to_numpy()
    size = max(1, len(keys))
    lexicons = {}
    for h in (0, 1):
        t, c = (mined.column(f"{x}{h}").to_numpy() for x in "tc")
        strong = (t >= 2) & (t >= 0.95 * (t + c))
        lexicons |= {(k, h): strong & (kind == k) for k in (0, *STEMS)}
    nouns, adjectives = word_keys(NOUNS), word_keys(ADJECTIVES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.row_slices(batches):
            all_keys, all_rows, _ = token_keys(*tokens.buffers(batch.column("text")))
            n = batch.num_rows
            place = find(keys, all_keys)
            code = np.unique(all_rows[place >= 0] * size + place[place >= 0])
            cut = np.searchsorted(code, np.arange(n + 1) * size).astype(np.int32)
            flags = np.zeros((n, 4), bool)
            for j, words in enumerate((nouns, adjectives)):
                flags[all_rows[find(words, all_keys) >= 0], j] = True
            for i, text in enumerate(batch.column("text").to_pylist()):
                flags[i, 2:] = flags[i, :2].any() and _ADDRESS.search(text) is not None, flags[i, :2].any() and _SHOUT.search(text) is not None
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array((code % size).astype(np.int32))), pa.FixedSizeListArray.from_arrays(pa.array(flags.astype(np.int32).ravel()), 4).cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "found", "flags"])

    got = rows.mapInArrow(features, "doc_id long, label int, found array<int>, flags array<int>").toArrow().sort_by("doc_id")
    found = [np.asarray(x.values) for x in got.column("found")]
    label, flags = got.column("label").to_numpy(), np.array(got.column("flags").to_pylist(), np.int8).reshape(-1, 4)
    posterior, about = label_model(votes(found, _half(got.column("doc_id").to_numpy()), label, flags, lexicons))
    weights, bias = logistic_regression(found, posterior, len(keys))
    return {"keys": keys, "weights": weights, "bias": bias} | about


def scores(model: dict, batch: pa.RecordBatch) -> np.ndarray:
    """The classifier's probability for each text of a batch."""
    if "constant" in model:
        return np.full(batch.num_rows, model["constant"])
    keys, rows, _ = token_keys(*tokens.buffers(batch.column("text")))
    place = find(model["keys"], keys)
    hit, size = place >= 0, max(1, len(model["keys"]))
    code = np.unique(rows[hit] * np.int64(size) + place[hit])
    z = np.bincount(code // size, weights=model["weights"][code % size], minlength=batch.num_rows) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def predict(documents: DataFrame, model: dict, of: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = sampling.held_out(F.col("doc_id"), of, remainder).alias("held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.row_slices(batches):
            p = scores(model, batch)
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "score", "predicted"])

    return shared.texts(documents, held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns and scores on the same tables, folds apart."""
    shared.prepare(documents.sparkSession)
    return predict(documents, fit(documents, labels))


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, unchanged and with all their columns, that are not predicted toxic."""
    shared.prepare(documents.sparkSession)
    model = fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.row_slices(batches):
            yield batch.filter(pa.array(scores(model, batch) < 0.5))

    return documents.mapInArrow(run, documents.schema)
