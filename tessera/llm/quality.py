"""Quality scores by a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of a text (lengths,
repetition, character classes), its covariance shrunk towards the pooled one
and a multiple of the identity.  A score is the logistic of the difference of
the two log densities (Mahalanobis distances and log determinants from cached
Cholesky factors), scaled as the log loss on held-back sample rows asks.  Few
rows suffice: a class of one row has the pooled covariance, and every fifth row
of each class is held back while some of the class stay to learn from.

Defined cases: null texts count as empty, and empty texts are scored from
their (zero) statistics; very long texts are read whole; repeated rows are
scored each on their own; an empty table gives an empty result; with labels of
one class only, or none, every score is that class's share (0.5 without any);
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import sampling, shared, tokens

#: Labelled documents to learn from at most; this bounds what the driver gathers.
SAMPLE = 20_000
STATISTICS = ("words", "word_length", "lines", "distinct", "repeated_next", "top_word", "repeated_pairs", "repeated_lines", "upper", "digits", "signs", "long_characters", "stops", "entropy", "longest", "edges")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kind = np.zeros(256, np.int64)  # 0 lower, 1 upper, 2 digit, 3 sign, 4 blank, 5 of a longer character
    kind[:128] = [1 if "A" <= chr(x) <= "Z" else 0 if "a" <= chr(x) <= "z" else 2 if chr(x).isdigit() else 4 if x in (32, 9, 10, 11, 12, 13) else 3 for x in range(128)]
    kind[128:] = 5
    kinds = np.bincount(row * 6 + kind[data], minlength=6 * n).reshape(n, 6)
    start, end, of = tokens.word_spans(data, offsets)
    words = np.bincount(of, minlength=n)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    hashes = tokens.word_hashes(data, start, end, lower=True)

    def repeats(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and how often the commonest occurs, by row."""
        order = np.lexsort((keys, rows))
        r, k = rows[order], keys[order]
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]) if len(r) else np.zeros(0, np.int64)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, r[first], np.diff(np.append(first, len(r))))
        return np.bincount(r[first], minlength=n), most

    distinct, top = repeats(of, hashes)
    pair_at = tokens.ngram_rows(of, 2)
    pairs, _ = repeats(of[pair_at], tokens.ngram_hashes(hashes, 2)[pair_at])
    line_table = np.ones(256, bool)
    line_table[10] = False
    line_start, line_end, line_of = tokens.word_spans(data, offsets, line_table)
    lines = np.bincount(line_of, minlength=n)
    own_lines, _ = repeats(line_of, tokens.word_hashes(data, line_start, line_end))
    again = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, end - start)
    stop = np.isin(data, [ord("."), ord("?"), ord("!")])
    stops = np.bincount(row[stop], minlength=n)
    signed = np.bincount(of, weights=kind[data[end - 1]] == 3, minlength=n) if len(end) else np.zeros(n)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 5], 1)
    share = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256) / per_byte[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(1)

    def logit(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Log odds of a share of a count, drawn to the middle where the count is small."""
        return np.log((x + 0.5) / (of - x + 0.5))

    columns = (
        np.log1p(words), np.log1p(np.bincount(of, weights=end - start, minlength=n) / per_word), np.log1p(lines), logit(distinct, words), logit(again, words), logit(top, words),
        logit(np.bincount(of[pair_at], minlength=n) - pairs, np.bincount(of[pair_at], minlength=n)), logit(lines - own_lines, lines), logit(kinds[:, 1], letters), logit(kinds[:, 2], size), logit(kinds[:, 3], size), logit(kinds[:, 5], size),
        np.log1p(stops / per_word * 100), entropy, np.log1p(longest), logit(signed, words),
    )
    return np.stack(columns, 1).astype(float)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tokens.row_slices(batches):
        values = statistics(*tokens.buffers(batch.column("text")))
        column = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), column], names=["doc_id", "label", "values"])


def discriminant(x: np.ndarray, y: np.ndarray, shrink: float, ridge: float) -> dict:
    """Means, Cholesky factors of the shrunk covariances, and log determinants; by class 0 and 1."""
    many = [k for k in (0, 1) if np.sum(y == k) > 1]  # one row has no covariance
    out, pooled = {"mean": [], "factor": [], "log_det": []}, sum(np.cov(x[y == k].T) * np.sum(y == k) for k in many) / sum(np.sum(y == k) for k in many) if many else np.eye(x.shape[1])
    for k in (0, 1):
        own = (1 - shrink) * np.cov(x[y == k].T) + shrink * pooled if k in many else pooled
        own = (1 - ridge) * own + ridge * max(np.trace(own) / len(own), 1e-6) * np.eye(len(own))
        factor = np.linalg.cholesky(own)
        out["mean"].append(x[y == k].mean(0))
        out["factor"].append(np.linalg.inv(factor))
        out["log_det"].append(2 * np.log(np.diag(factor)).sum())
    return out


def difference(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density of class 1 less that of class 0."""
    density = [-0.5 * (((x - model["mean"][k]) @ model["factor"][k].T) ** 2).sum(1) - 0.5 * model["log_det"][k] for k in (0, 1)]
    return density[1] - density[0]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(documents: DataFrame, labels: DataFrame, of: int = 4, remainder: int = 2, sample: int = SAMPLE) -> dict:
    """Learns from about ``sample`` labelled documents whose id is not held out."""
    chosen = F.broadcast(sampling.labelled(labels, "quality", of, remainder, sample))
    rows = shared.texts(documents).join(chosen, "doc_id").select("doc_id", "text", "label")
    got = rows.mapInArrow(_statistics, "doc_id long, label int, values array<double>").toArrow().sort_by("doc_id")
    y = np.asarray(got.column("label").to_numpy(), dtype=int)
    x = np.array(got.column("values").to_pylist(), float).reshape(len(y), len(STATISTICS))
    if not min(np.sum(y == 0), np.sum(y == 1)):
        return {"constant": float(y.mean()) if len(y) else 0.5}
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    x, back = (x - mean) / spread, np.arange(len(y)) % 5 == 4
    for k in (0, 1):  # by class where that leaves a class without rows on one side
        own = np.flatnonzero(y == k)
        if len({*back[own].tolist()}) < 2:
            back[own] = np.arange(len(own)) % 5 == min(4, len(own) - 1) if len(own) > 1 else False
    if not back.any():  # two rows: nothing to hold back
        return discriminant(x, y, 0.8, 0.1) | {"center": mean, "spread": spread, "scale": 1.0, "shift": 0.0}
    best = None
    for shrink in (0.05, 0.2, 0.5, 0.8):
        for ridge in (0.01, 0.1):
            model = discriminant(x[~back], y[~back], shrink, ridge)
            z, t = difference(model, x[back]), y[back]
            for scale in np.geomspace(0.02, 1.5, 12):
                for shift in (np.log(y.mean() / (1 - y.mean())) * s for s in (0, 0.5, 1, 1.5)):
                    p = np.clip(_logistic(z * scale + shift), 1e-6, 1 - 1e-6)
                    loss = -(t * np.log(p) + (1 - t) * np.log(1 - p)).mean()
                    if best is None or loss < best[0]:
                        best = (loss, shrink, ridge, float(scale), float(shift))
    _, shrink, ridge, scale, shift = best
    return discriminant(x, y, shrink, ridge) | {"center": mean, "spread": spread, "scale": scale, "shift": shift}


def predict(documents: DataFrame, model: dict, threshold: float = 0.7, of: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = sampling.held_out(F.col("doc_id"), of, remainder).alias("held_out")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.row_slices(batches):
            if "constant" in model:
                p = np.full(batch.num_rows, model["constant"])
            else:
                x = (statistics(*tokens.buffers(batch.column("text"))) - model["center"]) / model["spread"]
                p = _logistic(difference(model, x) * model["scale"] + model["shift"])
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "score", "predicted"])

    return shared.texts(documents, held).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns and scores on the same tables, folds apart."""
    shared.prepare(documents.sparkSession)
    return predict(documents, fit(documents, labels))
