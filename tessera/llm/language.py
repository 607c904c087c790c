"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text's subwords are its 3- and 4-byte grams after ASCII case folding, all
other ASCII signs than letters counting as one blank; each is hashed to one of
``BUCKETS`` embeddings.  The mean embedding goes through a linear softmax; both
layers are trained by stochastic gradient descent in numpy on a bounded sample
per language.  Since mean and linear layer commute, scoring looks up one row of
class scores per subword.  A held-back part of the sample fits the softmax
temperature and the score under which a prediction should be rejected.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
very long texts are read whole; repeated rows are predicted each on their own;
an empty table gives an empty result, and without any learnable row every text
with letters is ``und``, too; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.llm import sampling, shared, tokens

BUCKETS = 1 << 15
#: Sampled documents for each language; this bounds what the driver gathers.
SAMPLE = 1000
UNDETERMINED = "und"


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every subword."""
    fold = np.arange(256, dtype=np.uint32)
    fold[:128] = [ord(chr(x).lower()) if chr(x).isalpha() else 32 for x in range(128)]
    padded = np.full(len(data) + len(offsets), 32, np.uint32)  # a blank before each row and at the end
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded[np.arange(len(data)) + rows + 1] = fold[data]
    starts = offsets[:-1] + np.arange(len(offsets) - 1)
    letter = padded != 32
    three = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)
    four = three[:-1] | padded[3:] << np.uint32(24)
    out = []
    for n, code in ((3, three), (4, four)):
        at = np.flatnonzero(letter[: len(code)] | letter[1 : len(code) + 1])
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + n <= np.append(starts[1:], len(padded) - 1)[row] + 1  # the next row's blank may end a gram
        at, row = at[inside], row[inside]
        out.append(((code[at] * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 % (1 << 32))) >> np.uint32(17), row))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its class, its distinct buckets and how often each occurs."""
    for batch in tokens.row_slices(batches):
        bucket, row = subwords(*tokens.buffers(batch.column("text")))
        code, n = np.unique(row * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(code, np.arange(batch.num_rows + 1) * BUCKETS).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (code % BUCKETS, n)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *lists], names=["doc_id", "lang", "bucket", "n"])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dim: int = 16, epochs: int = 4, batch: int = 32, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Class scores of each bucket (their mean over a text's subwords is its logits), by SGD on the two layers."""
    random = np.random.default_rng(seed)
    inner, outer = random.normal(0, 1 / dim, (BUCKETS, dim)), random.normal(0, 1, (dim, classes))
    steps, done = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for i in range(0, len(order), batch):
            own = [rows[k] for k in order[i : i + batch]]
            bucket = np.concatenate([x[0] for x in own])
            weight = np.concatenate([x[1] / x[1].sum() for x in own])
            row = np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
            starts = np.cumsum([0, *(len(x[0]) for x in own)])[:-1]
            mean = np.add.reduceat(inner[bucket] * weight[:, None], starts)
            logits = mean @ outer
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), [x[2] for x in own]] -= 1
            step = rate * (1 - done / steps)
            back = (p @ outer.T)[row] * weight[:, None]
            outer -= step * mean.T @ p / len(own)
            np.subtract.at(inner, bucket, 500 * step * back)  # each bucket sees a small part of a text
            done += 1
    return (inner @ outer).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def calibrate(logits: np.ndarray, truth: np.ndarray, error: float) -> tuple[float, float]:
    """Factor on the logits with the least log loss, and the lowest score above which at most ``error`` are wrong."""
    grid = np.geomspace(0.25, 64, 33)
    loss = [-np.log(np.maximum(softmax(logits * f)[np.arange(len(truth)), truth], 1e-12)).mean() for f in grid]
    factor = float(grid[int(np.argmin(loss))])
    p = softmax(logits * factor)
    score, wrong = p.max(1), p.argmax(1) != truth
    order = np.argsort(-score, kind="stable")
    within = np.flatnonzero(np.cumsum(wrong[order]) <= error * np.arange(1, len(order) + 1))
    return factor, float(score[order[within[-1]]]) if len(within) else 1.0


def fit(documents: DataFrame, of: int = 4, remainder: int = 2, per_class: int = SAMPLE, error: float = 0.01) -> dict:
    """Learns from a bounded sample of the documents whose id is not held out."""
    sample = sampling.by_class(documents, "lang", of, remainder, per_class).select("doc_id", "lang", "text")
    gathered = sample.mapInArrow(_counts, "doc_id long, lang string, bucket array<int>, n array<int>").toArrow().sort_by("doc_id")
    names = sorted(set(gathered.column("lang").to_pylist()))
    rows = [(np.asarray(b.values), np.asarray(n.values, dtype=float), names.index(name.as_py())) for b, n, name in zip(gathered.column("bucket"), gathered.column("n"), gathered.column("lang"), strict=True) if len(b)]
    if not rows:
        return {"classes": [], "scores": np.zeros((BUCKETS, 0), np.float32), "factor": 1.0, "reject": 1.0}
    back = [x for i, x in enumerate(rows) if i % 5 == 4] or rows
    scores = train([x for i, x in enumerate(rows) if i % 5 != 4], len(names))
    logits = np.array([(scores[b] * (n / n.sum())[:, None]).sum(0) for b, n, _ in back], float)
    factor, reject = calibrate(logits, np.array([x[2] for x in back]), error)
    return {"classes": names, "scores": scores, "factor": factor, "reject": reject}


def predict(documents: DataFrame, model: dict, of: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted (score reaches the calibrated bound)."""
    held = sampling.held_out(F.col("doc_id"), of, remainder).alias("held_out")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = np.array([*model["classes"], UNDETERMINED], dtype=object), model["scores"]
        for batch in tokens.row_slices(batches):
            text, n = batch.column("text"), batch.num_rows
            known = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False) & bool(model["classes"])
            best, confidence = np.full(n, -1), np.zeros(n)
            if known.any():
                bucket, row = subwords(*tokens.buffers(text))
                count = np.maximum(np.bincount(row, minlength=n), 1)
                logits = np.stack([np.bincount(row, weights=table[bucket, k], minlength=n) / count for k in range(table.shape[1])], 1)
                p = softmax(logits * model["factor"])
                best, confidence = np.where(known, p.argmax(1), -1), np.where(known, p.max(1), 0.0)
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(confidence), pa.array(known & (confidence >= model["reject"]))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return shared.texts(documents, held).mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def identify(documents: DataFrame) -> DataFrame:
    """Learns and predicts on the same table, folds apart."""
    shared.prepare(documents.sparkSession)
    return predict(documents, fit(documents))
