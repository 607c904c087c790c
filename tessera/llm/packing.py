"""Best-fit packing of token pieces by minimum bin slack.

Documents become token ids plus one end id; documents of more than
``capacity`` ids are cut into full pieces, the first piece being the shorter
one.  What fits together depends on lengths alone, so the bins are planned on
the histogram of lengths (at most ``capacity`` numbers, however large the
corpus): the longest available length opens a bin, a bitset subset-sum over the
available lengths finds the fullest completion, and that combination is removed
as many times as the histogram allows.  Spark ranks the pieces of each length
and looks the rank up in the plan.

Defined cases: null text counts as empty; an empty text is one piece holding
the end id; very long texts are cut, never dropped; repeated rows are packed
each on their own; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import shared, tokens

#: Pieces (about) that are ranked together.
RANKED = 1 << 16
_ENCODERS = tokens.Cache()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(plain)))}


def encoder(path: str | None):
    """The byte-level BPE of a tokenizer file, added tokens included; the same ids as ``tokenizers`` gives, in a third of the time.

    It needs a vocabulary whose ids are in the order of the merges.
    """
    import public_tokenizers
    import tiktoken

    path = path or default_tokenizer()
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in file["added_tokens"]) or file["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in word): n for word, n in file["model"]["vocab"].items() if word not in added}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[path]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: the remainder first, then full ones."""
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(documents: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encode_text = encoder(tokenizer_path).encode_to_numpy
        for batch in tokens.row_slices(batches):
            doc_id, piece, start, length, crc, ids = [], [], [], [], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = np.append(encode_text(text, allowed_special="all"), end_id).astype("<u4")
                at = 0
                for k, n in enumerate(cut_lengths(len(own), capacity)):
                    doc_id.append(key), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(own[at : at + n].tobytes()))
                    if with_ids:
                        ids.append(own[at : at + n].astype(np.int32))
                    at += n
            out = {"doc_id": pa.array(doc_id, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shared.texts(documents).mapInArrow(encode, schema)


def fullest(available: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of available lengths with the largest sum up to room.

    Bit t of ``reach`` says that the sum t can be made.  Lengths come in
    descending order, their counts as powers of two, so a sum is made from
    the longest lengths that give it and the short ones stay for later bins.
    """
    reach, steps, mask, goal = 1, [], (2 << room) - 1, 1 << room
    for length in sorted(available, reverse=True):
        left, block = min(available[length], room // length), 1
        while left and not reach & goal:
            times = min(block, left)
            steps.append((reach, length, times))
            reach |= reach << length * times & mask
            left, block = left - times, block * 2
        if reach & goal:
            break
    total, found = reach.bit_length() - 1, {}
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            found[length] = found.get(length, 0) + times
            total -= length * times
    return list(found.items())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, times in each bin)]) until every counted piece has a place."""
    left, bins = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = {k: v for k, v in left.items() if v and k <= capacity - longest}
        combination = dict(fullest(rest, capacity - longest)) if rest else {}
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        bins.append((times, sorted(combination.items(), reverse=True)))
        for k, n in combination.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return bins


def places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks with the bins they go to; ordered by (length, first rank)."""
    rows, used, first_bin = [], {}, 0
    for times, combination in bins:
        offset = 0
        for length, n in combination:
            rows.append((length, used.get(length, 0), first_bin, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        first_bin += times
    columns = np.array(sorted(rows) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), columns.T.copy(), strict=True))


def pack_lengths(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length <= capacity."""
    items = shared.cut(items)
    buckets = max(16, items.count() // RANKED)
    items = items.withColumn("_bucket", F.pmod(F.xxhash64(*(c for c in ("doc_id", "piece", "ids_crc32") if c in items.columns)), F.lit(buckets)))
    groups = shared.cut(items.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy(*(c for c in ("doc_id", "piece", "ids_crc32") if c in items.columns))
    ranked = items.withColumn("_rank", F.row_number().over(order)).join(groups, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    fields = [c for c in items.columns if c != "_bucket"]
    ranked = ranked.select(*fields, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.int64(1) << 48  # ranks stay below it
        starts = table["length"] * step + table["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = np.searchsorted(starts, length * step + rank, "right") - 1
            within, times = rank - table["rank"][row], table["times"][row]
            out = [batch.column(c) for c in fields]
            out += [pa.array(table["sequence"][row] + within // times), pa.array(table["offset"][row] + within % times * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*fields, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack(documents: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there; see the module's text."""
    shared.prepare(documents.sparkSession)
    return pack_lengths(pieces(documents, capacity, end_id, tokenizer_path, with_ids), capacity)
