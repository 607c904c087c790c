"""Media columns with content-defined chunking of payloads.

A text's UTF-8 bytes, filled up with 255 to a multiple of 576, are the samples
of an 8-bit greyscale image (binary PGM, 24 pixels wide), a lossless form.  A
rolling gear hash cuts the payload where its content says so; equal passages
therefore give equal chunks wherever they stand.

The store keeps the bytes of each repeated chunk once, by digest, and for each
document its payload's digest and the ordered list of its chunks: a chunk that
no other place has is held with the list, every other one is its digest alone.
Reading back depends on the lists: documents without repeated chunks are put
together where they lie, the others (equal payloads once) after Spark joins of
their digests with the chunks.  Every payload is verified against its digest
before anything is computed from it.

A chunk counts as repeated when a bitmap of a fixed number of bits says so; the
few that it lets through wrongly are stored like repeated ones.

Defined cases: null counts as empty; an empty text has a payload of 576 bytes
of 255; very long texts are cut into chunks of at most ``MOST`` bytes; repeated
rows and rows without an id each give a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import shared, tokens

UNIT, WIDTH = 576, 24
LEAST, MOST, BITS = 256, 4096, 10
#: Bytes of a chunk's digest, bits of the map of repeated ones, and digests that a task remembers having given.
DIGEST, MAP_BITS, SEEN = 16, 26, 1 << 16
STORED = "doc_id long, key binary, n_chunks int, missing array<binary>, own binary, alone array<boolean>"
ROW = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def encode(data: bytes) -> bytes:
    """The stored form: a binary PGM of the payload."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def decode(stored: bytes) -> bytes:
    """The payload of a stored form."""
    kind, shape, most, rest = stored.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or most != b"255" or len(rest) != width * height:
        raise ValueError("not a stored payload")
    return rest


def features(data: bytes) -> str:
    """Size, mean, deviation, mean step and an 8x8 average hash of the image."""
    image = np.frombuffer(data, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    bands = np.array([[part.mean() for part in np.array_split(band, 8, 1)] for band in np.array_split(image, 8, 0)])
    bits = int("".join("1" if x else "0" for x in (bands > image.mean()).ravel()), 2)
    return f"{image.shape[0]}x{WIDTH} mean={image.mean():.4f} std={image.std():.4f} step={np.abs(np.diff(image, axis=1)).mean():.4f} hash={bits:016x}"


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: the first place, from ``LEAST`` bytes on, where the gear hash's top bits are 0, or ``MOST`` bytes.

    The gear hash of place i is the sum of table[byte i-k] << k; in 32 bits it
    covers 32 bytes, and is built by doubling.
    """
    table = (tokens.mix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    h = table[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    candidates = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    ends, at = [], 0
    while at < len(data):
        i = np.searchsorted(candidates, at + LEAST)
        end = min(at + MOST, len(data), int(candidates[i]) if i < len(candidates) else len(data))
        ends.append(end)
        at = end
    return ends


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks, in order."""
    view, out, at = memoryview(data), [], 0
    for end in cuts(data):
        part = bytes(view[at:end])
        out.append((hashlib.blake2b(part, digest_size=DIGEST).digest(), part))
        at = end
    return out


def _key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _heads(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of each digest."""
    return np.frombuffer(b"".join(digests), "<u8")[:: DIGEST // 8]


def repeated(documents: DataFrame) -> np.ndarray:
    """A bitmap of the chunks that occur at more than one place, by the first 64 bits of their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.row_slices(batches):
            head, n = np.unique(_heads([digest for text in batch.column("text").to_pylist() for digest, _ in chunks(payload(text))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    counted = shared.texts(documents).mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
    return shared.bitmap(counted.where("n > 1").select("h"), MAP_BITS)


def lists(documents: DataFrame, again: np.ndarray) -> DataFrame:
    """doc_id, key (SHA-256 of the payload), n_chunks, and the ordered list of chunks: which of them stand alone, their bytes, and the digests of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in tokens.row_slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = payload(text)
                digests, parts = zip(*chunks(data), strict=True)
                alone = ~shared.in_bitmap(again, _heads(list(digests)))
                own = squeeze.compress(b"".join(_lengths(compress(parts, alone)))) if alone.any() else None
                rows.append((doc_id, _key(data), len(parts), list(compress(digests, ~alone)), own, alone.tolist()))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "key", "n_chunks", "missing", "own", "alone"])

    return shared.texts(documents).mapInArrow(run, STORED)


def _lengths(parts: Iterator[bytes]) -> Iterator[bytes]:
    for part in parts:
        yield len(part).to_bytes(2, "little")
        yield part


def repeated_chunks(documents: DataFrame, again: np.ndarray) -> DataFrame:
    """digest, part: the bytes of each repeated chunk, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in tokens.row_slices(batches):
            found = {}
            for text in batch.column("text").to_pylist():
                own = chunks(payload(text))
                for (digest, part), hit in zip(own, shared.in_bitmap(again, _heads([d for d, _ in own])).tolist(), strict=True):
                    if hit and digest not in seen:
                        seen.add(digest)
                        found[digest] = part
            if len(seen) > SEEN:  # then some are dealt again
                seen.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "part"])

    return shared.texts(documents).mapInArrow(run, "digest binary, part binary").groupBy("digest").agg(F.first("part").alias("part"))


def store(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists and the repeated chunks of all documents, written to the shared folder."""
    shared.prepare(documents.sparkSession)
    again = repeated(documents)
    return shared.cut(lists(documents, again)), shared.cut(repeated_chunks(documents, again))


def put_together(key: bytes, missing: list[bytes], own: bytes | None, alone: list[bool], fetched: dict[bytes, bytes]) -> bytes:
    """The payload of a list, verified."""
    import zstandard

    held = zstandard.decompress(own) if own else b""
    parts, at, others = [], 0, iter(missing)
    for inside in alone:
        if inside:
            end = at + 2 + int.from_bytes(held[at : at + 2], "little")
            parts.append(held[at + 2 : end])
            at = end
        else:
            digest = next(others)
            if digest not in fetched:
                raise ValueError(f"payload {key.hex()}: the chunk {digest.hex()} is not in the store")
            parts.append(fetched[digest])
    data = b"".join(parts)
    if _key(data) != key:
        raise ValueError(f"payload {key.hex()}: what was put together differs from what was stored")
    return data


def read_back(stored: DataFrame, parts: DataFrame, finish, schema: str) -> DataFrame:
    """finish(payload) as columns after doc_id, n_chunks for every stored document; equal payloads are put together once."""

    def rows(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            fetched = {x["digest"]: x["part"] for x in r.get("fetched") or ()}
            out.append((r[name], r["n_chunks"], *finish(put_together(r["key"], r["missing"], r["own"], r["alone"], fetched))))
        kinds = pa.schema([(name, batch.schema.field(name).type), ("n_chunks", pa.int32()), *found])
        return pa.RecordBatch.from_pydict(dict(zip(kinds.names, zip(*out, strict=True), strict=True)) if out else {n: [] for n in kinds.names}, schema=kinds)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch, "doc_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch, "key")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    found = list(to_arrow_schema(StructType.fromDDL(schema)))
    complete = stored.where(F.size("missing") == 0).mapInArrow(whole, f"doc_id long, n_chunks int, {schema}")
    rest = stored.where(F.size("missing") > 0)
    once = rest.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n_chunks", "missing", "own", "alone")))
    wanted = once.select("key", F.explode(F.array_distinct("missing")).alias("digest"))
    fetched = wanted.join(parts, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "part")).alias("fetched"))
    payloads = once.join(fetched, "key", "left").mapInArrow(joined, f"key binary, n_chunks int, {schema}")
    return complete.unionByName(rest.select("doc_id", "key").join(payloads, "key").drop("key"))


def images(documents: DataFrame) -> DataFrame:
    """doc_id, n_chunks, media: the stored form of every document, read back from the store."""
    return read_back(*store(documents), lambda data: (encode(data),), "media binary")


def described(data: bytes) -> tuple:
    stored = encode(data)
    back = decode(stored)
    return len(back.rstrip(b"\xff")), len(back), _key(back).hex(), zlib.crc32(back[-32:]), len(stored), _key(stored).hex(), features(back)


def media(documents: DataFrame) -> DataFrame:
    """Stores, deduplicates, reconstructs and verifies every text's payload; features of what was read back."""
    names = [x.split()[0] for x in ROW.split(", ")]
    return read_back(*store(documents), described, ", ".join(ROW.split(", ")[1:-1])).select(*names)
