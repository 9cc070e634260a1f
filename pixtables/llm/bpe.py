"""Byte-level BPE over whole texts by overlapping chunks.

A text longer than one chunk becomes several rows. Chunk i reads on past its end into chunk i+1,
up to the first position where the pre-token boundaries of both must agree: a letter or digit
before a space or newline. No pre-token holds a non-space followed by white space, and the
pattern never looks back, so whatever the left chunk saw, a pre-token starts there. Chunk i+1
drops its head up to that position. Chunks are encoded by any executor and their ids are put
together in order; decoding joins the raw bytes of the ids.

Where a text has no such position for longer than a chunk (one endless run), the chunk reads
on to the end of that run and the chunks inside it are empty: no text is cut elsewhere.
"""
from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 65_536  # code points
_held: list[tuple[str, str]] = []  # the vocabulary that this worker encodes with
_SYNC = re.compile(r"[^\W_](?=[ \n])")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)  # a worker that goes on with another vocabulary drops the one before
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def id_bytes(path: str) -> list[bytes]:
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for piece, i in known.items():
        out[i] = piece
    return out


def first_sync(text: str, at: int = 0) -> int | None:
    """The first certain pre-token boundary at or after ``at``, at least one code point behind it."""
    m = _SYNC.search(text, at)
    return m.end() if m else None


def overlapping_chunks(text: str, size: int = CHUNK) -> list[str]:
    out = []
    for start in range(0, max(1, len(text)), size):
        end = start + size
        stop = first_sync(text, end) if end < len(text) else None
        out.append(text[start : stop if stop is not None else len(text)])
    return out


def stitched(chunk: str, first: bool) -> str:
    """What is left of a chunk when its head belongs to the chunk before it."""
    if first:
        return chunk
    at = first_sync(chunk)
    return chunk[at:] if at is not None else ""


def _decoded(x: pa.Array) -> Iterator[str]:
    for v in x:
        yield "" if not v.is_valid else v.as_buffer().to_pybytes().decode("utf-8", "replace")


def _chunker(size: int):
    @F.arrow_udf("array<string>")
    def chunks(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in it:
            yield pa.array([overlapping_chunks(t, size) for t in _decoded(x)], pa.list_(pa.string()))

    return chunks


def _encoder(path: str, pattern: str):
    @F.arrow_udf("binary")
    def encode(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        enc = encoding(path, pattern)
        for text, first in it:
            yield pa.array([enc.encode_to_numpy(stitched(t, f), disallowed_special=()).astype("<u4", copy=False).tobytes() for t, f in zip(_decoded(text), first.to_pylist())], pa.binary())

    return encode


def _joiner():
    @F.arrow_udf("binary")
    def join(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in it:
            yield pa.array([b"".join(v) for v in x.to_pylist()], pa.binary())

    return join


def give_back() -> None:
    """Return to the machine what earlier stages freed in this reused worker process."""
    encoding.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def coded(text: Column, path: str | None = None, pattern: str | None = None, size: int = CHUNK) -> Column:
    """struct<ids: binary, decoded_sha256: string> of a text, null counting as empty: encoded by chunks and decoded in one
    evaluation, so that a task needs one Python worker with one vocabulary. The chunks of one text are not spread."""
    import numpy as np

    path, pattern = path or default_ranks(), pattern or default_pattern()

    @F.arrow_udf("struct<ids: binary, decoded_sha256: string>")
    def both(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not encoding.cache_info().currsize or (path, pattern) not in _held:
            give_back()
            _held[:] = [(path, pattern)]
        enc, table = encoding(path, pattern), id_bytes(path).__getitem__
        for x in it:
            ids, digests = [], []
            for t in _decoded(x):
                sha, parts = hashlib.sha256(), []
                for i, c in enumerate(overlapping_chunks(t, size)):
                    got = enc.encode_to_numpy(stitched(c, i == 0), disallowed_special=()).astype("<u4", copy=False)
                    sha.update(b"".join(map(table, got.tolist())))
                    parts.append(got)
                ids.append(np.concatenate(parts).tobytes())
                digests.append(sha.hexdigest())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(digests, pa.string())], names=["ids", "decoded_sha256"])

    return both(text.cast("binary"))


def decode(ids: Column, path: str | None = None) -> Column:
    """Bytes of a column of little-endian unsigned 32-bit ids."""
    import numpy as np

    path = path or default_ranks()

    @F.arrow_udf("binary")
    def raw(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = id_bytes(path).__getitem__
        for x in it:
            yield pa.array([b"".join(map(table, np.frombuffer(v.as_buffer(), "<u4").tolist())) if v.is_valid else None for v in x], pa.binary())

    return raw(ids)


def encode(docs: DataFrame, text: str = "text", key: list[str] | None = None, path: str | None = None, pattern: str | None = None, size: int = CHUNK) -> DataFrame:
    """The key columns, n_tokens (long) and ids (binary, little-endian unsigned 32-bit).

    Null and empty texts give no ids. Repeated rows and null keys are kept as they are; columns
    that are not asked for are not read. Only texts over one chunk are shuffled.
    """
    key = key or ["doc_id"]
    path, pattern = path or default_ranks(), pattern or default_pattern()
    enc = _encoder(path, pattern)
    base = docs.select(F.struct(*[F.col(k) for k in key]).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    short = base.where(F.length("_text") <= size).select("_key", enc(F.col("_text").cast("binary"), F.lit(True)).alias("ids"))
    pieces = (
        base.where(F.length("_text") > size)
        .withColumn("_row", F.monotonically_increasing_id())
        .select("_row", "_key", F.posexplode(_chunker(size)(F.col("_text").cast("binary"))).alias("_i", "_chunk"))
        .repartition("_row", "_i")
        .select("_row", "_key", "_i", enc(F.col("_chunk").cast("binary"), F.col("_i") == 0).alias("_ids"))
    )
    whole = pieces.groupBy("_row").agg(F.first("_key").alias("_key"), F.sort_array(F.collect_list(F.struct("_i", "_ids"))).alias("_all"))
    long = whole.select("_key", _joiner()(F.col("_all._ids")).alias("ids"))
    return short.unionByName(long).select("_key.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
