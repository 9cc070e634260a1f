"""Secret scan: fixed patterns, and random strings found by how badly a tokenizer compresses them.

Prose and identifiers made of words take three or more characters per token of a public
vocabulary; keys and passwords take about one to two. A candidate string is tested when no fixed
pattern covers it and it is not a known harmless form (digest, UUID, number). Paths and assignments
are decided by their parts: a candidate with a quarter of words or digests among its parts is none itself, but
each of its long parts is tested. Passwords in the user part of an address are tested from 8 characters.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bpe

# fixed values: the patterns of the contract
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# fixed values: forms that look random and are public: digests by length, UUIDs, numbers and dates
_HARMLESS = re.compile(
    r"(?:sha\d+-)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+|(.)\1+"
)
_PART = re.compile(r"[^/=]+")
_LEAST, _WORD = 20, 4  # characters of a candidate, and of a part that can be told from random
_USER = re.compile(r"://[^\s/:@]*:([^\s/@]{8,})@")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns; matches that fail the length rule are dropped, not retried."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def random_spans(text: str, taken: list[tuple[int, int, int]], enc, ratio: float) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []

    def random(v: str) -> bool:
        return not _HARMLESS.fullmatch(v) and len(v) <= ratio * len(enc.encode_ordinary(v))

    def free(s: int, e: int) -> bool:
        return not any(a < e and s < b for a, _, b in taken) and not any(a < e and s < b for a, _, b in out)

    if "://" in text:
        out += [(m.start(1), 3, m.end(1)) for m in _USER.finditer(text) if free(*m.span(1)) and random(m[1])]
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        parts = list(_PART.finditer(m[0]))
        words = sum(len(p[0]) for p in parts if len(p[0]) >= _WORD and not random(p[0]))
        if 4 * words < sum(len(p[0]) for p in parts) and free(s, e) and random(m[0]):
            out.append((s, 3, e))
            continue
        out += [(s + p.start(), 3, s + p.end()) for p in parts if len(p[0]) >= _LEAST and free(s + p.start(), s + p.end()) and random(p[0])]
    return out


def find(text: Column, path: str | None = None, ratio: float = 2.2) -> Column:
    """array<struct<start, end, kind>>, sorted by start, then kind; code points, end exclusive.

    ``ratio``: most characters per token of a random string. Null and empty texts have none.
    """
    import public_tokenizers

    path, pattern = path or default_ranks(), public_tokenizers.PATTERN

    @F.arrow_udf("array<struct<start:int,end:int,kind:string>>")
    def spans(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = bpe.encoding(path, pattern)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for x in it:
            out = []
            for t in bpe._decoded(x):
                base = base_spans(t)
                out.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in sorted(base + random_spans(t, base, enc, ratio))])
            yield pa.array(out, kind)

    return spans(F.coalesce(text, F.lit("")).cast("binary"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, text: str = "text", key: list[str] | None = None, path: str | None = None, ratio: float = 2.2) -> DataFrame:
    """The key columns and ``found`` (see find) for every row; repeated rows and null keys stay."""
    return docs.select(*[F.col(k) for k in key or ["doc_id"]], find(F.col(text), path, ratio).alias("found"))


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each found stretch, overlapping ones together, replaced by a mark."""
    at, parts = 0, []
    for start, _, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(text: Column, path: str | None = None, ratio: float = 2.2, mark: str = "[SECRET]") -> Column:
    """The text with its secrets replaced; null where there are none to replace (null texts too)."""
    import public_tokenizers

    path, pattern = path or default_ranks(), public_tokenizers.PATTERN

    @F.arrow_udf("string")
    def cut(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = bpe.encoding(path, pattern)
        for x in it:
            out = []
            for t in bpe._decoded(x):
                base = base_spans(t)
                found = base + random_spans(t, base, enc, ratio)
                out.append(redact(t, found, mark) if found else None)
            yield pa.array(out, pa.string())

    return cut(F.coalesce(text, F.lit("")).cast("binary"))
