"""Word BPE by a pair occurrence index.

White space always ends a pre-token and Unicode composition never crosses it, so a text is a sequence
of white-space words that can be encoded one by one. The distinct words that a partition has not met
yet are laid side by side as symbols. An index maps each pair's rank to all positions of that pair;
active ranks are applied in ascending order, each to all its positions, and the lists of the pairs
that arise or vanish beside them are updated. A rank makes only pairs of higher rank (checked when the
vocabulary is loaded), so this equals merging each word by itself.

Special tokens found in a text get their own ids, as in the library; none are added.
"""
from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SLICE = 1 << 20  # bytes of a text split into words at a time
GROUP = 4 << 20  # bytes whose new words share one index
KNOWN = 400_000  # words whose ids a worker keeps; the memory is then started anew, ids do not change
_SPACE = re.compile(rb"[\x09-\x0D ]")
_PLAIN = re.compile(r"[!-~]+")
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # the vocabulary's own pattern on U+0021..U+007E


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass
class Merges:
    ids: dict[str, int]  # token -> id
    width: int  # a pair (a, b) has the number a * width + b
    rank: dict[int, int]  # pair number -> rank
    pairs: list[tuple[int, int]]  # by rank
    made: list[int]  # by rank
    keys: np.ndarray  # pair numbers in order, and their ranks
    key_ranks: np.ndarray
    letter: np.ndarray  # code point -> id, inside a word and at its end
    last_letter: np.ndarray
    special: dict[str, int]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model = given["model"]
    ids, end = model["vocab"], model["end_of_word_suffix"] or ""
    width = max(ids.values()) + 1
    pairs, made, met = [], [], set()
    for r, m in enumerate(model["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        pairs.append((ids[a], ids[b]))
        made.append(ids[a + b])
        met |= {ids[a], ids[b]}
        if ids[a + b] in met:
            raise ValueError(f"{path}: merge {r} makes a token that an earlier merge makes or uses")
        met.add(ids[a + b])
    special = {t["content"]: t["id"] for t in given["added_tokens"]}
    keys = np.array([a * width + b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    single = [t for t in ids if len(t) == 1]
    letter = np.full((2, max(map(ord, single)) + 1), -1, np.int64)
    for t in single:
        letter[:, ord(t)] = ids[t], ids[t + end]
    return Merges(ids, width, dict(zip(keys.tolist(), range(len(keys)))), pairs, made, keys[order], order, letter[0], letter[1], special)


def positions_by_rank(sym: np.ndarray, last: np.ndarray, m: Merges) -> dict[int, list[int]]:
    """The index: each rank's pair -> all positions of its left symbol. ``last`` marks the last symbol of a word."""
    key = sym[:-1].astype(np.int64) * m.width + sym[1:]
    slot = np.searchsorted(m.keys, key)
    slot[slot == len(m.keys)] = 0
    at = np.flatnonzero((m.keys[slot] == key) & ~last[:-1])
    found = m.key_ranks[slot[at]]
    order = np.argsort(found, kind="stable")
    at, found = at[order], found[order]
    edge = np.flatnonzero(np.diff(found, prepend=-1))
    return {int(found[i]): part.tolist() for i, part in zip(edge, np.split(at, edge[1:]))}


def merge_all(words: list[str], m: Merges) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of pre-tokens in the vocabulary's letters; none of them is empty."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    last = np.zeros(ends[-1], bool)
    last[ends - 1] = True
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    first_ids = np.where(last, m.last_letter[letters], m.letter[letters])
    where = positions_by_rank(first_ids, last, m)
    sym = first_ids.tolist()
    n = np.arange(len(sym))
    after, before = np.where(last, -1, n + 1).tolist(), np.where(np.roll(last, 1), -1, n - 1).tolist()
    rank, width, listed = m.rank.get, m.width, where.get
    active = list(where)
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        (a, b), new = m.pairs[r], m.made[r]
        places = where.pop(r)
        if a == b:  # occurrences overlap: leftmost first
            places.sort()
        left = new * width
        for i in places:
            j = after[i]
            if j < 0 or sym[i] != a or sym[j] != b:
                continue  # taken by another merge since
            k, p = after[j], before[i]
            sym[i], sym[j], after[i] = new, -1, k
            if k >= 0:
                before[k] = i
                q = rank(left + sym[k])
                if q is not None:
                    held = listed(q)
                    if held is None:
                        where[q] = [i]
                        heapq.heappush(active, q)
                    else:
                        held.append(i)
            if p >= 0:
                q = rank(sym[p] * width + new)
                if q is not None:
                    held = listed(q)
                    if held is None:
                        where[q] = [p]
                        heapq.heappush(active, q)
                    else:
                        held.append(p)
    done = np.array(sym, np.int64)
    kept = done >= 0
    raw = done[kept].astype("<u4").tobytes()
    upto = [0, *(4 * np.cumsum(kept)[ends - 1]).tolist()]
    return [raw[x:y] for x, y in zip(upto, upto[1:])]


class Encoder:
    """Ids of words; keeps those it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = merges(path)
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")") if self.merges.special else None
        self.known: dict[bytes, bytes] = {}

    def pieces(self, word: str) -> list[str]:
        """Pre-tokens of one word in the vocabulary's letters; a special token is a piece of its own."""
        if self.special and "<|" in word:
            out = []
            for k, part in enumerate(self.special.split(word)):
                out += [part] if k % 2 else self.pieces_of_text(part)
            return out
        return self.pieces_of_text(word)

    def pieces_of_text(self, word: str) -> list[str]:
        if _PLAIN.fullmatch(word):
            return _PLAIN_PIECES.findall(word.lower())
        return [p for p, _ in self.split(self.normal(word))] if word else []

    def learn(self, words: Iterable[bytes]) -> None:
        special = {t: np.array([i], "<u4").tobytes() for t, i in self.merges.special.items()}
        owners = [(w, self.pieces(w.decode("utf-8", "replace"))) for w in words]
        fresh = list({p for _, own in owners for p in own} - special.keys())
        ids = dict(zip(fresh, merge_all(fresh, self.merges))) | special
        for w, own in owners:
            self.known[w] = b"".join([ids[p] for p in own]) if len(own) != 1 else ids[own[0]]

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        out: list[list[bytes]] = []
        held, size = [], 0

        def flush() -> None:
            if len(self.known) > KNOWN:
                self.known.clear()
            lists = [(row, s.split()) for row, s in held]
            self.learn({w for _, ws in lists for w in ws} - self.known.keys())
            for row, ws in lists:
                out[row].append(b"".join(map(self.known.__getitem__, ws)))
            held.clear()

        for row, text in enumerate(texts):
            out.append([])
            for s in slices(text):
                held.append((row, s))
                size += len(s)
                if size >= GROUP:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """Parts of a text that end at white space."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def token_texts(path: str) -> list[bytes]:
    m = merges(path)
    out = [b""] * (max([*m.ids.values(), *m.special.values()]) + 1)
    for t, i in [*m.ids.items(), *m.special.items()]:
        out[i] = t.encode()
    return out


def _encoder(path: str):
    @F.arrow_udf("binary")
    def encode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for x in it:
            yield pa.array(enc.encode(v.as_buffer().to_pybytes() if v.is_valid else b"" for v in x), pa.binary())

    return encode


def decode(ids: Column, path: str | None = None) -> Column:
    """UTF-8 bytes of the text that the library gives for a column of little-endian unsigned 32-bit ids.

    The vocabulary names no decoder, so this is its tokens parted by spaces. Null ids give null.
    """
    path = path or default_vocabulary()

    @F.arrow_udf("binary")
    def raw(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = token_texts(path).__getitem__
        for x in it:
            yield pa.array([b" ".join(map(table, np.frombuffer(v.as_buffer(), "<u4").tolist())) if v.is_valid else None for v in x], pa.binary())

    return raw(ids)


def encode(docs: DataFrame, text: str = "text", key: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The key columns, n_tokens (long) and ids (binary, little-endian unsigned 32-bit).

    Null and empty texts, and texts of white space alone, give no ids. Repeated rows and null keys are
    kept as they are; columns that are not asked for are not read; a table without rows gives none.
    A text of any length is read in slices. Nothing is shuffled.
    """
    enc = _encoder(path or default_vocabulary())
    base = docs.select(F.struct(*[F.col(k) for k in key or ["doc_id"]]).alias("_key"), enc(F.col(text).cast("binary")).alias("ids"))
    return base.select("_key.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")
