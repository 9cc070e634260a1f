"""Word shingles of whole texts as 64-bit numbers, computed over Arrow buffers with numpy."""
from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IS_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection, so distinct numbers stay distinct."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15
_P_BACK = pow(_P, -1, 1 << 64)
_SEGMENT = 1 << 18  # bytes hashed at a time; the tables below stay of this size


def _table(p: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, p, np.uint64))])


_UP, _BACK = _table(_P, 2 * _SEGMENT), _table(_P_BACK, 2 * _SEGMENT)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs without U+0020 and U+0009..U+000D)."""
    is_word = np.empty(len(raw) + 2, bool)
    is_word[0] = is_word[-1] = False
    is_word[1:-1] = _IS_WORD[raw]
    turn = np.flatnonzero(is_word[1:] != is_word[:-1])
    return turn[0::2], turn[1::2]


def stretch_numbers(raw: np.ndarray, start: np.ndarray, end: np.ndarray, cuts: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit number for each stretch of bytes (starts ascending), A-Z lower-cased; equal ones have equal numbers.

    With ``cuts`` (at most 64 bytes each), one row more for each: the stretch's first bytes, up to the cut.
    """
    out, i, n = np.empty((1 + len(cuts), len(start)), np.uint64), 0, len(start)
    ends = np.stack([end, *[np.minimum(start + c, end) for c in cuts]])
    while i < n:
        j = max(i + 1, int(np.searchsorted(start, start[i] + _SEGMENT)))
        long = np.flatnonzero(end[i:j] - start[i:j] > _SEGMENT)
        if len(long):  # a single huge word
            j = i + int(long[0]) if long[0] else i + 1
        at = start[i]
        huge = len(long) and long[0] == 0
        piece = raw[at : at + 64] if huge else raw[at : end[j - 1]]
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[_LOWER[piece]] * _UP[: len(piece)], out=total[1:])
        s, e = start[i:j] - at, np.minimum(ends[:, i:j] - at, len(piece))
        out[:, i:j] = mix((total[e] - total[s]) * _BACK[s] + (e - s).astype(np.uint64))
        if huge:
            word = _LOWER[raw[start[i] : end[i]]].tobytes()
            out[0, i] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64)[0]
        i = j
    return out if cuts else out[0]


def word_numbers(raw: np.ndarray) -> np.ndarray:
    """A number for each word, in order."""
    return stretch_numbers(raw, *word_bounds(raw))


_AT = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def windows(numbers: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A number for each window of ``size`` words, in order; a shorter text is one window."""
    n = len(numbers)
    if not n:
        return numbers
    size = min(n, size)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out += mix(numbers[k : n - size + 1 + k] + _AT[k]) * _AT[k]
    return mix(out)


def shingle_set(raw: bytes | np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of a UTF-8 text."""
    if isinstance(raw, bytes):
        raw = np.frombuffer(raw, np.uint8)
    return np.unique(windows(word_numbers(raw), size))


def rows(x):
    """(valid, bytes as a numpy view) for each row of an Arrow binary array."""
    for v in x:
        yield np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid and len(v.as_buffer()) else np.empty(0, np.uint8)


def grouped(x, most: int = 1 << 20):
    """Stretches of rows of an Arrow binary array as one text each (rows parted by a line break):
    (first row, bytes, word starts, word ends, number of words of each row)."""
    at, part, size = 0, [], 0
    held = list(rows(x))
    for k in range(len(held) + 1):
        if part and (k == len(held) or size + len(held[k]) > most):
            gap = np.full(1, 10, np.uint8)
            raw = np.concatenate([p for q in part for p in (q, gap)])
            start, end = word_bounds(raw)
            edge = np.cumsum([len(q) + 1 for q in part])
            upto = np.searchsorted(start, edge)
            yield at, raw, start, end, np.diff(upto, prepend=0)
            at, part, size = k, [], 0
        if k < len(held):
            part.append(held[k])
            size += len(held[k])
