"""Vectorised word splitting and hashing over blocks of UTF-8 text.

All word rules of the operators separate words at ASCII characters only, so
they can be applied to the bytes.  A word's hash is a polynomial over a table
of mixed byte values, read from prefix sums (no loop over words), and mixed
once more; n-gram hashes combine word hashes the same way.  Hashes have 64
bits: two different n-grams of a trillion agree with a chance of about 0.03.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
MULT = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _class(ranges: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


#: ``[^\x20\x09-\x0D]+``: all but white space
NONSPACE = ~_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing): digits, a-z and all beyond ASCII
ALNUM = _class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BYTE_VALUE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(MULT))
_BASE = 0xD1342543DE82EF95
#: powers for blocks of the usual size
SHORT_TABLE = (1 << 19) + (1 << 16)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i <= n, kept per worker up to 8 M."""
    have = _POWERS.get("p")
    if have is not None and len(have) > n:
        return have, _POWERS["i"]
    size = max(n + 1, SHORT_TABLE)
    inv = pow(_BASE, -1, 1 << 64)

    def table(base: int) -> np.ndarray:
        out = np.ones(1, U64)
        while len(out) < size:
            out = np.concatenate([out, out[:size - len(out)] * U64(pow(base, len(out), 1 << 64))])
        return out

    p, i = table(_BASE), table(inv)
    if size <= 1 << 23:
        _POWERS["p"], _POWERS["i"] = p, i
    return p, i


def forget_long() -> None:
    """Drop the kept powers if they are more than blocks of the usual size need."""
    if len(_POWERS.get("p", ())) > SHORT_TABLE:
        _POWERS.clear()


def by_byte(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` for a table of bytes, several times as fast; read-only."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any span."""
    p, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    sums = out[1:]  # in place, the copies of a block would cost more than the sums
    np.take(BYTE_VALUE, data, out=sums, mode="clip")
    sums *= p[:len(data)]
    np.cumsum(sums, out=sums)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(MULT))


def word_spans(data: np.ndarray, off: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): byte spans of all words; row r has the words
    bounds[r]:bounds[r + 1]."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    m = by_byte(cls, data)
    s = m.copy()
    s[1:] &= ~m[:-1]
    e = m.copy()
    e[:-1] &= ~m[1:]
    first = off[:-1][off[:-1] < off[1:]]
    last = off[1:][off[:-1] < off[1:]] - 1
    s[first] = m[first]
    e[last] = m[last]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray, cls: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds by row)."""
    if lower:
        data = by_byte(LOWER, data)
    start, end, bounds = word_spans(data, off, cls)
    return span_hash(prefix_hash(data), start, end), bounds


def word_hashes_in_parts(data: np.ndarray, off: np.ndarray, cls: np.ndarray, lower: bool, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of many texts, computed for whole rows of about ``limit`` bytes at a time."""
    words, bounds, lo, n = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        h, b = word_hashes(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], cls, lower)
        words.append(h)
        bounds.append(b[1:] + bounds[-1][-1])
        lo = hi
    return np.concatenate(words), np.concatenate(bounds)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i + k] for each i (without regard to rows)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, U64(k), U64)
    for j in range(k):
        h = h * U64(MULT) + words[j:j + n]
    return mix(h)


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole short sequence; ``gram_hashes`` of its length."""
    return int(gram_hashes(words, len(words))[0])
