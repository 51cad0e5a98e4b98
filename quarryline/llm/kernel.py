"""Vectorised text kernels over Arrow batches: code points, word hashes and span hashes in numpy.

Texts are joined into chunks of about CHUNK code points, so each numpy pass works on arrays that fit the cache and
a worker's memory doesn't depend on the batch. Whole texts are processed; a text longer than a chunk forms a chunk
of its own, or, for windowed kernels, several that overlap.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))

_tables: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values; every output bit depends on every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def unmixed(x: np.ndarray) -> np.ndarray:
    """The value that mixed() gives x for."""
    x = x ^ (x >> U64(32))
    for _ in range(2):
        x = x * U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        x ^= x >> U64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_tables.get("pow", ())) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("pow", BASE), ("inv", BASE_INVERSE)):
            x = np.full(size, base, U64)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["pow"], _tables["inv"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts whose joined length stays below limit, or that hold one text."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > limit:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)


def char_table(kind: str) -> np.ndarray:
    """By code point. "word": letters, numbers and underscore; "marked": letters, combining marks and numbers;
    "alnum": letters and numbers; "lower": the lower-case code point where it is a single one; "noise": random values."""
    if kind in _tables:
        return _tables[kind]
    top = sys.maxunicode + 1
    if kind == "noise":
        out = mixed(np.arange(1, top + 1, dtype=U64) * U64(0xA0761D6478BD642F))
    elif kind == "lower":
        out = np.arange(top, dtype=np.uint32)
        for c in range(top):
            if (low := chr(c).lower()) != chr(c) and len(low) == 1:
                out[c] = ord(low)
    else:
        initials = {"word": "LN", "marked": "LMN", "alnum": "LN"}[kind]
        out = np.fromiter((unicodedata.category(chr(c))[0] in initials for c in range(top)), bool, top)
        if kind == "word":
            out[ord("_")] = True
    _tables[kind] = out
    return out


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with hash of values[s:e] = (H[e] - H[s]) * BASE**-s, for 64-bit values."""
    p, _ = powers(len(values) + 1)
    h = np.empty(len(values) + 1, U64)
    h[0] = 0
    np.cumsum(values * p[: len(values)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(h))
    return mixed((h[end] - h[start]) * inv[start])


def word_hashes(texts: list[str], kind: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and for each text the number of words before it (with
    the total at the end). A word is a maximal run of characters of the kind."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    cp = code_points("\n".join(texts))
    inside = char_table(kind)[cp]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    h = prefix_hash(char_table("noise")[char_table("lower")[cp]])
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 1, out=first[1:])
    return span_hash(h, start, end), np.searchsorted(start, first)


def unit_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, with each letter or digit as a unit of its own."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    cp = code_points("\n".join(texts))
    at = np.flatnonzero(char_table("alnum")[cp])
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 1, out=first[1:])
    return char_table("noise")[char_table("lower")[cp[at]]], np.searchsorted(at, first)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words that lie within one text, and the positions of their first words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    h = prefix_hash(words)
    left = np.full(len(words), -1, np.int64)  # words left in the text from here on
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(len(words))
    at = np.flatnonzero(left[:n] >= k)
    return span_hash(h, at, at + k), at


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in three passes whatever w is."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Whether each value is in sorted_set: a bitmap of 22 bits first, then a binary search for what passed."""
    out = np.zeros(len(values), bool)
    if not len(sorted_set) or not len(values):
        return out
    bits = np.zeros(1 << 22, bool)
    bits[(sorted_set >> U64(42)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(values >> U64(42)).astype(np.int64)])
    found = np.searchsorted(sorted_set, values[at])
    found[found == len(sorted_set)] = 0
    out[at[sorted_set[found] == values[at]]] = True
    return out
