"""Shingle sets and MinHash signatures of whole texts, computed in numpy over a batch.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A to Z. A set holds 64-bit hashes of
the distinct shingles of five words; a text of fewer words has one shingle, the whole
sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

WORDS = 5
BASE = 0x9E3779B97F4A7C15
#: One odd factor for each place in a shingle, and one for the length of a short one.
PLACES = np.array([pow(BASE, 2 * i + 3, 1 << 64) | 1 for i in range(WORDS)], np.uint64)
SHORT = 0xD6E8FEB86659FD93
#: Bytes that are handled at once, unless one text is longer.
BATCH = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    word = np.ones(len(raw) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    n = 1 << max(18, len(raw).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(n, BASE)[: len(raw)], out=sums[1:])
    back = powers(n, pow(BASE, -1, 1 << 64))
    return start, end, mixed((sums[end] - sums[start]) * back[start])


def batched(texts: Iterable[str | None], size: int = BATCH) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if part and held + len(raw) > size:
            yield part
            part, held = [], 0
        part.append(raw)
        held += len(raw) + 1
    if part:
        yield part


def shingle_sets(raws: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle sets of texts, one after another, and where each starts (and the last ends)."""
    data = b"\n".join(raws).lower()
    lengths = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
    first = np.cumsum(lengths) - lengths
    start, _, h = word_hashes(data)
    owner = np.searchsorted(first, start, side="right") - 1
    counts = np.bincount(owner, minlength=len(raws))
    begin = np.cumsum(counts) - counts
    n = max(0, len(h) - words + 1)
    sums = np.zeros(n, np.uint64)
    for i in range(words):
        sums += h[i : i + n] * PLACES[i]
    same = owner[:n] == owner[words - 1 :] if n else np.zeros(0, bool)
    sums = mixed(sums)
    out, offsets = [], [0]
    for b, c in zip(begin.tolist(), counts.tolist()):
        if c >= words:
            s = np.sort(sums[b : b + c - words + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif c:
            with np.errstate(over="ignore"):
                short = (h[b : b + c] * PLACES[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(SHORT * c & (1 << 64) - 1)
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
        offsets.append(offsets[-1] + len(out[-1]))
    assert same.size == n
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(offsets)


@lru_cache(4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_240_501))
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minhash(flat: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n minima of each set; rows of empty sets are all ones."""
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        x, starts = (flat >> np.uint64(32)).astype(np.uint32), offsets[some]
        held = np.empty_like(x)
        for i, (a, c) in enumerate(zip(*_functions(n))):
            np.multiply(x, a, out=held)
            held += c
            out[some, i] = np.minimum.reduceat(held, starts)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature; the band's number is part of it."""
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            k = mixed(k * np.uint64(BASE) + signatures[:, b * rows + r])
        keys[:, b] = k
    return keys.view(np.int64)


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared, len(a) + len(b) - shared
