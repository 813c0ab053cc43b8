"""Vectorised hashing of the words and word shingles of many texts with numpy.

Words are maximal runs of letters, digits and "_" of the lower-cased text. Hashes are 64-bit and depend on the
text alone, so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points hashed at once; a longer text makes a chunk of its own.
CHUNK = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of each code point: 1 for a letter, digit or "_", 0 for white space and U+0000, else 2."""
    of = lambda c: 1 if c.isalnum() or c == "_" else 0 if c.isspace() or c == "\0" else 2
    return np.fromiter((of(chr(i)) for i in range(0x110000)), np.int8, 0x110000)


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(base & _MASK, 1 << max(8, (n - 1).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) so that a chunk has about size characters at most."""
    first, have, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and have + len(t) > size:
            yield first, part
            first, have, part = i, 0, []
        part.append(t)
        have += len(t) + 1
    if part:
        yield first, part


def word_hashes(texts: list[str], symbols: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and offsets: the words of text i are at offsets[i] : offsets[i + 1].

    symbols: runs of other characters than white space count as words, too.
    """
    joined = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    cp = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[cp]
    if not symbols:
        kind = kind & 1
    word = kind > 0
    edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[:-1], edge[1:]  # runs of one kind; the last character, U+0000, has kind 0
    inside = word[starts]
    starts, ends = starts[inside], ends[inside]
    offsets = np.zeros(len(texts) + 1, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    offsets[1:] = np.searchsorted(starts, np.flatnonzero(cp == 0))
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letters = cp[word].astype(np.uint64)
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((letters + np.uint64(1)) * powers(_BASE, int(lengths.max()))[place], at)
        return mix(sums), offsets


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, with offsets as word_hashes has them.

    A text of 1 to n - 1 words has one shingle, made of all its words.
    """
    count = np.diff(offsets)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], per)
    last = np.repeat(offsets[1:], per)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            inside = at + k < last
            h = h * np.uint64(_BASE) + np.where(inside, words[np.minimum(at + k, len(words) - 1)], np.uint64(7))
        return mix(h), out


def sequence_keys(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of each text's word sequence, as an array of shape (texts, 2)."""
    count = np.diff(offsets)
    out = np.zeros((len(count), 2), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        place = np.arange(len(words)) - np.repeat(offsets[:-1], count)
        n = int(count.max())
        with np.errstate(over="ignore"):
            for c, (base, salt) in enumerate(((0xD6E8FEB86659FD93, 1), (0xA0761D6478BD642F, 2))):
                out[full, c] = mix(np.add.reduceat(mix(words + np.uint64(salt)) * powers(base, n)[place], offsets[:-1][full]) + count[full].astype(np.uint64))
    return out
