"""Hashes of words and shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that are not part of words: white space, or everything but letters, digits and bytes of other characters.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least."""
    if len(_POWERS[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        inverse = pow(_P, -1, 1 << 64)
        for k, base in enumerate((_P, inverse)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batches, rows: int = 256):
    """Record batches in pieces, so that few texts stand in Python's memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches, names: list[str], most: int, row: int = 1):
    """Rows across batches in runs of about `most` characters of `text`, each as a list a column; a row counts `row`
    characters more."""
    held, size, each = [[] for _ in names], 0, row
    at = names.index("text")
    for batch in slices(batches, 64):
        rows = [batch.column(n).to_pylist() for n in names]
        for row in zip(*rows, strict=True):
            if size and size + len(row[at]) > most:
                yield held
                held, size = [[] for _ in names], 0
            for h, v in zip(held, row, strict=True):
                h.append(v)
            size += len(row[at]) + each
    if size:
        yield held


def groups(texts, most: int = 1 << 20):
    """Runs of texts (as bytes) with about `most` bytes together; a longer text stands alone. Yields (first, list)."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield at, held


def word_hashes(texts: list[bytes], apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, byte position in the joined texts) of each word: runs of bytes not in `apart`."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    word = ~apart[data]
    starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]])) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    power, inverse = _powers(len(data))
    value = (data.astype(np.uint64) + np.uint64(1)) * power[: len(data)]
    value[~word] = 0
    h = mix(np.add.reduceat(value, starts) * inverse[starts])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(ends, starts, side="right"), starts


def parts(texts: list[bytes], apart: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, kind) of each word, kind 0, and of the first n bytes of each longer one, for each n of sizes
    (a kind each); hashes of different kinds differ."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    h, of, starts = word_hashes(texts, apart)
    if not len(starts):
        return h, of, of
    word = ~apart[data]
    ends = np.flatnonzero(word & np.append(~word[1:], True)) + 1
    power, _ = _powers(max(sizes))
    found, owner, kind = [h], [of], [np.zeros(len(h), np.int64)]
    for k, n in enumerate(sizes, 1):
        longer = ends - starts > n
        at = starts[longer]
        total = np.full(len(at), k * 0x51ED27, np.uint64)
        for i in range(n):
            total += (data[at + i].astype(np.uint64) + np.uint64(1)) * power[i]
        found.append(mix(total))
        owner.append(of[longer])
        kind.append(np.full(len(at), k))
    return np.concatenate(found), np.concatenate(owner), np.concatenate(kind)


def shingles(texts: list[bytes], n: int = 5, apart: np.ndarray = SPACES) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; a text of fewer words is one run."""
    h, of, _ = word_hashes(texts, apart)
    counts = np.bincount(of, minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(counts)])
    if len(h) >= n:
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total = mix(total + h[k : len(h) - n + 1 + k])
    out = []
    for i, c in enumerate(counts):
        if c >= n:
            out.append(np.unique(total[at[i] : at[i] + c - n + 1]))
        elif c:
            one = np.full(1, c, np.uint64)
            for k in range(c):
                one = mix(one + h[at[i] + k])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
