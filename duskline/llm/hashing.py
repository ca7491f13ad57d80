"""Vectorised hashing of the words of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Symbols hashed at once.
BLOCK = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the published splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, parts: int = 1) -> np.ndarray:
    """A hash of ``parts`` (one or two) times 64 bits of each of the segments ``starts``..``stops`` (ascending, not
    overlapping) of ``values``: ``[parts, segments]``.

    Every symbol is scrambled together with its place in its segment, and a segment's hash is the scrambled sum. A
    polynomial modulo 2**64 would not do: it is equal on some words of 1024 or more symbols whatever its base.
    """
    sums = np.zeros((parts, len(values) + 1), np.uint64)
    origin = 0  # of the segment that the last block ended in
    cuts = np.searchsorted(starts, np.arange(0, len(values) + BLOCK, BLOCK))
    for i, at in enumerate(range(0, len(values), BLOCK)):  # in blocks, as large temporary arrays cost more than the work
        part = values[at : at + BLOCK].astype(np.uint64)
        begin = np.zeros(len(part), np.int64)
        begin[0] = origin
        own = starts[cuts[i] : cuts[i + 1]]
        begin[own - at] = own
        begin = np.maximum.accumulate(begin)
        origin = begin[-1]
        part += np.uint64(1)
        part |= (np.arange(at, at + len(part)) - begin).astype(np.uint64) << np.uint64(24)
        part *= _ODD
        part = mix(part)
        for total in sums:
            own = part.copy()
            own[:1] += total[at : at + 1]
            np.cumsum(own, out=total[at + 1 : at + 1 + len(own)])
            part ^= part >> np.uint64(32)
            part *= np.uint64(0x94D049BB133111EB)
    return mix(sums[:, stops] - sums[:, starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, document)`` of each word: runs of bytes other than ASCII white space, A-Z lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return segment_hashes(_LOWER[data], starts, stops)[0], np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, document)`` of the distinct k-word shingles, 64-bit hashes ascending in each document.

    A document of fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    words, doc = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    factor = mix(np.arange(1, k + 2, dtype=np.uint64) * _ODD) | np.uint64(1)
    joined = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for i in range(k):
        joined += words[i : i + len(joined)] * factor[i]
    full = np.flatnonzero(doc[: len(joined)] == doc[k - 1 :][: len(joined)]) if len(joined) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    whole = np.zeros(len(short), np.uint64)
    for i in range(k - 1):
        has = count[short] > i
        whole[has] += words[first[short[has]] + i] * factor[i]
    whole += count[short].astype(np.uint64) * factor[k]
    keys, owner = mix(joined[full]), doc[full]
    ends = np.searchsorted(owner, np.arange(n_docs + 1)).tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        keys[a:b].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = np.concatenate((keys[new], mix(whole))), np.concatenate((owner[new], short))
    order = np.argsort(owner.astype(np.min_scalar_type(n_docs)), kind="stable")
    return keys[order], owner[order]
