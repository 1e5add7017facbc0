"""XXH64 of many short byte strings at a time, in NumPy; the values are those of the published algorithm."""

from __future__ import annotations

import numpy as np
import xxhash

from postmill.llm.common import U64

# The primes of XXH64.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Strings of one length are hashed together where there are so many of them and they are no longer than that.
MANY, LONG = 32, 512


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    high = x << U64(n)
    high |= x >> U64(64 - n)
    return high


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _same_length(words: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the strings of size bytes that begin at; words[i] are the eight bytes from i on."""
    h = np.full(len(at), (seed + int(P5)) % 2**64, dtype=U64)
    done = 0
    if size >= 32:
        lanes = [np.full(len(at), x % 2**64, dtype=U64) for x in (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))]
        while size - done >= 32:
            lanes = [_round(lane, words[at + (done + 8 * k)]) for k, lane in enumerate(lanes)]
            done += 32
        h = sum(_rotl(lane, n) for lane, n in zip(lanes, (1, 7, 12, 18)))
        for lane in lanes:
            h = (h ^ _round(U64(0), lane)) * P1 + P4
    h += U64(size)
    while size - done >= 8:
        h = _rotl(h ^ _round(U64(0), words[at + done]), 27) * P1 + P4
        done += 8
    if size > done:
        rest = words[at + done]
        if size - done >= 4:
            h = _rotl(h ^ (rest & U64(0xFFFFFFFF)) * P1, 23) * P2 + P3
            rest = rest >> U64(32)
            done += 4
        for _ in range(size - done):
            h = _rotl(h ^ (rest & U64(0xFF)) * P5, 11) * P1
            rest = rest >> U64(8)
    h ^= h >> U64(33)
    h *= P2
    h ^= h >> U64(29)
    h *= P3
    return h ^ (h >> U64(32))


def xxh64_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each data[start:end]; strings of a rare length, or a very long one, are hashed one by one."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    out = np.zeros(len(starts), dtype=U64)
    kind = np.minimum(sizes, LONG + 1).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    bound = np.searchsorted(kind[order], np.arange(LONG + 2))
    single = [order[bound[LONG + 1] :]]
    for size in np.flatnonzero(np.diff(bound)).tolist():
        own = order[bound[size] : bound[size + 1]]
        if len(own) < MANY:
            single.append(own)
        else:
            out[own] = _same_length(words, starts[own], size, seed)
    own = np.concatenate(single)
    view = memoryview(padded)
    out[own] = np.fromiter((xxhash.xxh64_intdigest(view[a:b], seed) for a, b in zip(starts[own].tolist(), ends[own].tolist())), dtype=U64, count=len(own))
    return out
