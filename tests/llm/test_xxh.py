"""XXH64 and majority bits in NumPy against the plain definitions."""

import numpy as np
import pyarrow as pa
import xxhash

from postmill.llm import simhash, xxh
from postmill.llm.common import Texts


def test_every_length_and_offset():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 40_000, dtype=np.uint8)
    sizes = np.concatenate([np.repeat(np.arange(0, 140), 40), rng.integers(0, 700, 300), [511, 512, 513, 9_000, 40_000, 0]])
    starts = rng.integers(0, len(data) - sizes + 1)
    raw = data.tobytes()
    for seed in (0, 42, 2**64 - 1):
        wanted = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a, n in zip(starts.tolist(), sizes.tolist())]
        assert xxh.xxh64_runs(data, starts, starts + sizes, seed).tolist() == wanted
    none = np.zeros(0, np.int64)
    assert len(xxh.xxh64_runs(data, none, none)) == 0


def test_bits_of_runs_of_any_length():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 2, 3, 254, 255, 256, 510, 511, 5_000, 1])
    h = rng.integers(0, 2**64, int(sizes.sum()), dtype=np.uint64) | np.uint64(1 << 63 | 1)
    begin = np.cumsum(sizes) - sizes
    wanted = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h[a : a + n].tolist()) > n) for a, n in zip(begin.tolist(), sizes.tolist())]
    assert simhash.majority_bits(h, begin).tolist() == wanted


def test_a_giant_word_and_many_equal_lengths():
    texts = ["x" * 300_000 + " b c d e", "ab cd ef gh " * 200, "ÄÖ Ünïcode WORDS here now", "", " \t", "one two"]
    words = [t.translate({c: c + 32 for c in range(65, 91)}).split() for t in texts]
    wanted = []
    for own in words:
        h = [xxhash.xxh64_intdigest(" ".join(own[i : i + 4]).encode(), 42) for i in range(max(1, len(own) - 3))] if own else []
        wanted.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert simhash.fingerprints_of(Texts(pa.array(texts))).tolist() == wanted
