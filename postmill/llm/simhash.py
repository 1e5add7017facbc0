"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 4 bits share a point within 2 bits of both. Every fingerprint therefore
stands for all its variants within 2 bits, and variants meet by their leading bits: a lane is one value of those
bits, a fingerprint goes to each lane that holds one of its variants, and the variants are written out inside the
lane. So the shuffle carries fingerprints, not their 2,081 variants. The number of lanes follows the number of
fingerprints, which bounds a lane's work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import ASCII_LOWER, SPACE, U64, Texts, as_long, mix, slices, stored
from postmill.llm.components import connected_components
from postmill.llm.xxh import xxh64_runs

RADIUS = 4
#: Variants of one fingerprint: those within RADIUS // 2 bits.
BALL = 1 + 64 + 64 * 63 // 2
#: Variants that a lane holds on average, and those sorted at once inside it.
LANE_VARIANTS, CHUNK_VARIANTS = 16 << 20, 1 << 20


def normal_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, lower-cased (A-Z) and each followed by one space: bytes, starts, ends, text of each."""
    inside = ~SPACE[texts.bytes]
    starts, ends = texts.runs(inside)
    docs, sizes = texts.docs_of(starts), ends - starts
    out_starts = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + len(sizes), 32, dtype=np.uint8)
    kept = np.flatnonzero(inside)
    out[kept + np.repeat(out_starts - starts, sizes)] = ASCII_LOWER[texts.bytes[kept]]
    return out, out_starts, out_starts + sizes, docs


def majority_bits(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each run of h, from one begin to the next, the bits that are set in over half its values.

    A value counts as eight bytes of one bit each, which add up in one sum of at most 255 values; those sums are then
    added up bit by bit.
    """
    sizes = np.diff(np.append(begin, len(h)))
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(begin, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    out = np.zeros(len(begin), dtype=U64)
    for low in range(8):
        sums = np.add.reduceat((h >> U64(low)) & U64(0x0101010101010101), at)
        for byte in range(8):
            ones = np.add.reduceat(((sums >> U64(8 * byte)) & U64(0xFF)).astype(np.int64), first)
            out |= np.where(2 * ones > sizes, U64(1) << U64(8 * byte + low), U64(0))
    return out


def fingerprints_of(texts: Texts, size: int = 4, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text over its shingles of size words, repeats included."""
    data, starts, ends, docs = normal_words(texts)
    out = np.zeros(texts.n, dtype=U64)
    if not len(starts):
        return out
    counts = np.bincount(docs, minlength=texts.n)
    first = np.cumsum(counts) - counts
    at = np.flatnonzero(docs[: max(0, len(docs) - size + 1)] == docs[size - 1 :]) if len(docs) >= size else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    lo = np.concatenate([starts[at], starts[first[short]]])
    hi = np.concatenate([ends[at + size - 1], ends[first[short] + counts[short] - 1]])
    owner = np.concatenate([docs[at], short])
    h = xxh64_runs(data, lo, hi, seed)
    order = np.argsort(owner, kind="stable") if len(short) else slice(None)
    h, owner = h[order], owner[order]
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    out[owner[begin]] = majority_bits(h, begin)
    return out


def fingerprints(df: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, fp) of every row of df (doc_id, text, more: longs); a text without words, or null, has fingerprint 0."""
    names = ["doc_id", *more]

    def run(batches):
        for batch in slices(batches, "text"):
            fps = pa.array(as_long(fingerprints_of(Texts(batch.column(len(names))))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], fps], names=[*names, "fp"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *more, "text").mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "fp"]))


def _near(bits: int) -> np.ndarray:
    """All values of that many bits with at most two set."""
    one = [1 << i for i in range(bits)]
    return np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])], dtype=U64)


def _variants(fps: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The variants of fps that start with prefix, and the fingerprint that each is of."""
    rest = 64 - bits
    gap = np.bitwise_count((fps >> U64(rest)) ^ U64(prefix)) if bits else np.zeros(len(fps), dtype=np.uint8)
    tails, low = _near(rest), U64((1 << rest) - 1)
    found, owners = [], []
    for d, used in ((0, tails), (1, tails[: rest + 1]), (2, tails[:1])):
        mine = fps[gap == d]
        found.append((((mine & low) | U64(prefix << rest))[:, None] ^ used[None, :]).ravel())
        owners.append(np.repeat(mine, len(used)))
    return np.concatenate(found), np.concatenate(owners)


def _links(fps: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that the variants under prefix show: of all that share one, each is linked to the smallest."""
    gap = np.bitwise_count((fps >> U64(64 - bits)) ^ U64(prefix)) if bits else np.zeros(len(fps), dtype=np.uint8)
    fps = fps[gap <= 2]
    rest = 64 - bits
    held = int((gap == 0).sum()) * (1 + rest + rest * (rest - 1) // 2) + int((gap == 1).sum()) * (1 + rest) + int((gap == 2).sum())
    if len(fps) < 2:
        return np.zeros(0, U64), np.zeros(0, U64)
    if held > CHUNK_VARIANTS and bits < 62:
        parts = [_links(fps, prefix << 1 | k, bits + 1) for k in (0, 1)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    v, owner = _variants(fps, prefix, bits)
    size = max(10, int(len(v)).bit_length() + 2)
    slot = (mix(v) >> U64(64 - size)).astype(np.int64)
    met = np.bincount(slot, minlength=1 << size)[slot] > 1
    v, owner = v[met], owner[met]
    order = np.lexsort((owner, v))
    v, owner = v[order], owner[order]
    start = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    least = np.repeat(owner[start], np.diff(np.append(start, len(v))))
    real = (owner != least) & (np.bitwise_count(owner ^ least) <= RADIUS)
    pairs = np.unique(np.stack([owner[real], least[real]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def fingerprint_links(fps: DataFrame, lane_variants: int = LANE_VARIANTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp: long, each once) that join all those within RADIUS bits.

    Of fingerprints that share a variant each is linked to the smallest: no link is lost for reachability.
    """
    n = fps.count()
    bits = min(24, max(3, math.ceil(math.log2(max(1, n * BALL / lane_variants)))))
    near, shift = _near(bits), U64(64 - bits)

    def deal(batches):
        for batch in batches:
            own = np.asarray(batch.column(0)).view(U64)
            for a in range(0, len(own), 1 << 14):
                part = own[a : a + (1 << 14)]
                lanes = ((part >> shift)[:, None] ^ near[None, :]).ravel().astype(np.int64)
                order = np.argsort(lanes, kind="stable")
                lanes, sent = lanes[order], np.repeat(part, len(near))[order]
                start = np.flatnonzero(np.append(True, lanes[1:] != lanes[:-1]))
                ends = np.append(start[1:], len(lanes))
                yield pa.RecordBatch.from_arrays([pa.array(lanes[start]), pa.array([sent[x:y].tobytes() for x, y in zip(start, ends)], pa.binary())], names=["lane", "fps"])

    def meet(key, table):
        own = np.frombuffer(b"".join(table.column("fps").to_pylist()), dtype=U64)
        a, b = _links(own, key[0].as_py(), bits)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.table({"a": pa.array(as_long(np.ascontiguousarray(pairs[:, 0]))), "b": pa.array(as_long(np.ascontiguousarray(pairs[:, 1])))})

    return fps.select("fp").mapInArrow(deal, "lane long, fps binary").groupBy("lane").applyInArrow(meet, "a long, b long").distinct()


def _components(distinct: DataFrame) -> DataFrame:
    """distinct (fp, least), each fp once, with component: the smallest fingerprint reachable."""
    parts = connected_components(fingerprint_links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def near_copies(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at RADIUS bits or fewer are linked, component_id is the smallest doc_id reachable. Texts without
    words (null too) share fingerprint 0. A null doc_id gets its component like any other, and a component whose
    ids are all null has a null one. Copies meet in their fingerprint, before any link is sought. Rows that repeat have
    a row each, an empty table gives no rows, texts of any length count whole, and further columns are not read.
    """
    docs = stored(fingerprints(df), "fingerprints")
    distinct = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    named = _components(distinct)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id")
    return docs.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_rows(df: DataFrame) -> DataFrame:
    """Of each component of near copies among df (doc_id, tag: long, text) the smallest (doc_id, tag)."""
    docs = fingerprints(df, "tag")
    distinct = stored(docs.groupBy("fp").agg(F.min(F.struct("doc_id", "tag")).alias("least")), "distinct-fingerprints")
    return _components(distinct).groupBy("component").agg(F.min("least").alias("least")).select("least.*")
