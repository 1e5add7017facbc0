"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. For the size class with at most u shingles, a document is cut
into windows of 2u shingles at a stride of u, so that each run of u shingles lies in one window and the Jaccard
similarity of item and window stays large however long the document is. Item and window are a candidate pair if
one of their MinHashes is equal; candidates are verified by exact containment of the item's shingles in the whole
document.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import U64, Texts, hash_runs, mix, slices, stored, windows

SHINGLE, THRESHOLD, PERMUTATIONS, SMALLEST_CLASS = 5, 0.8, 64, 4
#: UTF-8 bytes of item text that are sent to the workers at once; more items go in further blocks.
BLOCK_BYTES = 16 << 20
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Odd multipliers; the low bits of a product depend on the low bits of the shingle's hash alone, so high bits decide.
FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=U64)) | U64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all five-word shingles of lower-cased letters and digits, the text of each, and the number of texts."""
    texts = Texts(pa.compute.utf8_lower(column))
    starts, ends = texts.runs(WORD_BYTES[texts.bytes])
    docs = texts.docs_of(starts)
    h, at = windows(hash_runs(texts.bytes, starts, ends), docs, SHINGLE)
    return h, docs[at], texts.n


class Items:
    """A bounded block of items: distinct shingles, signatures by size class."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, docs, n = shingles(pa.array(texts, pa.string()))
        found: dict[bytes, int] = {}
        self.ids, self.sets = [], []
        for i in sorted(range(n), key=lambda i: (ids[i] is None, ids[i])):
            own = np.unique(h[np.searchsorted(docs, i) : np.searchsorted(docs, i, side="right")])
            if len(own) and own.tobytes() not in found:
                found[own.tobytes()] = len(self.ids)
                self.ids.append(ids[i])
                self.sets.append(own)
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_class: dict[int, list[int]] = {}
        for k, own in enumerate(self.sets):
            by_class.setdefault(max(SMALLEST_CLASS, 1 << (len(own) - 1).bit_length()), []).append(k)
        for top, members in by_class.items():
            signature = np.array([[(self.sets[k] * a).min() for k in members] for a in FACTORS], dtype=U64)
            orders = np.argsort(signature, axis=1, kind="stable")
            self.classes[top] = [(row[o], np.array(members)[o]) for row, o in zip(signature, orders)]


def _blocks(docs: np.ndarray, width: int) -> np.ndarray:
    """Starts of runs of at most width entries that stay in one text."""
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    local = np.arange(len(docs)) - np.repeat(first, np.diff(np.append(first, len(docs))))
    return np.flatnonzero(local % width == 0)


def contained(column: pa.Array, items: Items, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of every text that holds an item to the threshold or more."""
    h, docs, _ = shingles(column)
    if not len(h) or not items.classes:
        return []
    base = min(items.classes)
    starts = _blocks(docs, base)
    least = np.stack([np.minimum.reduceat(h * a, starts) for a in FACTORS])
    owner = docs[starts]
    pairs: set[tuple[int, int]] = set()
    for top, rows in items.classes.items():
        at = _blocks(owner, top // base)
        block_docs = owner[at]
        joined = block_docs[1:] == block_docs[:-1]
        for k, (values, members) in enumerate(rows):
            block = np.minimum.reduceat(least[k], at)
            block[:-1] = np.where(joined, np.minimum(block[:-1], block[1:]), block[:-1])
            lo = np.searchsorted(values, block)
            hits = np.flatnonzero((lo < len(values)) & (values[np.minimum(lo, len(values) - 1)] == block))
            hi = np.searchsorted(values, block[hits], side="right")
            pairs.update((d, members[j]) for d, a, b in zip(block_docs[hits].tolist(), lo[hits].tolist(), hi.tolist()) for j in range(a, b))
    out = []
    for d, item in sorted(pairs):
        own = h[np.searchsorted(docs, d) : np.searchsorted(docs, d, side="right")]
        shared = int(np.isin(items.sets[item], own).sum())
        if shared >= threshold * len(items.sets[item]) - 1e-9:
            out.append((d, int(item), shared))
    return out


def distinct_items(items: DataFrame) -> DataFrame:
    """(item_id, text, key) of items (item_id, text): of those with equal shingles one, under the smallest item_id.

    key is a digest of the shingles. Items without a shingle match nothing and are left out.
    """

    def keyed(batches):
        for batch in slices(batches, "text"):
            h, docs, n = shingles(batch.column(1))
            cuts = np.searchsorted(docs, np.arange(n + 1))
            keys = [hashlib.sha256(np.unique(h[a:b]).tobytes()).digest() if b > a else None for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["item_id", "text", "key"])

    found = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(keyed, "item_id long, text string, key binary").where("key is not null")
    return stored(found.groupBy("key").agg(F.min("item_id").alias("item_id"), F.min("text").alias("text")).select("item_id", "text", "key"), "distinct-items")


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The distinct items (item_id, text) in blocks of about block_bytes of text, one at a time."""
    items = distinct_items(items)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(total / block_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k).select("item_id", "text").collect()
        yield Items([r[0] for r in part], [r[1] for r in part])


def contaminated(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of each document that holds an item.

    Items with the same shingles count as one, under the smallest item_id. Items and texts of fewer than five
    words, and nulls, have no shingle and match nothing. Each block of items is one pass over df; no item, no row.
    Rows that repeat have their rows again, further columns are not read, an empty table gives no rows, and texts of
    any length are searched whole.
    """
    spark = df.sparkSession
    schema = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
    out = spark.createDataFrame([], schema)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def search(batches, sent=sent):
            own = sent.value
            for batch in slices(batches, "text"):
                found = contained(batch.column(1), own, threshold)
                sizes = [len(own.sets[i]) for _, i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([d for d, _, _ in found], pa.int64())), pa.array([own.ids[i] for _, i, _ in found], pa.int64()), pa.array(sizes, pa.int64()), pa.array([s for _, _, s in found], pa.int64()), pa.array([s / n for (_, _, s), n in zip(found, sizes)], pa.float64())],
                    names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                )

        out = out.unionAll(docs.mapInArrow(search, schema))
    return out


def without_items(df: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose text holds no item to the threshold or more, with all their columns, whatever their names.

    Null and empty texts, and those of fewer than five words, hold none and stay; rows that repeat stay or go together;
    without rows or items df stays as it is; texts of any length are searched whole.
    """
    for block in item_blocks(items):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def keep(batches, sent=sent):
            for batch in slices(batches, "text"):
                bad = [d for d, _, _ in contained(batch.column(batch.schema.get_field_index("text")), sent.value, threshold)]
                flags = np.ones(batch.num_rows, dtype=bool)
                flags[bad] = False
                yield batch.filter(pa.array(flags))

        df = df.mapInArrow(keep, df.schema)
    return df
