"""Helpers that the operators share: the shared folder, and words of Arrow batches as NumPy arrays."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes to themselves.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Text that a task takes at once, in bytes; a longer document is taken alone.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="postmill-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Asks the driver to drop the shuffle files of what no one refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_long(x):
    """Unsigned 64-bit values as the signed ones that Spark has."""
    return np.asarray(x, dtype=U64).view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(batches, column: str, limit: int = BATCH_BYTES):
    """Record batches, cut so that the texts in column have about limit bytes together."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0)).astype(np.int64)
        part = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class Texts:
    """The texts of an Arrow column as one array of UTF-8 bytes; null counts as empty.

    offsets[i]:offsets[i + 1] are the bytes of text i.
    """

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        column = pa.compute.fill_null(column, "")
        raw = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8) if len(column) else np.zeros(0, np.uint8)
        self.bytes = data[raw[0] : raw[-1]]
        self.offsets = raw - raw[0]
        self.n = len(column)

    def docs_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that each byte position is in."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many set flags (one a byte) each text has."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of set flags (one a byte) that stay in one text."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        lo, hi = self.offsets[:-1][np.diff(self.offsets) > 0], self.offsets[1:][np.diff(self.offsets) > 0] - 1
        first[lo], last[hi] = inside[lo], inside[hi]
        return np.flatnonzero(first), np.flatnonzero(last) + 1


def equal_runs(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a rising array, each once, and where its run starts and ends; the work is that of the array alone."""
    if not len(rising):
        return rising, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, rising[1:] != rising[:-1]))
    return rising[start], start, np.append(start[1:], len(rising))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], eight bytes at a step."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
    rest = ends - starts
    out = mix(rest.astype(U64) + U64(0x9E3779B97F4A7C15))
    live, at, h = None, starts, out
    while len(at):
        h = mix(h ^ (words[at] & masks[np.minimum(rest, 8)]))
        if live is None:
            out = h
        else:
            out[live] = h
        more = np.flatnonzero(rest > 8)
        live = more if live is None else live[more]
        at, rest, h = at[more] + 8, rest[more] - 8, h[more]
    return out


def windows(words: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of size words that lie in one text, and the index of each one's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= U64(0x9E3779B97F4A7C15)
        h += words[k : n + k]
    at = np.flatnonzero(docs[:n] == docs[size - 1 :])
    return mix(h[at]), at
