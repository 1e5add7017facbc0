"""Documents packed into blocks, so that what other tasks find out about a block comes back to it in one piece.

A block is a row of some MB of text in a table that is bucketed by block: grouping it by block, alone or with notes,
shuffles the notes only. Notes are rows (block, kind, bucket, one, two): what bucket says of the entries that the
block sent to it, in the order in which it sent them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from postmill.llm.common import Texts, shared_path, slices

#: Text bytes of a block and of a bucket of the table, on average; the most buckets that Spark takes.
BLOCK_BYTES, TABLE_BYTES, MOST_TABLE_BUCKETS = 4 << 20, 16 << 20, 100_000
BLOCKS = "block long, ids array<bigint>, ends binary, text binary"
NOTES = "block long, kind string, bucket int, one binary, two binary"


def pack(batches, size: int):
    """Rows (doc_id, text) as BLOCKS of about size bytes; a longer document is in a block as it is."""
    ids, sizes, texts, held, part, n = [], [], [], 0, TaskContext.get().partitionId(), 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array([part << 33 | n], pa.int64()), pa.array([pa.concat_arrays(ids)], pa.list_(pa.int64())), pa.array([np.cumsum(np.concatenate(sizes)).tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary())], names=["block", "ids", "ends", "text"])

    for batch in slices(batches, "text", max(1, size // 4)):
        own = Texts(batch.column(1))
        ids.append(batch.column(0))
        sizes.append(np.diff(own.offsets))
        texts.append(own.bytes.tobytes())
        held += len(own.bytes)
        if held >= size:
            yield block()
            ids, sizes, texts, held, n = [], [], [], 0, n + 1
    if ids:
        yield block()


def table_of_blocks(docs: DataFrame, total: int, name: str, block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs (doc_id: long, text, with total bytes of text) as BLOCKS in the shared folder."""
    spark = docs.sparkSession
    n = min(MOST_TABLE_BUCKETS, max(1, math.ceil(total / table_bytes)))
    path = shared_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    packed = docs.mapInArrow(lambda batches: pack(batches, block_bytes), BLOCKS)
    packed.repartition(n, "block").write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, "block").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files stay
    return out


class BlockTexts(Texts):
    """The texts of a block, and its ids: an Arrow array, nulls as they are."""

    def __init__(self, table: pa.Table):
        ids, ends, text = (table.column(name)[0] for name in ("ids", "ends", "text"))
        self.ids = ids.values
        self.bytes = np.frombuffer(text.as_buffer(), dtype=np.uint8)
        self.offsets = np.append(0, np.frombuffer(ends.as_buffer(), dtype=np.int64))
        self.n = len(self.ids)


def notes_of(rows: list) -> pa.Table:
    columns = zip(*rows) if rows else ((),) * 5
    kinds = {"block": pa.int64(), "kind": pa.string(), "bucket": pa.int32(), "one": pa.binary(), "two": pa.binary()}
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns)})


def noted(notes: pa.Table, kind: str, buckets: np.ndarray):
    """(entries, one, two) of each note of a kind; entries: the slice of buckets, rising, that has the note's bucket."""
    rows = notes.filter(pa.compute.equal(notes.column("kind"), kind))
    for bucket, one, two in zip(*(rows.column(c).to_pylist() for c in ("bucket", "one", "two"))):
        yield slice(*np.searchsorted(buckets, np.array([bucket, bucket + 1], dtype=buckets.dtype)).tolist()), one, two


def per_block(table: pa.Table, sizes):
    """(block, start, end) of each row of table, whose entries stand one after another."""
    ends = np.cumsum(np.asarray(list(sizes), dtype=np.int64))
    return zip(table.column("block").to_pylist(), np.append(0, ends[:-1]).tolist(), ends.tolist())
