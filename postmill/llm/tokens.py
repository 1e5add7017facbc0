"""Token counts from flat token files that have no index.

A file holds the tokens of its documents one after another, each document ended by one identifier. Blocks of all
files are scanned on their own with vectorised searches for that identifier; a prefix scan over a file's blocks
then stitches the documents that cross block boundaries and numbers them.
"""

from __future__ import annotations

import base64
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import shared_path, slices, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer cuts text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES, FILE_BYTES, TASK_BYTES = 4 << 20, 512 << 20, 16 << 20


def write_token_files(df: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame, int, str]:
    """Tokenizes df (doc_id, text) into flat files in the shared folder.

    Returns the files (path, n_bytes), the order of documents (path, ordinal, doc_id), the identifier that ends a
    document and the tokens' NumPy type. A null text has no tokens. A task that runs again writes another file; only
    that of the run that counts is listed.
    """
    spark = df.sparkSession
    folder = shared_path(spark, "tokens")
    lines = "\n".join(r[0] for r in spark.read.text(f"file://{vocabulary}" if vocabulary.startswith("/") else vocabulary).collect())
    end = len(lines.split("\n"))
    dtype = "<u2" if end < 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(lines)

    def write(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in sent.value.split("\n") if line)}
        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, n, at = None, "", 0, 0
        row = lambda path, ordinals, ids, sizes: pa.RecordBatch.from_arrays([pa.array([path] * len(ordinals), pa.string()), pa.array(ordinals, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "ordinal", "doc_id", "n_bytes"])
        for batch in slices(batches, "text"):
            if out is None or at >= FILE_BYTES:
                if out is not None:
                    out.close()
                    yield row(f"{folder}/{name}", [None], [None], [at])
                name, n, at = f"part-{uuid.uuid4().hex}.bin", 0, 0
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            for text in batch.column(1).to_pylist():
                ids = encoding.encode_ordinary(text or "")
                ids.append(end)
                at += out.write(np.array(ids, dtype=dtype).tobytes())
            yield row(f"{folder}/{name}", range(n, n + batch.num_rows), batch.column(0), [None] * batch.num_rows)
            n += batch.num_rows
        if out is not None:
            out.close()
            yield row(f"{folder}/{name}", [None], [None], [at])

    listed = stored(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "path string, ordinal long, doc_id long, n_bytes long"), "token-files")
    return listed.where("n_bytes is not null").select("path", "n_bytes"), listed.where("ordinal is not null").select("path", "ordinal", "doc_id"), end, dtype


def count_tokens(files: DataFrame, end: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens) of every document in files (path, n_bytes), the ending identifier not counted.

    Tokens after the last identifier of a file are one more document, if there are any. Empty files have no rows.
    """
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width
    blocks = files.where("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(block_bytes).cast("long"))).alias("start"), "n_bytes")

    def scan(batches):
        for batch in batches:
            for path, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    own = np.frombuffer(f.read_at(min(block_bytes, size - start), start), dtype=dtype)
                ends = np.flatnonzero(own == end)
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [path],
                        "start": pa.array([start], pa.int64()),
                        "ends": pa.array([len(ends)], pa.int64()),
                        "head": pa.array([int(ends[0]) if len(ends) else None], pa.int64()),
                        "inner": pa.array([np.diff(ends) - 1 if len(ends) else []], pa.list_(pa.int64())),
                        "tail": pa.array([len(own) - 1 - int(ends[-1]) if len(ends) else len(own)], pa.int64()),
                    }
                )

    # Rows that name blocks are too small to tell Spark how much is read.
    n = max(1, math.ceil((files.agg(F.sum("n_bytes")).first()[0] or 0) / TASK_BYTES))
    found = blocks.repartition(n, "path", "start").mapInArrow(scan, "path string, start long, ends long, head long, inner array<long>, tail long")
    by_start = Window.partitionBy("path").orderBy("start")
    earlier = by_start.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    found = found.withColumn("cut", F.coalesce(F.sum((F.col("ends") > 0).cast("int")).over(earlier), F.lit(0))).withColumn("left", F.coalesce(F.lag("tail").over(by_start), F.lit(0)))
    same = Window.partitionBy("path", "cut").orderBy("start")
    carry = F.first("left").over(same) + F.coalesce(F.sum("tail").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.col("start").desc())) == 1
    found = found.withColumn("carry", carry).withColumn("last", last)
    open_end = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    counts = F.concat(F.when(F.col("ends") > 0, F.array(F.col("head") + F.col("carry"))).otherwise(F.array().cast("array<long>")), "inner", F.when(F.col("last") & (open_end > 0), F.array(open_end)).otherwise(F.array().cast("array<long>")))
    return found.select("path", "before", F.posexplode(counts).alias("k", "n_tokens")).select("path", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens")


def document_tokens(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row of df (doc_id, text), counted in the flat files that are written for it.

    A null or empty text has 0 tokens, a null doc_id stays null, rows that repeat have a row each, further columns are
    not read and an empty table gives no rows. A document may be longer than a block or a file.
    """
    files, order, end, dtype = write_token_files(df, vocabulary)
    # Paths compress so well that Spark takes either side for small; neither is broadcast.
    return order.hint("merge").join(count_tokens(files, end, dtype), ["path", "ordinal"]).select("doc_id", "n_tokens")
