"""Incremental ingest: a stream of files against the manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.operators.archive import Versioned, unseen
from postmill.session import shared_dir


def ingest(arrivals: DataFrame, manifest: Versioned, checkpoint: str, key: str = "key", order: str = "seq") -> StreamingQuery:
    """Takes what has arrived so far: rows whose key the manifest lacks are added to it, of each key the first.

    The manifest decides what is new, not the stream's own state, so a batch that runs again adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        known = manifest.read()
        new = unseen(batch, known, key, order).select(*known.columns)
        manifest.add(new)

    return arrivals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(rows: DataFrame, chunks: int, key: str = "key", order: str = "seq") -> DataFrame:
    """The manifest after rows arrived as a stream in so many parts, in order; rows without an order come first."""
    spark = rows.sparkSession
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    manifest = Versioned(spark, f"{home}/manifest", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), key)
    bounds = rows.stat.approxQuantile(order, [i / chunks for i in range(1, chunks)], 0.001)
    part = sum((F.coalesce((F.col(order) > b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))
    for k in range(chunks):
        rows.where(part == k).write.mode("append").parquet(f"{home}/in")
        arrivals = spark.readStream.schema(rows.schema).parquet(f"{home}/in")
        ingest(arrivals, manifest, f"{home}/checkpoint", key, order).awaitTermination()
    return manifest.read().select(key, *(c for c in rows.columns if c not in (key, order)))
