"""When a store that is being written has gone quiet."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postmill.session import shared_dir

#: The state store that keeps timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of stores that have their state together; a checkpoint holds for one number of them.
BUCKETS = 1024


def active_runs(rows: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, first, last, n) of runs of rows that are less than gap apart; works on streams with a watermark too."""
    return rows.groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("session_window")


def stable(polls: DataFrame, store: str = "store", ts: str = "ts", size: str = "size", seconds: int = 30) -> DataFrame:
    """polls with is_stable: the size hasn't changed for so many seconds."""
    w = Window.partitionBy(store).orderBy(ts)
    before = F.lag(size).over(w)
    changed = polls.withColumn("__c", F.when(before.isNull() | (before != F.col(size)), F.col(ts)))
    last = F.max("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return changed.withColumn("is_stable", F.unix_timestamp(ts) - F.unix_timestamp(last) >= seconds).drop("__c")


class Quiet(StatefulProcessor):
    """The sizes of a bucket's stores and when they last changed, with a timer for the first time at which one will have been quiet.

    A call costs as much for a bucket as for a store, so stores share calls and one value of state.
    """

    def __init__(self, seconds: int, forget: int):
        self.wait, self.forget = seconds * 1000, forget * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # changed and seen are milliseconds; told: its quiet was reported; due: when its timer fires.
        self.state = handle.getValueState("stores", "store array<string>, size array<long>, changed array<long>, seen array<long>, told array<boolean>, due array<long>")

    def _stores(self) -> dict[str | None, tuple]:
        store, *rest = self.state.get() or ((), (), (), (), (), ())
        return dict(zip(store, zip(*rest)))

    def _keep(self, stores: dict[str | None, tuple]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not stores:
            self.state.clear()
            return
        self.state.update((list(stores), *map(list, zip(*stores.values()))))
        self.handle.registerTimer(min(due for *_, due in stores.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values(["ts", "unknown", "size"], kind="stable")
        stores, out = self._stores(), []
        for store, at, n, unknown in zip(polls["store"].tolist(), (polls["ts"].astype("int64") // 1_000_000).tolist(), polls["size"].tolist(), polls["unknown"].tolist()):
            n = None if unknown else n
            size, changed, seen, told, _ = stores.get(store) or (None, None, None, False, None)
            same = n is not None and size == n
            # A change after a longer gap without polls ends a quiet time, too.
            if size is not None and not told and at - changed >= self.wait + (not same):
                told = True
                out.append((store, changed, size))
            if not same:
                size, changed, told = n, at, False
            seen = max(at, seen or at)
            stores[store] = size, changed, seen, told, seen + self.forget if told else changed + self.wait
        self._keep(stores)
        if out:
            yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, stores, out = timerValues.getCurrentWatermarkInMs(), {}, []
        for store, (size, changed, seen, told, due) in self._stores().items():
            if due > now:
                stores[store] = size, changed, seen, told, due
            elif not told:
                out.append((store, changed, size))
                stores[store] = size, changed, seen, True, max(seen + self.forget, due + 1)
        self._keep(stores)
        if out:
            yield _rows(out)

    def close(self) -> None:
        pass


def _rows(found: list[tuple]) -> pd.DataFrame:
    stores, changed, sizes = zip(*found)
    return pd.DataFrame({"store": stores, "since": pd.to_datetime(pd.Series(changed), unit="ms"), "size": sizes})


def replay(polls: DataFrame, chunks: int, seconds: int) -> DataFrame:
    """settled() after polls (store, ts, size) arrived as a stream in so many parts, by time."""
    spark, home = polls.sparkSession, f"{shared_dir(polls.sparkSession)}/polls-{uuid.uuid4().hex}"
    bounds = polls.select(F.unix_millis("ts").alias("t")).stat.approxQuantile("t", [i / chunks for i in range(1, chunks)], 0.001)
    part = sum(((F.unix_millis("ts") > b).cast("int") for b in bounds), F.lit(0))
    # Each task of each batch starts Python anew, so that two for a core are enough; a stream takes the number as it starts.
    name = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(name)
    for k in range(chunks):
        polls.where(part == k).write.mode("append").parquet(f"{home}/in")
        arrivals = spark.readStream.schema(polls.schema).parquet(f"{home}/in")
        spark.conf.set(name, str(min(int(usual), 2 * spark.sparkContext.defaultParallelism)))
        try:
            query = settled(arrivals, seconds).writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/out")
        finally:
            spark.conf.set(name, usual)
        query.awaitTermination()
    return spark.read.schema("store string, since timestamp, size long").parquet(f"{home}/out")


def settled(polls: DataFrame, seconds: int = 30, forget: int = 86_400, late: timedelta = timedelta(0)) -> DataFrame:
    """(store, since, size) of each time that a store has been quiet for so many seconds, from a stream of polls (store, ts, size).

    since is when the size last changed. Event time decides: a poll, of whatever store, that is so much later lets the
    timer of a quiet one fire, also when nobody polls that one any more. A store without polls for forget seconds after
    its quiet loses its state. Polls that are later than late are dropped. Stores are dealt to buckets by their hash;
    what a store costs is then its polls, not its calls of the state store.
    """
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own = polls.select(F.col("store").cast("string").alias("store"), F.col("ts").cast("timestamp").alias("ts"), F.col("size").cast("long").alias("size"))
    # Null sizes stand apart: pandas would make all sizes of a batch with one floats.
    own = own.withColumn("unknown", F.col("size").isNull()).fillna(0, ["size"])
    timed = own.withWatermark("ts", f"{int(late.total_seconds() * 1000)} milliseconds")
    return timed.withColumn("bucket", F.pmod(F.xxhash64("store"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(statefulProcessor=Quiet(seconds, forget), outputStructType="store string, since timestamp, size long", outputMode="append", timeMode="eventTime")
