"""Tables whose state is one log: a commit names the parts of all tables at once, so that they change together or not.

A log entry is a small JSON file with the state of every table. Its name is its number and it appears by a rename that
fails where the name is taken: of two writers who began at one version the second gets Conflict and nothing of what it
wrote is seen. Parts are written before the entry that names them, under names that no other writer uses. What a writer
that died left behind is named by no entry; vacuum() deletes it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed first."""


class Log:
    """The versions of the tables under path; version 0 has none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> dict[int, object]:
        """The path of each version's entry."""
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log-*.json")) or []
        return {int(s.getPath().getName()[4:-5]): s.getPath() for s in found}

    def state(self, n: int) -> dict:
        """The tables' states at version n."""
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log-{n:012d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        n = max(self.entries(), default=0)
        return n, self.state(n) if n else {}

    def version(self) -> int:
        return max(self.entries(), default=0)

    def commit(self, base: int, changes: dict) -> int:
        """Makes the states in changes current, those of other tables stay as they are at base; Conflict if base isn't the latest version."""
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        state = (self.state(base) if base else {}) | changes
        made = path(f"{self.path}/.new-{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(json.dumps(state).encode())
        stream.close()
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        ways = self.spark.sparkContext._gateway.new_array(kinds, 1)
        ways[0] = kinds.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(made, path(f"{self.path}/log-{base + 1:012d}.json"), ways)
        except Py4JJavaError as e:
            fs.delete(made, False)
            raise Conflict(f"version {base + 1} of {self.path} was committed by another writer") from e
        return base + 1

    def vacuum(self, keep: int, used, folder: str, pattern: str = "v-*") -> int:
        """Deletes all versions but the latest, so many, and the folders below folder that none of these uses; returns how many folders went."""
        jvm, fs = self._fs()
        entries = self.entries()
        kept = sorted(entries, reverse=True)[: max(1, keep)]
        names = {x for n in kept for x in used(self.state(n))}
        gone = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")) or [] if s.getPath().getName() not in names]
        left = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/.new-*")) or []]
        for p in [*gone, *left, *(entries[n] for n in entries if n not in kept)]:
            fs.delete(p, True)
        return len(gone)


class Table:
    """A table of a log as parts. A part is a folder and the lists of keys that no longer count in it.

    Adding writes the new rows alone, and where they replace older ones the keys of those; reading is a union without
    a shuffle of rows. Beyond MOST_PARTS parts they are written as one.
    """

    MOST_PARTS = 16

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None, log: Log | None = None, name: str = "table"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.log, self.name = log or Log(spark, path), name

    def version(self) -> int:
        return self.log.version()

    def parts(self) -> list[dict]:
        return self.log.current()[1].get(self.name, [])

    def read(self, parts: list[dict] | None = None, *columns: str) -> DataFrame:
        """The rows of the current parts, or of those given; empty until the first commit."""
        rows = None
        for part in self.parts() if parts is None else parts:
            own = self.spark.read.schema(self.schema).parquet(f"{self.path}/{part['name']}")
            own = own.select(*columns) if columns else own
            for gone in part["gone"]:
                own = own.join(self._keys(gone), self.key, "left_anti")
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            rows = self.spark.createDataFrame([], self.schema)
            return rows.select(*columns) if columns else rows
        return rows

    def _keys(self, name: str) -> DataFrame:
        kind = self.spark.createDataFrame([], self.schema).select(self.key).schema
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    # What follows writes and returns the table's next state, which counts when it is committed.

    def replaced(self, rows: DataFrame) -> list[dict]:
        return [{"name": self._write(rows), "gone": []}]

    def removed(self, keys: DataFrame, parts: list[dict] | None = None) -> list[dict]:
        """Without the rows of keys."""
        parts = self.parts() if parts is None else parts
        if self.key is None:
            raise ValueError("only a table with a key can lose some of its rows")
        found = self.read(parts, self.key).join(keys.select(self.key).distinct(), self.key, "left_semi").distinct() if parts else None
        if found is None or found.isEmpty():
            return parts
        gone = self._write(found)
        return [{**p, "gone": [*p["gone"], gone]} for p in parts]

    def added(self, rows: DataFrame, parts: list[dict] | None = None) -> list[dict]:
        """With rows in place of those of the same key. A key that rows repeat is an error of the caller."""
        parts = self.parts() if parts is None else parts
        if self.key is None:
            raise ValueError("add() needs a table with a key")
        new = {"name": self._write(rows), "gone": []}
        old = self.removed(self.read([new], self.key), parts)
        state = [*old, new]
        if len(state) > self.MOST_PARTS or any(len(p["gone"]) > self.MOST_PARTS for p in state):
            return self.replaced(self.read(state))
        return state

    def commit(self, rows: DataFrame) -> int:
        """Writes rows as the next version and makes it current. Raises if another writer was first."""
        base = self.version()
        return self.log.commit(base, {self.name: self.replaced(rows)})

    def add(self, rows: DataFrame) -> int:
        base = self.version()
        return self.log.commit(base, {self.name: self.added(rows)})

    def remove(self, keys: DataFrame) -> int:
        base = self.version()
        return self.log.commit(base, {self.name: self.removed(keys)})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what the latest versions, so many, don't need. For times without other writers."""
        return self.log.vacuum(keep, lambda state: {x for p in state.get(self.name, []) for x in (p["name"], *p["gone"])}, self.path)
