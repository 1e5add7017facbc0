"""A text index as tables: posting blocks by term, the documents by number, and the corpus' figures in the log.

Documents that are added at once are a part. Each task inverts its documents run by run and writes its blocks sorted by
term, so that nothing is shuffled and a search skips the pages of other terms in each file. A document that is added again, or deleted, leaves a tombstone in the parts that had it; the numbers of
documents and tokens that still count are kept with each part. Folding makes one part of all from their blocks alone.

A search reads the blocks of its terms, by zones of document numbers: a zone's blocks meet in one task, which finds
phrases and scores there. It reads no text, and no length of a document that lacks its terms.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import tokens
from postmill.operators.blocks import FIELDS, NAMES, ZONE_BITS, Entries, Zone, bytes_of, coded, decoded
from postmill.operators.search import Query, filtered, filters, paged, phrases
from postmill.operators.snapshots import Log
from postmill.session import shared_dir

#: Tokens that a task inverts at once, and bytes of a zone's blocks that one task renumbers.
TOKENS, SLICE_BYTES = 2_000_000, 8 << 20
#: Pages beyond this rank are taken from the full ranking, and so many more rows than a page tell whether ties end there.
MOST_TOP, MORE = 10_000, 1000


def _cut(counts: np.ndarray, limit: int) -> Iterable[tuple[int, int]]:
    part = (np.cumsum(counts) - counts) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(counts)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def inverted(numbered: DataFrame, columns: list[str], key: str, limit: int = TOKENS) -> DataFrame:
    """The posting blocks of numbered (doc: its number, key, and a list of tokens for each of columns), each run of documents by itself, and a row (doc, key, length) of each document.

    Both come from one pass, so that their numbers agree even where the documents would come in another order next time.
    """
    kind = numbered.schema[key].dataType.simpleString()
    fields = f"kind string, {FIELDS}, doc long, `{key}` {kind}, length long"

    def run(batches):
        plain = Entries.inverted(np.zeros(0, np.int64), [pa.array([], pa.list_(pa.string()))]).blocks().schema
        own = pa.schema([("doc", pa.int64()), (key, pa.null()), ("length", pa.int64())])

        def rows(kind: str, found: pa.RecordBatch, id_type: pa.DataType) -> pa.RecordBatch:
            types = pa.schema([*plain, *own.set(1, pa.field(key, id_type))])
            columns = [found[f.name] if f.name in found.schema.names else pa.nulls(len(found), f.type) for f in types]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.string()), *columns], names=["kind", *types.names])

        for batch in batches:
            lists = [batch[c] for c in columns]
            n = sum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(c), 0)).astype(np.int64) for c in lists)
            yield rows("documents", pa.RecordBatch.from_arrays([batch["doc"], batch[key], pa.array(n, pa.int64())], names=own.names), batch[key].type)
            for a, b in _cut(n, limit):
                yield rows("blocks", Entries.inverted(np.asarray(batch["doc"].slice(a, b - a)).astype(np.int64), [c.slice(a, b - a) for c in lists]).blocks(), batch[key].type)

    return numbered.select("doc", key, *columns).mapInArrow(run, fields)


class TextIndex:
    """The index under path of the columns of documents that key names.

    With a log and a name its state is a table of that log; added(), deleted() and folded() then give the next state,
    to be committed with those of other tables.
    """

    #: Parts beyond which adding folds them into one.
    MOST_PARTS = 16

    def __init__(self, spark: SparkSession, path: str, columns: list[str], key: str = "doc_id", key_type: str = "long", log: Log | None = None, name: str = "text"):
        self.spark, self.path, self.columns, self.key, self.key_type = spark, path.rstrip("/"), columns, key, key_type
        self.log, self.name = log or Log(spark, f"{self.path}/log"), name

    # State: a list of parts with the folder of their blocks and documents, the documents and tokens that count in
    # them, and the folder of their tombstones.

    def state(self) -> list[dict]:
        return self.log.current()[1].get(self.name, [])

    def version(self) -> int:
        return self.log.version()

    def _parts(self, state: list[dict] | None) -> list[dict]:
        state = self.state() if state is None else state
        if not state:
            raise ValueError(f"{self.path} has no index")
        return state

    def _table(self, parts: list[dict], table: str, schema: str) -> DataFrame | None:
        out = None
        for p in parts:
            if folder := p[table]:
                own = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").withColumn("part", F.lit(p["part"]))
                out = own if out is None else out.unionByName(own)
        return out

    def _documents(self, parts: list[dict]) -> DataFrame:
        """(doc, key, length, part) of all documents that were added."""
        return self._table(parts, "documents", f"doc long, `{self.key}` {self.key_type}, length long")

    def _gone(self, parts: list[dict]) -> DataFrame | None:
        """(zone, docs, part): the numbers of documents that no longer count, by zone."""
        return self._table(parts, "gone", "zone long, docs binary")

    def live(self, state: list[dict] | None = None) -> DataFrame:
        """(part, doc, key, length) of the documents that count."""
        parts = self._parts(state)
        own, gone = self._documents(parts), self._gone(parts)
        return own if gone is None else own.join(_exploded(gone), ["part", "doc"], "left_anti")

    # Building.

    def _counted(self, part: int, blocks: str, documents: str) -> dict:
        n, length = self.spark.read.schema("length long").parquet(f"{self.path}/{documents}").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"part": part, "blocks": blocks, "documents": documents, "gone": None, "n": n, "tokens": length}

    def _inverted(self, docs: DataFrame, part: int) -> dict:
        """A part of docs: blocks and documents are written at once by the tasks that read docs."""
        names = [f"c{i}" for i in range(len(self.columns))]
        numbered = docs.select(F.col(self.key), *(tokens(c).alias(n) for c, n in zip(self.columns, names))).withColumn("doc", F.monotonically_increasing_id())
        own = f"blocks-{uuid.uuid4().hex}"
        inverted(numbered, names, self.key).sortWithinPartitions("kind", "term", "first").write.partitionBy("kind").parquet(f"{self.path}/{own}")
        folders = [f"{own}/kind={kind}" for kind in ("blocks", "documents")]
        for folder in folders:  # one without rows was not written
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)
        return self._counted(part, *folders)

    def added(self, docs: DataFrame, state: list[dict] | None = None) -> list[dict]:
        """The next state with docs; of a key that is there already the new document counts."""
        state = self.state() if state is None else state
        new = self._inverted(docs, max((p["part"] for p in state), default=0) + 1)
        out = [*self.deleted(self._documents([new]), state), new] if state else [new]
        return self.folded(out) if len(out) > self.MOST_PARTS else out

    def deleted(self, keys: DataFrame, state: list[dict] | None = None) -> list[dict]:
        """The next state without the documents of keys; keys that it lacks are no error."""
        parts = self._parts(state)
        found = self.live(parts).join(keys.select(self.key).distinct(), self.key, "left_semi")
        lost = {r.part: r for r in found.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()}
        if not lost:
            return parts
        gone, before, out = found.select("part", "doc"), self._gone(parts), []
        every = gone if before is None else gone.unionByName(_exploded(before))
        for p in parts:
            if p["part"] in lost:
                folder = f"gone-{uuid.uuid4().hex}"
                _by_zone(every.where(F.col("part") == p["part"])).write.parquet(f"{self.path}/{folder}")
                p = {**p, "gone": folder, "n": p["n"] - lost[p["part"]].n, "tokens": p["tokens"] - lost[p["part"]].tokens}
            out.append(p)
        return out

    def folded(self, state: list[dict] | None = None) -> list[dict]:
        """The next state with all parts as one, without what tombstones name. Documents are numbered anew, texts aren't read."""
        parts = self._parts(state)
        offset, offsets = 0, {}
        for p in sorted(parts, key=lambda p: p["part"]):
            offsets[p["part"]] = offset
            offset += p["n"]
        # The place of each document among those of its part that count: documents are counted by zone first.
        numbered = self.live(parts).withColumn("zone", F.shiftright("doc", ZONE_BITS))
        zones = numbered.groupBy("part", "zone").agg(F.array_sort(F.collect_list("doc")).alias("kept"), F.count("*").alias("n"))
        rows = sorted((r.part, r.zone, r.n) for r in zones.select("part", "zone", "n").collect())
        begin, at = {}, {}
        for part, zone, n in rows:
            begin[part, zone] = offsets[part] + at.get(part, 0)
            at[part] = at.get(part, 0) + n
        starts = self.spark.createDataFrame([(*k, v) for k, v in begin.items()], "part int, zone long, begin long")
        # A zone's terms are dealt to slices, so that no task decodes a whole zone.
        n_slices = max(1, math.ceil(sum(self._size(p["blocks"]) for p in parts) / max(1, len(rows)) / SLICE_BYTES))
        placed = zones.join(starts, ["part", "zone"]).select("part", "zone", "kept", "begin")
        blocks = self._table(parts, "blocks", FIELDS).withColumn("zone", F.shiftright("first", ZONE_BITS)).withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(n_slices)).cast("int"))

        def renumber(table: pa.Table, kept: pa.Table) -> pa.Table:
            if not kept.num_rows or not table.num_rows:
                return pa.Table.from_batches([Entries.inverted(np.zeros(0, np.int64), [pa.array([], pa.list_(pa.string()))]).blocks()])
            live, first = np.asarray(kept["kept"].combine_chunks().flatten()).astype(np.int64), kept["begin"][0].as_py()
            table = table.select(NAMES).sort_by([("term", "ascending"), ("first", "ascending")])
            e = Entries.of(table)
            e = e.kept(np.isin(e.doc, live))
            e.doc = first + np.searchsorted(live, e.doc)
            return pa.Table.from_batches([e.blocks()])

        every = placed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
        new = blocks.groupBy("part", "zone", "slice").cogroup(every.groupBy("part", "zone", "slice")).applyInArrow(renumber, FIELDS)
        documents = placed.select("part", "zone", "begin", F.posexplode("kept").alias("i", "doc")).select("part", "doc", (F.col("begin") + F.col("i")).alias("new")).join(self.live(parts), ["part", "doc"]).select(F.col("new").alias("doc"), self.key, "length")
        own, docs = (f"{kind}-{uuid.uuid4().hex}" for kind in ("blocks", "documents"))
        new.sortWithinPartitions("term", "first").write.parquet(f"{self.path}/{own}")
        documents.write.parquet(f"{self.path}/{docs}")
        return [self._counted(max(offsets) + 1, own, docs)]

    def _size(self, name: str) -> int:
        """The bytes of a folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def add(self, docs: DataFrame) -> int:
        base, state = self.log.current()
        return self.log.commit(base, {self.name: self.added(docs, state.get(self.name, []))})

    def delete(self, keys: DataFrame) -> int:
        base, state = self.log.current()
        return self.log.commit(base, {self.name: self.deleted(keys, state.get(self.name, []))})

    def compact(self) -> int:
        base, state = self.log.current()
        return self.log.commit(base, {self.name: self.folded(state.get(self.name, []))})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what the latest versions, so many, don't need. For times without other writers."""
        used = lambda state: {p[k].split("/")[0] for p in state.get(self.name, []) for k in ("blocks", "documents", "gone") if p[k]}
        return self.log.vacuum(keep, used, self.path, "{blocks,documents,gone,staged}-*")

    # Searching.

    def _zones(self, parts: list[dict], wanted: list[list[str]]) -> DataFrame:
        """The blocks of all terms, and a row with the tombstones (no term) of each zone, to be grouped by part and zone."""
        blocks = self._table(parts, "blocks", FIELDS).where(F.col("term").isin(sorted({w for p in wanted for w in p})))
        if all(len(p) == 1 for p in wanted):
            blocks = blocks.withColumn("places", F.lit(None).cast("binary"))
        rows = blocks.withColumn("zone", F.shiftright("first", ZONE_BITS))
        gone = self._gone(parts)
        return rows if gone is None else rows.unionByName(gone, allowMissingColumns=True)

    def _evaluated(self, parts: list[dict], wanted: list[list[str]], evaluate, schema: str) -> DataFrame:
        """evaluate(zone: Zone, part: int) over all zones, as rows."""

        def run(table: pa.Table) -> pa.Table:
            dead = pa.compute.is_null(table["term"])
            own = table.filter(dead)
            gone = np.cumsum(decoded(bytes_of(own["docs"]))) if own.num_rows else None
            return evaluate(Zone(table.filter(pa.compute.invert(dead)), wanted, gone), table["part"][0].as_py())

        return self._zones(parts, wanted).groupBy("part", "zone").applyInArrow(run, schema)

    def frequencies(self, wanted: list[list[str]], state: list[dict] | None = None) -> list[int]:
        """How many documents have each phrase: from the blocks' heads where one word and no tombstone is concerned."""
        parts = self._parts(state)
        out = [0] * len(wanted)
        whole = [p for p in parts if not p["gone"]]
        plain = [i for i, p in enumerate(wanted) if len(p) == 1]
        if whole and plain:
            heads = self._table(whole, "blocks", FIELDS).where(F.col("term").isin(sorted({wanted[i][0] for i in plain})))
            counts = {r.term: r.n for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}
            for i in plain:
                out[i] += counts.get(wanted[i][0], 0)
        for some, numbers in ((whole, [i for i in range(len(wanted)) if i not in plain]), ([p for p in parts if p["gone"]], range(len(wanted)))):
            if some and numbers:
                own, ids = [wanted[i] for i in numbers], list(numbers)

                def count(zone: Zone, part: int, ids=ids) -> pa.Table:
                    return pa.table({"phrase": pa.array(ids, pa.int32()), "n": pa.array(zone.counts(), pa.int64())})

                for r in self._evaluated(some, own, count, "phrase int, n long").groupBy("phrase").agg(F.sum("n").alias("n")).collect():
                    out[r.phrase] += r.n
        return out

    def weights(self, wanted: list[list[str]], state: list[dict] | None = None) -> tuple[list[float], float]:
        """The weight of each phrase, and the documents' mean length, by the figures that the log keeps."""
        parts = self._parts(state)
        n, length = sum(p["n"] for p in parts), sum(p["tokens"] for p in parts)
        idf = [math.log((n - df + 0.5) / (df + 0.5)) for df in self.frequencies(wanted, parts)]
        return [x if x > 0 else 1e-6 for x in idf], length / n if n else 0.0

    def hits(self, text: str, state: list[dict] | None = None, best: int | None = None) -> DataFrame:
        """(part, doc, score) of the documents with all phrases of text; with best, of each zone's best, so many, and their equals."""
        parts, wanted = self._parts(state), phrases(text)
        weights, mean = self.weights(wanted, parts)

        def score(zone: Zone, part: int) -> pa.Table:
            docs, values = zone.scores(weights, mean) if best is None else zone.best(weights, mean, best)
            return pa.table({"part": pa.array([part] * len(docs), pa.int32()), "doc": pa.array(docs, pa.int64()), "score": pa.array(values, pa.float64())})

        return self._evaluated(parts, wanted, score, "part int, doc long, score double")

    def ranked(self, text: str, state: list[dict] | None = None) -> DataFrame:
        """(key, score) of the documents that hold all phrases of text."""
        parts = self._parts(state)
        return self.hits(text, parts).join(self._documents(parts), ["part", "doc"]).select(self.key, "score")

    def top(self, text: str, k: int, state: list[dict] | None = None) -> DataFrame:
        """(key, score) of the k best and of all that are as good as the last of them. Only blocks that can hold such are read to the end."""
        parts = self._parts(state)
        hits = self.hits(text, parts, k)
        rows = hits.orderBy("score").limit(k + MORE).collect()
        if len(rows) == k + MORE and rows[-1].score <= rows[k - 1].score:
            return hits.where(F.col("score") <= rows[k - 1].score).join(self._documents(parts), ["part", "doc"]).select(self.key, "score")
        rows = [r for r in rows[:k + MORE] if len(rows) <= k or r.score <= rows[k - 1].score]
        out = self.spark.createDataFrame(rows, "part int, doc long, score double")
        some = self._documents(parts).where(F.col("doc").isin([r.doc for r in rows]))
        return some.join(F.broadcast(out), ["part", "doc"]).select(self.key, "score")

    def matches(self, docs: DataFrame, query: Query) -> DataFrame:
        """The rows of docs that the query finds, as search.matches() has them, without a look at their texts."""
        if not query.text.split():
            return filtered(docs, query)
        if not phrases(query.text):
            return docs.where(F.lit(False)).withColumn("score", F.lit(0.0))
        return filtered(docs, query).join(self.ranked(query.text), self.key)

    def page(self, docs: DataFrame, query: Query) -> DataFrame:
        """One page of matches(), in order; a ranked page without filters reads only the blocks that can reach it."""
        wanted, upto = phrases(query.text), query.offset + query.limit
        if not wanted or filters(query) or query.sort == "date" or query.limit <= 0 or upto > MOST_TOP:
            return paged(self.matches(docs, query), query, self.key)
        return paged(docs.join(self.top(query.text, upto), self.key), query, self.key)

    def total(self, docs: DataFrame, query: Query) -> DataFrame:
        """The number of all matches as one row (total); docs that the index lacks, or has though docs don't, are the caller's error."""
        plain = phrases(query.text) and not filters(query)
        return (self.hits(query.text) if plain else self.matches(docs, query)).agg(F.count("*").alias("total"))


def _exploded(gone: DataFrame) -> DataFrame:
    """(part, doc) of tombstones."""

    def run(batches):
        for batch in batches:
            for part, docs in zip(batch["part"].to_pylist(), batch["docs"].to_pylist()):
                own = np.cumsum(decoded(np.frombuffer(docs, np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64())], names=["part", "doc"])

    return gone.select("part", "docs").mapInArrow(run, "part int, doc long")


def _by_zone(gone: DataFrame) -> DataFrame:
    """(zone, docs) of (doc): the numbers of each zone, in order and coded."""

    def run(table: pa.Table) -> pa.Table:
        docs = np.sort(np.asarray(table["doc"]).astype(np.int64))
        return pa.table({"zone": pa.array([int(docs[0]) >> ZONE_BITS], pa.int64()), "docs": pa.array([coded(np.diff(docs, prepend=0))[0].tobytes()], pa.binary())})

    return gone.select("doc", F.shiftright("doc", ZONE_BITS).alias("zone")).groupBy("zone").applyInArrow(run, "zone long, docs binary")


def index_of(docs: DataFrame, columns: list[str], key: str = "doc_id") -> TextIndex:
    """An index of docs in the shared folder, made when first asked for and found again while the files are the same."""
    spark = docs.sparkSession
    jvm, files = spark._jvm, []
    for f in sorted(docs.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        files.append((f, s.getLen(), s.getModificationTime()))
    name = hashlib.md5(repr((files, columns, key, docs.schema.simpleString())).encode()).hexdigest()
    out = TextIndex(spark, f"{shared_dir(spark)}/text-index-{name}", columns, key, dict(docs.dtypes)[key])
    if not out.version():
        out.add(docs)
    return out
