"""The archive job: scan, filter, drop what is known, derive, write, and commit manifest and index at once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.functions import html as H
from postmill.functions import messages as M
from postmill.functions.text import normalize_ws, present, snippet
from postmill.model import DOCS, ISSUE, MANIFEST
from postmill.operators import archive
from postmill.operators.listing import with_directory
from postmill.operators.postings import TextIndex
from postmill.operators.search import Query, shown
from postmill.operators.snapshots import Log
from postmill.sinks.files import write_messages, write_report
from postmill.sinks.pages import PAGE, write_pages
from postmill.sources.mailbox import discover, listing, read_mailbox, scan_order, stream_mailboxes

COUNTERS = ["scanned", "skipped_date", "exported", "skipped_seen", "zips", "issues", "non_html", "no_body", "attachments", "attachments_inline", "attachments_empty", "unresolved_inline"]
COLUMNS = ["subject", "sender", "recipients", "folder", "attach_names", "body"]


@dataclass(frozen=True)
class ArchiveOptions:
    """inputs: mailboxes; output: the archive's folder; full: write known messages again."""

    inputs: list[str] = field(default_factory=list)
    output: str = ""
    since: datetime | None = None
    full: bool = False
    key_scope: str = "folder"


def keyed(messages: DataFrame, scope: str = "folder") -> DataFrame:
    """messages with folder, date, key and seq, the order in which a walk of their store meets them."""
    rows = messages.withColumn("folder", F.array_join("folder_path", "/")).withColumn("date", M.effective_date())
    return rows.withColumn("key", M.message_key("folder", M.message_identity(), "store" if scope == "store" else None)).withColumn("seq", scan_order("file"))


def rendered(rows: DataFrame) -> DataFrame:
    """rows with path, html (images embedded) and consumed."""
    body, is_html = M.first_body("html_body", "plain_body", "rtf_body"), F.trim(present("html_body")) != ""
    date = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss 'UTC'")
    out = rows.withColumn("path", M.export_path("store", "folder_path", M.file_stem("date", "subject", "key"))).withColumn("__e", H.embed_images(body, "attachments"))
    page = H.render_document(M.display_subject("subject"), M.header_sender("sender_name", "sender_email"), present("to"), present("cc"), present(date), F.col("__e.html"), is_html)
    return out.withColumn("html", page).withColumn("consumed", F.col("__e.consumed")).drop("__e")


def documents(rows: DataFrame) -> DataFrame:
    """The index rows of messages with path."""
    body = M.index_body("plain_body", F.when(F.trim(present("plain_body")) == "", H.html_to_text_plain("html_body")), "rtf_body")
    docs = rows.select(
        "key", "store", "folder", "sender_name", "sender_email", M.joined("to", "cc").alias("recipients"), "subject",
        F.coalesce(F.unix_timestamp("date"), F.lit(0)).alias("date"), "path", (F.size("attachments") > 0).alias("has_attach"),
        M.attachment_names("attachments").alias("attach_names"),
        M.sender("sender_name", "sender_email").alias("sender"), normalize_ws(body).alias("body"),
    )
    return docs.withColumn("snippet", snippet("body")).select(*(c.split()[0] for c in DOCS.split(", ")))


class State:
    """The archive's tables, of which one log knows the current versions: seen (the manifest), docs and text (their index)."""

    def __init__(self, spark: SparkSession, output: str):
        self.home = f"{output.rstrip('/')}/.state"
        self.log = Log(spark, f"{self.home}/log")
        self.seen = archive.Versioned(spark, f"{self.home}/seen", MANIFEST, "key", self.log, "seen")
        self.docs = archive.Versioned(spark, f"{self.home}/docs", DOCS, "key", self.log, "docs")
        self.text = TextIndex(spark, f"{self.home}/text", COLUMNS, "key", "string", self.log, "text")

    def commit(self, base: int, **changes) -> int:
        return self.log.commit(base, changes)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what the latest versions, so many, don't need. For times without other writers."""
        return sum(t.vacuum(keep) for t in (self.seen, self.docs, self.text))


def run(spark: SparkSession, options: ArchiveOptions) -> dict:
    """One run; returns its counters, and errors, a line for each source that failed.

    Without full only messages whose key is new are written, of each key the first. With full every occurrence is
    written, and the index keeps the last of each key. A source is committed when it is done, its manifest, documents
    and text index at once, so a run that breaks off goes on where it was, and one source that fails doesn't stop the
    others.
    """
    if not options.output:
        raise ValueError("no output folder was given")
    figures: dict = dict.fromkeys(COUNTERS, 0) | {"failed": 0, "errors": []}
    state = State(spark, options.output)
    found = f"{state.home}/issues-{uuid.uuid4().hex}"
    for path in discover(spark, options.inputs):
        try:
            for name, n in _run_source(spark, options, state, path, found).items():
                figures[name] += n
        except Exception as e:  # noqa: BLE001 - whatever is wrong with a source, the others are still read
            figures["failed"] += 1
            figures["errors"].append(f"{path}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
    if figures["exported"]:
        write_report(spark.read.schema(ISSUE).parquet(found), f"{state.home}/report")
        _pages(spark, state, options.output)
    return figures


def _pages(spark: SparkSession, state: State, output: str) -> None:
    write_pages(state.docs.read(), output).write.format("noop").mode("overwrite").save()


def _run_source(spark: SparkSession, options: ArchiveOptions, state: State, path: str, found: str) -> dict:
    return _take(spark, options, state, read_mailbox(spark, path), found)


def _take(spark: SparkSession, options: ArchiveOptions, state: State, messages: DataFrame, found: str) -> dict:
    """Writes what of messages is to be written, with its issues under found, and commits it; returns the counters."""
    base = state.log.version()
    scanned, made = (f"{state.home}/{name}-{uuid.uuid4().hex}" for name in ("scan", "written"))
    try:
        keyed(messages, options.key_scope).write.parquet(scanned)
        rows = spark.read.parquet(scanned)
        in_time = archive.since(rows, options.since) if options.since else rows
        total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("date") < F.lit(options.since) if options.since else F.lit(False)).alias("old")).first()
        rendered(in_time if options.full else archive.unseen(in_time, state.seen.read(None, "key"))).write.parquet(made)
        written = spark.read.parquet(made)
        # Occurrences that share a path are one file, the last of them.
        files = write_messages(archive.last_wins(written, "path") if options.full else written, options.output).agg(F.count("*").alias("n"), F.count_if(F.col("zip_bytes") > 0).alias("zips")).first()
        archive.issues(written).write.mode("append").parquet(found)
        no = F.lit(False)
        counted = archive.run_stats(written, no, no).drop("scanned", "skipped_date", "skipped_seen").first().asDict()
        if files.n:
            last = archive.last_wins(written)
            docs = documents(last)
            seen = last.select("key", "path", "folder", F.current_timestamp().alias("exported_at"))
            state.commit(base, text=state.text.added(docs), docs=state.docs.added(docs), seen=state.seen.added(seen))
    finally:
        _remove(spark, scanned, made)
    return {"scanned": total.n, "skipped_date": total.old, "skipped_seen": total.n - total.old - counted["exported"], "zips": files.zips, "issues": counted["attachments_empty"] + counted["unresolved_inline"], **counted}


def _remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def watch(spark: SparkSession, options: ArchiveOptions, checkpoint: str, **trigger) -> StreamingQuery:
    """Streams the messages of options.inputs, one tree of mboxes, into the archive, as run() would write them.

    Each batch is one commit. The manifest decides what is new, so a batch that runs again writes nothing twice. The
    trigger is availableNow unless another is given.
    """
    if len(options.inputs) != 1:
        raise ValueError("a stream has one tree of mailboxes as its input")

    def add(batch: DataFrame, _: int) -> None:
        state = State(spark, options.output)
        found = f"{state.home}/issues-{uuid.uuid4().hex}"
        if _take(spark, options, state, batch, found)["exported"]:
            write_report(spark.read.schema(ISSUE).parquet(found), f"{state.home}/report")
            _pages(spark, state, options.output)

    arrivals = stream_mailboxes(spark, options.inputs[0])
    return arrivals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def find(spark: SparkSession, output: str, query: Query) -> DataFrame:
    """The archive's messages that query finds, by the index that its runs kept."""
    state = State(spark, output)
    return state.text.matches(state.docs.read(), query)


def find_page(spark: SparkSession, output: str, query: Query) -> tuple[DataFrame, DataFrame]:
    """A page of what query finds with a highlighted snippet, and the number of all matches as one row (total)."""
    state = State(spark, output)
    docs = state.docs.read()
    return shown(state.text.page(docs, query), query), state.text.total(docs, query)


def reconcile(spark: SparkSession, output: str) -> dict:
    """Drops from manifest, documents and text index what has no file any more, and writes the pages anew."""
    state = State(spark, output)
    base = state.log.version()
    if not base:
        raise ValueError(f"{output} has no index")
    files = listing(spark, output).select(F.col("rel").alias("path"))
    kept, gone = archive.reconciled(state.docs.read(None, "key", "path"), files)
    figures = {"kept": kept.count(), "pruned": gone.count()}
    if figures["pruned"]:
        keys, folders = gone.select("key"), [with_directory(rows).select("dir").distinct() for rows in (gone, kept)]
        empty = [r.dir for r in folders[0].exceptAll(folders[1]).collect()]
        state.commit(base, text=state.text.deleted(keys), docs=state.docs.removed(keys), seen=state.seen.removed(keys))
        _remove(spark, *(f"{output.rstrip('/')}/{x}/{PAGE}" for x in empty))
    _pages(spark, state, output)
    return figures
