"""Mailboxes as Spark reads: mbox files and trees, maildir, Maildir++ and IMAP disk caches.

Mboxes are read by the data source in mbox.py, in byte ranges, a maildir is a tree of binary files. Messages stay bytes
until the MIME parser, which alone knows their charsets. Folder paths come from file paths by column expressions.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import sanitize_segment
from postmill.model import MESSAGE
from postmill.operators.accounts import LOCAL
from postmill.sources import mime
from postmill.sources.mbox import NOT_MAILBOXES, MboxSource, located


class UnsupportedMailbox(ValueError):
    """The path holds no mailbox that can be read here."""


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system and path of path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _root(spark: SparkSession, path: str) -> str:
    """path with its scheme, absolute and without . and .. in it."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(p.toUri().normalize())).toString().rstrip("/")


def _is_mbox(spark: SparkSession, path: str) -> bool:
    """Whether a file begins like an mbox; five bytes of it are read."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return all(stream.read() == b for b in b"From ")
    finally:
        stream.close()


def _relative(c: Column, root: str) -> Column:
    """The part of a file's URI below root."""
    return F.substring(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), len(root) + 2, 1 << 20)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, rel, length) of all files under path; contents are not read."""
    root = _root(spark, path)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), _relative(F.col("path"), root).alias("rel"), "length")


def _children(spark: SparkSession, path: str) -> dict[str, bool]:
    """The names right below path, True for folders. Spark's readers pass over names that begin with a dot."""
    fs, p = _fs(spark, path)
    return {s.getPath().getName(): s.isDirectory() for s in fs.listStatus(p)}


def _mbox_files(spark: SparkSession, root: str, below: str = "") -> list[str]:
    """The mbox files of a tree, as paths below root: those in it and in its .sbd folders."""
    out = []
    for name, is_dir in sorted(_children(spark, f"{root}/{below}" if below else root).items()):
        rel = f"{below}/{name}" if below else name
        if is_dir:
            out += _mbox_files(spark, root, rel) if name.endswith(".sbd") else []
        elif not re.search(NOT_MAILBOXES, rel) and _is_mbox(spark, f"{root}/{rel}"):
            out.append(rel)
    return out


def _maildirs(spark: SparkSession, root: str, below: str = "") -> list[str]:
    """The folders with messages of a tree of mboxes: cur and new, right in it, in its folders and in .sbd folders."""
    out = []
    for name, is_dir in sorted(_children(spark, f"{root}/{below}" if below else root).items()):
        rel = f"{below}/{name}" if below else name
        if is_dir and name.endswith(".sbd"):
            out += _maildirs(spark, root, rel)
        elif is_dir and not name.startswith("."):
            out += [f"{rel}/{x}" for x, d in _children(spark, f"{root}/{rel}").items() if d and x in ("cur", "new")]
    return out


def _plus_plus_folders(spark: SparkSession, path: str) -> list[str]:
    """The cur and new folders of a Maildir++ store: its own and those of its dot folders."""
    own = [f"{path}/{x}" for x, is_dir in _children(spark, path).items() if is_dir and x in ("cur", "new")]
    dots = [x for x, is_dir in _children(spark, path).items() if is_dir and x.startswith(".")]
    return own + [f"{path}/{d}/{x}" for d in dots for x, is_dir in _children(spark, f"{path}/{d}").items() if is_dir and x in ("cur", "new")]


def detect(spark: SparkSession, path: str) -> str:
    """mbox, mbox-tree, maildir, maildir++ or imap-cache; UnsupportedMailbox for Outlook stores and anything else."""
    if path.lower().endswith((".pst", ".ost")):
        raise UnsupportedMailbox(f"{path}: Outlook stores need a reader that is not part of this library")
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isFile():
        if _is_mbox(spark, path):
            return "mbox"
        raise UnsupportedMailbox(f"{path}: neither a mailbox nor a folder of mailboxes")
    names = _children(spark, path)
    maildir = any(names.get(x) for x in ("cur", "new"))
    if names.get("..maildir++") is False or (maildir and len(_plus_plus_folders(spark, path)) > sum(bool(names.get(x)) for x in ("cur", "new"))):
        return "maildir++"
    if maildir:
        return "maildir"
    if names.get("folders") and listing(spark, path).where(F.col("rel").rlike("^folders/.*(/|^)(cur|new)/")).take(1):
        return "imap-cache"
    if _mbox_files(spark, path) or _maildirs(spark, path):
        return "mbox-tree"
    raise UnsupportedMailbox(f"{path}: neither a mailbox nor a folder of mailboxes")


def is_mailbox(spark: SparkSession, path: str) -> bool:
    """Whether detect() knows what path is."""
    try:
        return bool(detect(spark, path))
    except UnsupportedMailbox:
        return False


def discover(spark: SparkSession, paths: list[str]) -> list[str]:
    """The mailboxes of paths, each once by its absolute path: a folder that is none stands for those right below it.

    UnsupportedMailbox for a path that has neither.
    """
    out: dict[str, None] = {}
    for path in paths:
        fs, p = _fs(spark, path)
        found = [path]
        if not is_mailbox(spark, path):
            found = [f"{path}/{x}" for x in sorted(_children(spark, path)) if not x.startswith(".") and is_mailbox(spark, f"{path}/{x}")] if fs.getFileStatus(p).isDirectory() else []
        if not found:
            raise UnsupportedMailbox(f"{path}: no mailbox there")
        out.update(dict.fromkeys(_root(spark, x) for x in found))
    return list(out)


def _maildir_name(c: Column) -> Column:
    """.A.B_2EC to [A, B.C]."""
    parts = F.filter(F.split(F.ltrim(c, F.lit(".")), r"\."), lambda x: x != "")
    plain = lambda x: F.try_url_decode(F.regexp_replace(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B")), "_([0-9A-Fa-f]{2})", "%$1"))
    return F.transform(parts, lambda x: sanitize_segment(F.coalesce(plain(x), x)))


def folder_path(rel: Column, layout: str) -> Column:
    """The folder of a file by its path below the store."""
    parts = F.split(rel, "/")
    none = F.array().cast("array<string>")
    if layout == "mbox":
        return none
    if layout == "mbox-tree":
        in_maildir = F.slice(parts, 1, F.greatest(F.coalesce(F.nullif(F.array_position(parts, "cur"), F.lit(0)), F.array_position(parts, "new")) - 1, F.lit(0)).cast("int"))
        of = F.when(rel.rlike("(^|/)(cur|new)/"), in_maildir).otherwise(parts)
        return F.transform(of, lambda x: sanitize_segment(F.regexp_replace(x, r"\.sbd$", "")))
    if layout == "maildir":
        return none
    if layout == "maildir++":
        return F.when(rel.rlike("^(cur|new)/"), none).otherwise(_maildir_name(parts[0]))
    inner = F.split(F.regexp_extract(rel, r"^folders/(.*?)/(cur|new)/", 1), "/")
    return F.transform(F.filter(inner, lambda x: x != "subfolders"), sanitize_segment)


_PART = pa.struct([("filename", pa.string()), ("mime_type", pa.string()), ("content_id", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
_TYPES = {"folder_path": pa.list_(pa.string()), "offset": pa.int64(), "sent": pa.timestamp("us", "UTC"), "received": pa.timestamp("us", "UTC"), "attachments": pa.list_(_PART)}
_ARROW = pa.schema([(name, _TYPES.get(name, pa.string())) for name in ("store", "folder_path", *mime.FIELDS, "file", "offset")])


def _parsed(raw: DataFrame) -> DataFrame:
    """raw (store, folder_path, data, file, offset) as messages."""

    def run(batches):
        for batch in batches:
            store, folder, data, file, offset = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pylist([{"store": s, "folder_path": f, **mime.parse(d), "file": p, "offset": o} for s, f, d, p, o in zip(store, folder, data, file, offset)], _ARROW)

    return raw.mapInArrow(run, MESSAGE)


def scan_order(file: Column | str, offset: Column | str = "offset") -> Column:
    """A column that sorts a store's messages as a walk meets them.

    Names go by their bytes, a folder's own messages before its subfolders, new before cur, an mbox from its begin on.
    """
    file = F.col(file) if isinstance(file, str) else file
    parts = F.split(file, "/")
    turn = F.transform(parts, lambda x, i: F.when((x == "new") & (i < F.size(parts) - 1), F.array(F.lit(""), F.lit("0"))).when((x == "cur") & (i < F.size(parts) - 1), F.array(F.lit(""), F.lit("1"))).otherwise(F.array(F.regexp_replace(x, r"\.sbd$", ""))))
    return F.struct(F.filter(F.flatten(turn), lambda x: x != "subfolders").alias("turn"), file.alias("file"), F.col(offset).alias("offset") if isinstance(offset, str) else offset.alias("offset"))


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("mbox") known to the session."""
    spark.dataSource.register(MboxSource)


def _boxed(rows: DataFrame, base: str, layout: str, store: str) -> DataFrame:
    """Rows of the mbox source as _parsed() takes them, for files below base."""
    rel = F.substring("path", len(base) + 2, 1 << 20)
    return rows.select(F.lit(store).alias("store"), folder_path(rel, layout).alias("folder_path"), "data", rel.alias("file"), "offset")


def store_label(spark: SparkSession, path: str, layout: str, sources: str | None = None) -> str:
    """What a store is called: its folder or file, but for a mail client's own stores.

    A cache is called by its account: the DisplayName in <uid>.source under sources, else "Evolution <uid>".
    """
    name = _root(spark, path).rpartition("/")[2]
    if layout == "mbox":
        return name.rsplit(".", 1)[0] if "." in name.lstrip(".") else name
    if layout == "maildir++" and name == "local":
        return LOCAL
    if layout != "imap-cache":
        return name
    file = f"{sources.rstrip('/')}/{name}.source" if sources else ""
    if file and (found := _fs(spark, file))[0].exists(found[1]):
        lines = spark.read.text(file).select(F.btrim(F.regexp_extract("value", "^DisplayName=(.*)", 1)).alias("v")).where("v != ''").take(1)
        if lines:
            return lines[0].v
    return f"Evolution {name}"


def stream_mailboxes(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """A stream of the messages of a tree of mboxes: those of files that grow or are new, all of one that is written anew.

    Folders are those that read_mailbox() knows: the tree itself and its .sbd folders.
    """
    root = located(_root(spark, path))[2].rstrip("/")
    register(spark)
    range_bytes = range_bytes or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    rows = spark.readStream.format("mbox").option("rangeBytes", range_bytes).load(root)
    own = _boxed(rows, root, "mbox-tree", root.rpartition("/")[2])
    return _parsed(own.where(F.col("file").rlike(r"^([^/]*\.sbd/)*[^/]+$")))


def read_mailbox(spark: SparkSession, path: str, layout: str | None = None, store: str | None = None, range_bytes: int | None = None, sources: str | None = None) -> DataFrame:
    """The messages of one store. An mbox is split at its messages, so that one large file is read by many tasks.

    Of a tree the mboxes and maildirs in it and in its .sbd folders are read, and no others; of each mbox what it held
    when it was listed. range_bytes: what one task reads of mboxes, as much as of other files unless given. sources: the
    folder with the mail client's accounts, by which caches are called.
    """
    layout = layout or detect(spark, path)
    root = _root(spark, path)
    name = root.rpartition("/")[2]
    store = store or store_label(spark, path, layout, sources)
    rel = F.col("rel")
    boxes = []
    if layout in ("mbox", "mbox-tree"):
        base = root.rpartition("/")[0] if layout == "mbox" else root
        files = [(f"{base}/{x}", fs.getFileStatus(p).getLen()) for x in ([name] if layout == "mbox" else _mbox_files(spark, root)) for fs, p in [_fs(spark, f"{base}/{x}")]]
        register(spark)
        range_bytes = range_bytes or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        rows = spark.read.format("mbox").option("files", json.dumps(files)).option("rangeBytes", range_bytes).load()
        boxes.append(_boxed(rows, base, layout, store))
    if layout not in ("mbox", "mbox-tree") or (layout == "mbox-tree" and _maildirs(spark, root)):
        folders = _plus_plus_folders(spark, path) if layout == "maildir++" else [f"{path}/{x}" for x in _maildirs(spark, root)] if layout == "mbox-tree" else [path]
        files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", "true").load(folders).withColumn("rel", _relative(F.col("path"), root))
        mail = files.where(rel.rlike("(^|/)(cur|new)/"))
        boxes.append(mail.select(F.lit(store).alias("store"), folder_path(rel, layout).alias("folder_path"), F.col("content").alias("data"), rel.alias("file"), F.lit(0).cast("long").alias("offset")))
    raw = boxes[0]
    for b in boxes[1:]:
        raw = raw.unionByName(b)
    return _parsed(raw)


def read_mailboxes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The messages of several stores; a store that is given twice, by whatever path, is read once."""
    out = None
    for path in discover(spark, paths):
        own = read_mailbox(spark, path)
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], MESSAGE) if out is None else out
