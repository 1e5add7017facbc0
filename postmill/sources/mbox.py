"""Mbox files as a Spark data source, in batch and as a stream: one row per message, its bytes untouched.

    spark.dataSource.register(MboxSource)
    spark.read.format("mbox").load("/data/Mail/Inbox")            # path, offset, data
    spark.readStream.format("mbox").load("/data/Mail")            # new messages of files that grow

A message begins at a line that starts with "From " and belongs to the task in whose byte range that line begins, so
that one large file is read by many tasks and none twice. Ranges end at the length that a file had when it was listed:
what is appended meanwhile waits for the next run. Files are opened with pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, data binary"
MARK = b"\nFrom "
#: Bytes of files that one task reads, and that it holds at once beyond its range while it looks for a message's end.
RANGE_BYTES, STEP_BYTES = 32 << 20, 1 << 20
#: Fixed value: files beside mailboxes that are none.
NOT_MAILBOXES = r"(?i)(^|/)\.[^/]*$|\.(msf|dat|html|sqlite|json)$"
#: Bytes by which a file's begin and what stands before an offset are known again.
PRINT_BYTES = 512


@dataclass(frozen=True)
class Range:
    """The messages of a file whose first line begins at start or after and before stop; nothing at limit or after it is read."""

    path: str
    start: int
    stop: int
    limit: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: tuple[Range, ...] = ()

    def __post_init__(self):
        super().__init__(None)


def _read(f, start: int, size: int) -> bytes:
    return f.read_at(size, start) if size > 0 else b""


def split(f, own: Range, step: int = STEP_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the messages of a range: where their first line begins, and all from that line to the next mark."""
    begin = max(0, own.start - 1)
    data = _read(f, begin, min(own.stop + len(MARK) - 1, own.limit) - begin)
    marks = [m.start() + 1 for m in re.finditer(MARK, data)]
    if begin == own.start == 0 and data.startswith(MARK[1:]):
        marks.insert(0, 0)
    mine = [m for m in marks if own.start <= begin + m < own.stop]
    if not mine:
        return
    for a, b in zip(mine, mine[1:]):
        yield begin + a, data[a:b]
    later = [m for m in marks if begin + m >= own.stop]
    last, at = begin + mine[-1], begin + len(data)
    rest = bytearray(data[mine[-1] :])
    del data
    if later:
        del rest[begin + later[0] - last :]
    while not later:
        more = _read(f, at, min(step, own.limit - at))
        if not more:
            break
        seen = max(1, len(rest) - len(MARK) + 1)
        rest += more
        at += len(more)
        if (end := rest.find(MARK, seen)) >= 0:
            del rest[end + 1 :]
            break
    yield last, bytes(rest)


def unpacked(data: bytes) -> bytes:
    """A message without its first line and the empty line that parts it from the next one, with ">From " unquoted."""
    body = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
    for end in (b"\r\n", b"\n"):
        if body == end or body.endswith(b"\n" + end):
            body = body[: -len(end)]
            break
    return re.sub(rb"(?m)^>(>*From )", rb"\1", body) if b">From " in body else body


def located(uri: str) -> tuple[pa.fs.FileSystem, str, str]:
    """The file system of a URI, the path in it, and the URI with its scheme. Names are taken as they are, not decoded."""
    scheme, _, rest = (re.sub("^(file:)?/+", "file:///", uri)).partition("://")
    host, _, path = rest.partition("/")
    fs, base = pa.fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return fs, f"{base.rstrip('/')}/{path}", f"{scheme}://{host}/{path}"


def opened(path: str):
    fs, at, _ = located(path)
    return fs.open_input_file(at)


def batches(partition: Ranges, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], names=names)
    rows, held = [], 0
    for own in partition.ranges:
        with opened(own.path) as f:
            for offset, data in split(f, own):
                rows.append((own.path, offset, unpacked(data)))
                held += len(data)
                if held >= size:
                    yield made(rows)
                    rows, held = [], 0
    if rows:
        yield made(rows)


def dealt(ranges: list[Range], size: int) -> list[Ranges]:
    """Ranges cut to size bytes each; small ones share a task."""
    out, own, held = [], [], 0
    for r in ranges:
        for a in range(r.start, r.stop, size):
            piece = Range(r.path, a, min(a + size, r.stop), r.limit)
            if own and held + piece.stop - a > size:
                out.append(Ranges(tuple(own)))
                own, held = [], 0
            own.append(piece)
            held += piece.stop - a
    return [*out, Ranges(tuple(own))] if own else out


def files_of(path: str) -> list[tuple[str, int, int]]:
    """(uri, length, time of the last change in ns) of the mbox files at or under path, those beside mailboxes left out."""
    fs, at, uri = located(path.rstrip("/"))
    top = fs.get_file_info(at)
    if top.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.is_file else fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    out = []
    for f in sorted((f for f in found if f.is_file and f.size), key=lambda f: f.path):
        if top.is_file or not re.search(NOT_MAILBOXES, f.path[len(at) :]):
            with fs.open_input_stream(f.path) as s:
                if s.read(5) == MARK[1:]:
                    out.append((uri + f.path[len(at) :], f.size, f.mtime_ns or 0))
    return out


class MboxSource(DataSource):
    """Options: path (a file, or a folder whose mbox files are read); files, a JSON list of (uri, length) in its place; rangeBytes; pathPrefix; fromOffset."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MboxReader:
        return MboxReader(self.options)

    def streamReader(self, schema) -> MboxStreamReader:
        return MboxStreamReader(self.options)


class MboxReader(DataSourceReader):
    """Options pathPrefix and fromOffset leave out files, and the ranges before an offset.

    Filters are not pushed down: Spark 4.1 keeps those of one query for all others over the same DataFrame, which
    would lose rows.
    """

    def __init__(self, options: Mapping[str, str]):
        self.options = options

    def partitions(self) -> list[Ranges]:
        files = json.loads(self.options["files"]) if "files" in self.options else [f[:2] for f in files_of(self.options["path"])]
        least, prefix = int(self.options.get("fromOffset", 0)), self.options.get("pathPrefix", "")
        return dealt([Range(p, least, n, n) for p, n in files if n > least and p.startswith(prefix)], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from batches(partition)


def continued(path: str, length: int) -> bool:
    """Whether a message begins where a file of that length ended."""
    with opened(path) as f:
        return _read(f, length - 1, len(MARK)) == MARK


def fingerprint(path: str, length: int) -> str:
    """A digest of a file's begin and of what stands before length."""
    with opened(path) as f:
        return hashlib.sha1(_read(f, 0, min(PRINT_BYTES, length)) + _read(f, max(0, length - PRINT_BYTES), min(PRINT_BYTES, length))).hexdigest()


class MboxStreamReader(DataSourceStreamReader):
    """Offsets are the files' lengths, times and fingerprints.

    A file that grew and still has what it had gives its new messages; one that is new, shorter or otherwise changed
    (written anew in its old length, or longer by more of its last message) is read from its begin. A file that is gone
    gives nothing.
    """

    def __init__(self, options: Mapping[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: {"length": n, "time": t, "print": fingerprint(path, n)} for path, n, t in files_of(self.options["path"])}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        ranges = []
        for path, now in sorted(end.items()):
            was = start.get(path)
            if was == now:
                continue
            grown = was and was["length"] < now["length"] and continued(path, was["length"]) and fingerprint(path, was["length"]) == was["print"]
            ranges.append(Range(path, was["length"] if grown else 0, now["length"], now["length"]))
        return dealt(ranges, int(self.options.get("rangeBytes", RANGE_BYTES)))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from batches(partition)
