"""Messages as mbox files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.sources.mbox import located

#: Fixed value: the first line of a message that has no sender and date of its own.
FIRST_LINE = b"From MAILER-DAEMON Thu Jan  1 00:00:00 1970\n"


def quoted(message: bytes) -> bytes:
    """A message as it stands in an mbox: lines that look like a first line, quoted or not, get one more ">"."""
    body = re.sub(rb"(?m)^(>*From )", rb">\1", message)
    return FIRST_LINE + body + (b"\n" if body.endswith(b"\n") else b"\n\n")


def raw_message(headers: dict[str, Column], body: Column, charset: str = "UTF-8", base64: Column | None = None) -> Column:
    """The bytes of a message of one text part, which is sent as 8-bit or, where base64 holds, as base64.

    Header values are ASCII. A body ends its last line.
    """
    lines = [F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\n")) for name, value in headers.items()]
    coded = F.encode(F.concat(body, F.lit("\n")), charset)
    way = F.coalesce(base64, F.lit(False)) if base64 is not None else F.lit(False)
    head = F.concat(*lines, F.lit(f'MIME-Version: 1.0\nContent-Type: text/plain; charset="{charset}"\nContent-Transfer-Encoding: '), F.when(way, "base64").otherwise("8bit"), F.lit("\n\n"))
    return F.concat(head.cast("binary"), F.when(way, F.concat(F.base64(coded), F.lit("\n")).cast("binary")).otherwise(coded))


def write_mboxes(messages: DataFrame, root: str) -> DataFrame:
    """Writes messages (data: their bytes) under root, a file for each task; returns (path, n_messages, n_bytes).

    A file appears under its name when it is whole, and a task that runs again puts the same file in its place.
    """

    def run(batches):
        task = TaskContext.get()
        name = f"box-{task.partitionId():05d}"
        fs, base, uri = located(root.rstrip("/"))
        fs.create_dir(base, recursive=True)
        part, n, size = f"{base}/.{name}-{task.taskAttemptId()}", 0, 0
        with fs.open_output_stream(part, compression=None) as f:
            for batch in batches:
                for data in batch.column(0):
                    own = quoted(data.as_py() or b"")
                    f.write(own)
                    n, size = n + 1, size + len(own)
        if n:
            fs.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_messages", "n_bytes"])
        else:
            fs.delete_file(part)

    return messages.select(F.col("data")).mapInArrow(run, "path string, n_messages long, n_bytes long")
