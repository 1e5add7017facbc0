"""Files that an archive leaves: pages, zips of attachments, and the audit report."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import sanitize_filename, tsv_clean


#: Fixed value: how the zip of a page's attachments is named.
ZIP = "-attachments.zip"


def entry_names(names: list[str]) -> list[str]:
    """Names of zip entries, each once: base (n).ext for those that are taken."""
    taken: set[str] = set()
    out = []
    for name in names:
        base, dot, ext = name.rpartition(".")
        base, tail = (base, dot + ext) if base else (name, "")
        n, own = 0, name
        while own in taken:
            n += 1
            own = f"{base} ({n}){tail}"
        taken.add(own)
        out.append(own)
    return out


def zipped(parts: list[dict], consumed: list[bool]) -> bytes | None:
    """A zip of the parts that aren't consumed or empty; None if there are none."""
    own = [p for p, used in zip(parts, consumed) if not used and p["content"]]
    if not own:
        return None
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in zip(entry_names([p["entry"] for p in own]), own):
            z.writestr(zipfile.ZipInfo(name), part["content"])
    return buffer.getvalue()


def writer(root: str):
    """put(path, data) writes a file under root and returns its size."""
    fs, base = pa.fs.FileSystem.from_uri(root)
    made: set[str] = set()

    def put(path: str, data: bytes) -> int:
        full = f"{base}/{path}"
        if (folder := full.rpartition("/")[0]) not in made:
            fs.create_dir(folder, recursive=True)
            made.add(folder)
        with fs.open_output_stream(full, compression=None) as f:
            f.write(data)
        return len(data)

    return put


def write_messages(written: DataFrame, root: str) -> DataFrame:
    """Writes written (path, html, attachments, consumed) under root; returns (path, n_bytes, zip_bytes) of each.

    A file is written whole under its final name, so a task that runs again writes the same bytes again.
    """
    labelled = F.transform("attachments", lambda a, i: F.struct(sanitize_filename(a["filename"], i).alias("entry"), a["content"].alias("content")))
    rows = written.select("path", "html", labelled.alias("parts"), "consumed")

    def run(batches):
        put = writer(root)
        for batch in batches:
            out = []
            for path, page, parts, consumed in zip(*(c.to_pylist() for c in batch.columns)):
                archive = zipped(parts or [], consumed or [False] * len(parts or []))
                out.append((path, put(path, page.encode()), put(path.removesuffix(".html") + ZIP, archive) if archive else 0))
            kinds = [pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["path", "n_bytes", "zip_bytes"])

    return rows.mapInArrow(run, "path string, n_bytes long, zip_bytes long")


def write_report(issues: DataFrame, path: str, most: int = 10_000) -> None:
    """The first issues as tab-separated text."""
    clean = issues.orderBy("folder", "path", "kind", "detail").limit(most)
    clean.select(*(tsv_clean(F.col(c).cast("string")).alias(c) for c in issues.columns)).write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").csv(path)
