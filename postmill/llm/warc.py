"""WARC archives with an index: written per task, read back by coalesced byte ranges.

Every record is a gzip member of its own, so a record can be read alone. Writing gives the index: archive, offset,
length, URL and digest of each record. Reading takes the selected index rows, sorts them by archive and offset and
joins neighbouring ranges into one read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import shared_path, slices, stored

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Ranges closer than GAP bytes are read together, up to READ_BYTES at once.
GAP, READ_BYTES = 64 << 10, 8 << 20
ARCHIVE_BYTES, TASK_BYTES = 512 << 20, 2 * READ_BYTES
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _clean(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record(page_id, url, payload: bytes, digest: str, refers_to, refers_url, date: str) -> bytes:
    """One WARC 1.1 record, compressed: a response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []
    head += [f"WARC-Refers-To-Target-URI: {_clean(refers_url)}"] if revisit and refers_url is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict:
    """The row of one compressed record; a response's digest and length are those of the payload that was read."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda name: int(x) if (x := fields.get(name, "")[10:-1]) else None
    response = fields["WARC-Type"] == "response"
    digest = hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].partition(":")[2]
    if response and f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of page {page('WARC-Record-ID')} differs from its digest")
    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": len(payload) if response else length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload if response else None}


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder; returns the index, one row per page.

    Null html is an empty payload. Of pages with equal payloads of LEAST_REVISIT bytes or more, those with the
    smallest page_id are responses and the others, null ids too, revisit it. Rows that repeat a page_id and payload
    share their kind, further columns are not read, and an empty table gives an empty index. A page of any length is
    one record. A task that runs again writes another
    archive; only that of the run that counts is in the index.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    slim = rows.select("page_id", "url", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= LEAST_REVISIT)
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("refers_url"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # A page finds its response by its own id and digest: however often a payload occurs, no key gathers its copies.
    again = slim.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    links = again.select(F.col("page_id").alias("own"), F.col("digest").alias("same"), "refers_to", "refers_url").distinct()
    dealt = rows.join(links, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")), "left").select("page_id", "url", "html", "digest", "refers_to", "refers_url")

    def write(batches):
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, at, name = None, 0, ""
        for batch in slices(batches, "html"):
            found = []
            for page_id, url, text, digest, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, text.encode(), digest, refers_to, refers_url, date)
                out.write(data)
                found.append((f"{folder}/{name}", at, len(data), url, digest, page_id, "response" if refers_to is None else "revisit"))
                at += len(data)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["archive", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    return stored(dealt.mapInArrow(write, INDEX), "warc-index")


def _runs(rows):
    """(archive, offset, length) rows in order, gathered into ranges to be read at once."""
    run: list = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP or row[1] + row[2] - run[0][1] > READ_BYTES):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_records(selected: DataFrame, payload: bool = True) -> DataFrame:
    """The records that selected (rows of an index) names; without payload that column is null.

    A record that is named twice is read twice; no index rows, no records.
    """

    def read(batches):
        open_files: dict = {}
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        for run in _runs(rows):
            if run[0][0] not in open_files:
                for f in open_files.values():
                    f.close()
                fs, path = pa.fs.FileSystem.from_uri(run[0][0])
                open_files = {run[0][0]: fs.open_input_file(path)}
            start = run[0][1]
            data = open_files[run[0][0]].read_at(run[-1][1] + run[-1][2] - start, start)
            found = [parse(data[at - start : at - start + n]) for _, at, n in run]
            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] if payload or k != "payload" else None for r in found], t) for k, t in kinds.items()})

    # Index rows are too small to tell Spark how much is read: the number of tasks follows from the bytes they name.
    n = max(1, math.ceil((selected.agg(F.sum("length")).first()[0] or 0) / TASK_BYTES))
    chunk = (F.col("offset") / READ_BYTES).cast("long")
    return selected.select("archive", "offset", "length").repartition(n, "archive", chunk).sortWithinPartitions("archive", "offset").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, then reads every record back: one row per page, without its payload."""
    return read_records(write_archives(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
