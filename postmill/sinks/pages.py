"""Pages that list an archive: one for each folder, and one for the root."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.messages import display_subject, listing_sender
from postmill.functions.text import html_escape, path_escape
from postmill.operators.listing import MOST_ROWS, folder_pages, folder_totals
from postmill.sinks.files import ZIP, writer

PAGE = "index.html"


def _page(title, rows, note):
    body = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1>"), note)
    return F.concat(body, F.lit("<table>"), F.array_join(rows, "\n"), F.lit("</table></body></html>"))


def folder_page_texts(docs: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(path, html) of each folder's page over docs (path, subject, sender_name, sender_email, date, has_attach).

    A page has at most that many rows, the newest, and says how many it leaves out; paths of rows are relative to it.
    """
    link = lambda name, text: F.concat(F.lit("<a href=\""), html_escape(path_escape(name)), F.lit("\">"), text, F.lit("</a>"))
    when = F.when(F.col("date") > 0, F.date_format(F.timestamp_seconds("date"), "yyyy-MM-dd HH:mm")).otherwise(F.lit(""))
    pack = F.when(F.col("has_attach"), link(F.concat(F.regexp_replace("base", r"\.html$", ""), F.lit(ZIP)), F.lit("zip"))).otherwise(F.lit(""))
    cells = [when, html_escape(listing_sender("sender_name", "sender_email")), link(F.col("base"), html_escape(display_subject("subject"))), pack]
    row = F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))), F.lit("</tr>"))
    shown = folder_pages(docs, most).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("place", row.alias("row")))).alias("rows"))
    both = shown.join(folder_totals(docs, most), "dir")
    left = F.when(F.col("omitted") > 0, F.concat(F.lit(", "), F.col("omitted").cast("string"), F.lit(" older not listed"))).otherwise(F.lit(""))
    note = F.concat(F.lit("<p><a href=\""), F.repeat(F.lit("../"), F.col("depth")), F.lit(f"{PAGE}\">all folders</a> "), F.col("total").cast("string"), F.lit(" messages"), left, F.lit("</p>"))
    return both.select(F.concat("dir", F.lit(f"/{PAGE}")).alias("path"), _page(html_escape("dir"), F.col("rows.row"), note).alias("html"))


def root_page_text(docs: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(path, html) of the root's page: a row for each folder, in order."""
    link = F.concat(F.lit("<tr><td><a href=\""), html_escape(path_escape("dir")), F.lit(f"/{PAGE}\">"), html_escape("dir"), F.lit("</a></td><td>"), F.col("total").cast("string"), F.lit("</td></tr>"))
    rows = folder_totals(docs, most).agg(F.array_sort(F.collect_list(F.struct("dir", link.alias("row")))).alias("rows"))
    return rows.select(F.lit(PAGE).alias("path"), _page(F.lit("Archive"), F.col("rows.row"), F.lit("")).alias("html"))


def write_pages(docs: DataFrame, root: str, most: int = MOST_ROWS) -> DataFrame:
    """Writes all pages under root; returns (path, n_bytes) of each."""

    def run(batches):
        put = writer(root)
        for batch in batches:
            paths, pages = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([put(p, x.encode()) for p, x in zip(paths, pages)], pa.int64())], names=["path", "n_bytes"])

    return folder_page_texts(docs, most).unionByName(root_page_text(docs, most)).mapInArrow(run, "path string, n_bytes long")
