"""The archive's rows: what is new, upserts, deletions, reconciliation, audit and run figures. snapshots.py keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.messages import attachment_label, cid_references
from postmill.functions.text import present
from postmill.operators.snapshots import Table as Versioned  # noqa: F401 - the name that callers know

MOST_ISSUES = 10_000


def since(rows: DataFrame, cutoff, date: str = "date") -> DataFrame:
    """Rows at or after cutoff; those without a date stay."""
    return rows.where(F.col(date).isNull() | (F.col(date) >= F.lit(cutoff)))


def first_wins(rows: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_wins(rows: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unseen(rows: DataFrame, manifest: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Rows whose key the manifest lacks, of each key the first."""
    return first_wins(rows.join(manifest.select(key).distinct(), key, "left_anti"), key, order)


def seen(rows: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    return rows.join(manifest.select(key).distinct(), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, key: str = "key") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def reconciled(docs: DataFrame, listing: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """docs whose file is in listing, and those whose file is gone."""
    have = listing.select(path).distinct()
    return docs.join(have, path, "left_semi"), docs.join(have, path, "left_anti")


def issues(written: DataFrame, rendered: str = "html") -> DataFrame:
    """Empty attachments and unresolved cid: references of written messages (folder, subject, date, path, attachments)."""
    common = ["folder", F.col("date").cast("date").alias("date"), "subject"]
    parts = written.select(*common, "path", F.posexplode("attachments").alias("i", "a"))
    empty = parts.where(F.coalesce(F.octet_length("a.content"), F.lit(0)) == 0).select(F.lit("empty-attachment").alias("kind"), "folder", "date", "subject", attachment_label("a.filename", "a.content_id", "i").alias("detail"), "path")
    refs = written.select(F.lit("unresolved-inline-image").alias("kind"), *common, F.explode(cid_references(rendered)).alias("detail"), "path").select("kind", "folder", "date", "subject", "detail", "path")
    return empty.unionByName(refs)


def run_stats(rows: DataFrame, old: Column, known: Column, rendered: str = "html") -> DataFrame:
    """Counters of a run over all scanned messages: the date is judged before the key, the rest on written ones alone.

    rows have the three bodies, attachments with their content, consumed (a flag for each attachment that the page
    holds) and the rendered page.
    """
    new = ~old & ~known
    empty = lambda c: F.trim(present(c)) == ""
    bytes_of = lambda a: F.coalesce(F.octet_length(a["content"]), F.lit(0))
    used = lambda i: F.coalesce(F.get("consumed", i), F.lit(False))
    count = lambda c: F.coalesce(F.sum(F.when(new, c)), F.lit(0)).cast("long")
    parts = lambda keep: F.size(F.filter("attachments", keep))
    return rows.agg(
        F.count("*").alias("scanned"),
        F.count_if(old).alias("skipped_date"),
        F.count_if(~old & known).alias("skipped_seen"),
        F.count_if(new).alias("exported"),
        F.count_if(new & empty("html_body") & ~(empty("plain_body") & empty("rtf_body"))).alias("non_html"),
        F.count_if(new & empty("html_body") & empty("plain_body") & empty("rtf_body")).alias("no_body"),
        count(parts(lambda a, i: ~used(i) & (bytes_of(a) > 0))).alias("attachments"),
        count(parts(lambda a, i: used(i))).alias("attachments_inline"),
        count(parts(lambda a, i: ~used(i) & (bytes_of(a) == 0))).alias("attachments_empty"),
        count(F.size(cid_references(rendered))).alias("unresolved_inline"),
    )
