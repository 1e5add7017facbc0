"""Listings of the archive's folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.messages import unique_names

MOST_ROWS = 5000


def with_directory(docs: DataFrame, path: str = "path") -> DataFrame:
    """docs with dir and base, the parts of path around its last slash."""
    return docs.withColumn("dir", F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).withColumn("base", F.substring_index(path, "/", -1))


def folder_pages(docs: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The newest rows of each directory, by path from the end, with their place.

    A directory with more than most rows is cut in two steps, so that none is sorted whole in one task.
    """
    listed = with_directory(docs)
    deal = Window.partitionBy("dir", F.pmod(F.xxhash64("path"), F.lit(32))).orderBy(F.col("path").desc())
    some = listed.withColumn("__n", F.row_number().over(deal)).where(F.col("__n") <= most).drop("__n")
    w = Window.partitionBy("dir").orderBy(F.col("path").desc())
    return some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def folder_totals(docs: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """total, shown and omitted rows of each directory, and its depth."""
    totals = with_directory(docs).groupBy("dir").agg(F.count("*").alias("total"))
    return totals.select("dir", "total", F.least("total", F.lit(most)).alias("shown"), F.greatest(F.col("total") - most, F.lit(0)).alias("omitted"), F.size(F.split("dir", "/")).alias("depth"))


def duplicate_names(parts: DataFrame, message: str, name: str, index: str) -> DataFrame:
    """parts with entry: the name, or where the message's parts before it have taken that, "base (n).ext" with the least free n."""
    row = F.struct(F.col(index).alias("at"), F.col(name).alias("name"), F.struct(*(F.col(f"`{c}`") for c in parts.columns)).alias("row"))
    own = parts.groupBy(F.col(message).alias("__message")).agg(F.array_sort(F.collect_list(row)).alias("parts"))
    named = own.select("parts", unique_names(F.col("parts.name")).alias("entries"))
    return named.select(F.explode(F.arrays_zip("parts", "entries")).alias("x")).select("x.parts.row.*", F.col("x.entries").alias("entry"))


def store_totals(docs: DataFrame) -> DataFrame:
    """folders and total of each store, the first part of a path."""
    return folder_totals(docs).groupBy(F.substring_index("dir", "/", 1).alias("store")).agg(F.count("*").alias("folders"), F.sum("total").alias("total")).orderBy("store")


def store_sizes(files: DataFrame) -> DataFrame:
    """files and size of each store of files (store, size)."""
    return files.groupBy("store").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def narrowed(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The rows that show text in any of columns, or across them, whatever its case."""
    shown = F.concat_ws("", *(F.col(c).cast("string") for c in columns))
    return rows.where(F.contains(F.lower(shown), F.lower(F.lit(text))))


def by_column(rows: DataFrame, column: str, ascending: bool = True, locale: str = "UNICODE") -> DataFrame:
    """rows in the order of a column's text under a locale's collation, case and marks after letters."""
    key = F.collate(F.col(column).cast("string"), locale)
    return rows.orderBy(key.asc() if ascending else key.desc())


def pager(total: int, offset: int, limit: int) -> dict:
    """Where the pages before and after begin, None where there is none."""
    return {"previous": max(0, offset - limit) if offset > 0 else None, "next": offset + limit if offset + limit < total else None}
