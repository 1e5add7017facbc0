"""Line dedup: lines that many documents have stay in the first of them alone.

Normalised lines are exploded once into a narrow table of hashes, documents are counted by hash, and the places of
lines over the threshold go back to their document, which is put together again from the runs between those places.
Texts are shuffled once, lines never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
#: Keys of more lines than this are hot, and so many hot keys there are at most: the limit rises with all lines.
HOT_LINES, MOST_HOT = 10_000, 200_000


def line_key(line: Column | str) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _two_hashes(*columns: Column | str) -> list[Column]:
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]


def _over(keyed: DataFrame, min_documents: int, hot_lines: int, most_hot: int) -> DataFrame:
    """keyed (row, doc_id, pos, h1, h2), those lines that another document keeps.

    A hot key's lines don't meet in one task: they are told from a broadcast table of hot keys, which has most_hot rows
    at most, since each of them has more than a most_hot-th of all lines.
    """
    limit = max(hot_lines, keyed.count() // most_hot)
    documents = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    counts = keyed.groupBy("h1", "h2").agg(documents.alias("documents"), F.min("doc_id").alias("first"), F.count("*").alias("lines"))
    held = stored(counts.where(F.col("documents") >= min_documents).select("h1", "h2", "first", "lines"), "line-keys")
    hot, cold = (held.where(c).select("h1", "h2", "first") for c in (F.col("lines") > limit, F.col("lines") <= limit))
    few = F.broadcast(hot)
    met = keyed.join(few, ["h1", "h2"]).unionByName(keyed.join(few, ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"]))
    return met.where((F.col("doc_id") > F.col("first")) | (F.col("doc_id").isNull() & F.col("first").isNotNull()))


def without_repeated_lines(df: DataFrame, min_chars: int = 10, min_documents: int = 2, hot_lines: int = HOT_LINES, most_hot: int = MOST_HOT) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_lines (before), n_dropped, text (what is left).

    Lines are parted by \\n alone. A line whose key has at least min_chars code points, in at least min_documents
    documents, stays only in the document with the smallest doc_id that has it, there as often as it stands. A null or
    empty text is one empty line. Rows of one doc_id are one document, and all null ids are one that comes last; equal
    rows lose the same lines. Further columns are not read, an empty table gives no rows, and a text may have any length.
    Keys are compared by two 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    row = F.struct(*(h.alias(f"r{i}") for i, h in enumerate(_two_hashes("doc_id", "text"))))
    lines = rows.select("doc_id", row.alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("row", "doc_id", "pos", line_key("line").alias("key")).where(F.char_length("key") >= min_chars)
    keyed = stored(keys.select("row.*", "doc_id", "pos", *_two_hashes("key")), "line-hashes")
    gone = _over(keyed, min_documents, hot_lines, most_hot).groupBy("r0", "r1").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    both = rows.select("doc_id", "text", row.alias("row")).select("doc_id", "text", "row.*").join(gone, ["r0", "r1"], "left")
    # The lines are bound once, as the element of an array; what stays are the runs that end at each dropped place.
    begin = lambda i: F.coalesce(F.get("gone", i - 1) + 1, F.lit(0))
    runs = lambda own: F.transform(F.concat("gone", F.array(F.size(own))), lambda end, i: F.slice(own, begin(i) + 1, end - begin(i)))
    left = F.transform(F.array(F.split("text", "\n")), lambda own: F.array_join(F.flatten(runs(own)), "\n"))[0]
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return both.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"))


def line_digests(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left of each document."""
    return without_repeated_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
