"""Accounts of mail clients as tables: which account a store is of, and what a store is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import present

#: Fixed value: what the local store is called.
LOCAL = "On This Computer"


def base_name(path: Column | str) -> Column:
    """The last part of a path, trailing slashes aside."""
    return F.substring_index(F.rtrim(present(path), F.lit("/")), "/", -1)


def preferences(lines: DataFrame) -> DataFrame:
    """(server, field, value) of the lines (value) of a mail client's preferences that are about servers."""
    pattern = r'^\s*user_pref\("mail\.server\.(server[^.]*)\.([^"]*)",\s*(.*?)\);\s*$'
    found = lines.where(F.col("value").rlike(pattern))
    return found.select(*(F.regexp_extract("value", pattern, i).alias(n) for i, n in ((1, "server"), (2, "field"))), F.btrim(F.regexp_extract("value", pattern, 3), F.lit('"')).alias("value"))


def accounts(prefs: DataFrame) -> DataFrame:
    """One row per server of preferences(): server, hostname, type, directory, directory_rel, offline_download."""
    of = lambda field: F.coalesce(F.max(F.when(F.col("field") == field, F.col("value"))), F.lit(""))
    return prefs.groupBy("server").agg(of("hostname").alias("hostname"), of("type").alias("type"), of("directory").alias("directory"), of("directory-rel").alias("directory_rel"), (of("offline_download") == "true").alias("offline_download"))


def accounts_of(stores: DataFrame, servers: DataFrame) -> DataFrame:
    """stores (store: a path) with the columns of their account, by hostname, directory or the end of the relative one.

    Of several the first server by name counts; a store that has none has nulls. The lookups are by equal keys: a
    server has a key for its hostname, one for its directory, and one for each end of the relative directory.
    """
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("directory_rel"), F.lit(1))), lambda i: F.substring(F.col("directory_rel"), i, F.char_length("directory_rel")))
    keys = F.filter(F.concat(F.array("hostname", base_name("directory")), ends), lambda x: x != "")
    keyed = servers.select("*", F.explode(F.array_distinct(keys)).alias("__name"))
    row = F.struct(*servers.columns)
    first = keyed.groupBy("__name").agg(F.min_by(row, "server").alias("__account"))
    named = stores.withColumn("__name", base_name("store")).join(first, "__name", "left")
    return named.select(*stores.columns, "__account.*")


def store_labels(stores: DataFrame, names: DataFrame) -> DataFrame:
    """stores (store: a path, cached: boolean) with label; names (uid, display_name) are those of cached accounts."""
    own = base_name("store")
    known = names.where(F.btrim(present("display_name")) != "").groupBy("uid").agg(F.min(F.btrim("display_name")).alias("display_name"))
    joined = stores.withColumn("uid", own).join(known, "uid", "left")
    label = F.when(F.col("cached"), F.coalesce("display_name", F.concat(F.lit("Evolution "), "uid"))).when(F.col("uid") == "local", F.lit(LOCAL)).otherwise(F.col("uid"))
    return joined.withColumn("label", label).select(*stores.columns, "label")


def distinct_labels(rows: DataFrame, label: str = "label", order: str = "store") -> DataFrame:
    """rows with choice: the label, with " (n)" from the second of equal ones on."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return rows.withColumn("choice", F.when(n > 1, F.concat(label, F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(label)))


def attachment_name(long: Column | str, short: Column | str, extension: Column | str, index: Column | str) -> Column:
    """The long name, else the short one, else one by number where there is an extension, else empty."""
    numbered = F.when(present(extension) != "", F.concat(F.lit("attachment-"), F.col(index).cast("string") if isinstance(index, str) else index.cast("string"), present(extension))).otherwise(F.lit(""))
    return F.coalesce(F.nullif(present(long), F.lit("")), F.nullif(present(short), F.lit("")), numbered)
