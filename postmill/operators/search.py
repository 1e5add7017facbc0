"""Ranked phrase search, filters, facets and paging over a table of documents.

A query's text is split at white space; each field is a phrase of adjacent tokens within one column, and a document
must hold every phrase. Rank is BM25 with corpus-wide statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import parse_date
from postmill.functions.html import highlight
from postmill.functions.text import _marked, ascii_like, token_text

K1, B = 1.2, 0.75
DEFAULT_LIMIT, MOST_LIMIT = 50, 200


@dataclass(frozen=True)
class Query:
    """text: phrases; folder: subtree; sender: part of name or address; dates in UTC, before is exclusive."""

    text: str = ""
    folder: str = ""
    sender: str = ""
    after: datetime | None = None
    before: datetime | None = None
    has_attach: bool = False
    sort: str = "relevance"
    limit: int = DEFAULT_LIMIT
    offset: int = 0


def parse_query(q: str = "", *, folder: str = "", sender: str = "", sort: str = "relevance", after: str = "", before: str = "", attach: bool = False, year: int | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> Query:
    """A Query from text with from:, folder:, after:, before: and has:attach tokens.

    after, before and attach override tokens and year overrides all dates; a token overrides folder and sender. A
    token with no valid date is dropped. limit is held to 1 to MOST_LIMIT.
    """
    own = Query(folder=folder, sender=sender, sort=sort)
    words = []
    for field in q.split():
        name, _, value = field.partition(":")
        match name.lower(), value:
            case "from", _ if ":" in field:
                own = replace(own, sender=value)
            case "folder", _ if ":" in field:
                own = replace(own, folder=value)
            case ("after" | "before") as side, _ if ":" in field:
                own = replace(own, **({side: d} if (d := parse_date(value)) else {}))
            case "has", _ if value.lower() in ("attach", "attachment"):
                own = replace(own, has_attach=True)
            case _:
                words.append(field)
    dates = {k: d for k, v in (("after", after), ("before", before)) if (d := parse_date(v))}
    if year is not None:
        dates = {"after": datetime(year, 1, 1, tzinfo=timezone.utc), "before": datetime(year + 1, 1, 1, tzinfo=timezone.utc)}
    limit = DEFAULT_LIMIT if limit <= 0 else min(limit, MOST_LIMIT)
    return replace(own, text=" ".join(words), has_attach=own.has_attach or attach, limit=limit, offset=max(0, offset), **dates)


def phrases(text: str) -> list[list[str]]:
    """The tokens of each field of text; fields of punctuation alone are left out."""
    src, dst = _marked()
    table = {ord(c): dst[i] if i < len(dst) else None for i, c in enumerate(src)}
    found = [regex.findall(r"[\p{L}\p{N}\p{Co}]+", field.lower().translate(table)) for field in text.split()]
    return [p for p in found if p]


def filters(query: Query) -> list[Column]:
    """The structured filters as conditions on documents. Unknown dates are 0."""
    out = []
    if folder := query.folder.strip():
        out.append((F.col("folder") == folder) | ascii_like("folder", folder + "/%"))
    if sender := query.sender.strip():
        out.append(ascii_like("sender_name", f"%{sender}%") | ascii_like("sender_email", f"%{sender}%"))
    if query.after:
        out.append(F.col("date") >= int(query.after.timestamp()))
    if query.before:
        out.append(F.col("date") < int(query.before.timestamp()))
    if query.has_attach:
        out.append(F.col("has_attach"))
    return out


def filtered(docs: DataFrame, query: Query) -> DataFrame:
    for condition in filters(query):
        docs = docs.where(condition)
    return docs


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in token_text(); occurrences may overlap."""
    rest = " ".join(phrase[1:])
    return F.regexp_count(words, F.lit(f"(?<= ){phrase[0]}(?= {rest} )" if rest else f"(?<= ){phrase[0]}(?= )"))


def with_counts(docs: DataFrame, columns: list[str], wanted: list[list[str]]) -> DataFrame:
    """docs with length (tokens of all columns) and tf0, tf1, ... (how often each phrase occurs, columns added up)."""
    texts = docs.withColumns({f"__{c}": token_text(c) for c in columns})
    length = sum((F.regexp_count(f"__{c}", F.lit("(?<= )[^ ]+")) for c in columns), F.lit(0))
    counts = {f"tf{i}": sum((phrase_count(F.col(f"__{c}"), p) for c in columns), F.lit(0)) for i, p in enumerate(wanted)}
    return texts.withColumns({"length": length, **counts}).drop(*(f"__{c}" for c in columns))


def scored(docs: DataFrame, columns: list[str], wanted: list[list[str]]) -> DataFrame:
    """The documents that hold all phrases, with score: the lower the better. One pass for statistics, one to score."""
    counted = with_counts(docs, columns, wanted)
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted)))).first()
    score, hit = F.lit(0.0), F.lit(True)
    for i in range(len(wanted)):
        idf = math.log((stats.n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}").cast("double")
        score = score + F.lit(idf if idf > 0 else 1e-6) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(stats.mean or 1.0)))
        hit = hit & (F.col(f"tf{i}") > 0)
    return counted.where(hit).withColumn("score", -score).drop("length", *(f"tf{i}" for i in range(len(wanted))))


def matches(docs: DataFrame, query: Query, columns: list[str]) -> DataFrame:
    """All documents that the query finds, with score where it has text. Text of punctuation alone finds none."""
    if not query.text.split():
        return filtered(docs, query)
    wanted = phrases(query.text)
    if not wanted:
        return docs.where(F.lit(False)).withColumn("score", F.lit(0.0))
    return filtered(scored(docs, columns, wanted), query)


def paged(found: DataFrame, query: Query, key: str = "doc_id") -> DataFrame:
    """One page, best or newest first; equal ranks by key."""
    by_score = "score" in found.columns and query.sort != "date"
    order = [F.col("score").asc(), F.col(key)] if by_score else [F.col("date").desc(), F.col(key)]
    return found.orderBy(*order).offset(query.offset).limit(query.limit if query.limit > 0 else DEFAULT_LIMIT)


def search(docs: DataFrame, query: Query, columns: list[str], key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A page of results with a highlighted snippet, and the number of all matches as one row (total)."""
    found = matches(docs, query, columns)
    return shown(paged(found, query, key), query), found.agg(F.count("*").alias("total"))


def shown(page: DataFrame, query: Query) -> DataFrame:
    """A page as a reader sees it: for a query with text the snippet is what of the body has its phrases."""
    if query.text.split():
        page = page.withColumn("snippet", highlight("body", phrases(query.text)))
    return page.drop("body", "sender", "score")


def folder_facet(docs: DataFrame) -> DataFrame:
    return docs.groupBy("folder").agg(F.count("*").alias("count")).orderBy("folder")


def years(docs: DataFrame) -> DataFrame:
    """Years that have documents, latest first; dates of 0 and before don't count."""
    return docs.where("date > 0").select(F.year(F.timestamp_seconds("date")).alias("year")).distinct().orderBy(F.desc("year"))
