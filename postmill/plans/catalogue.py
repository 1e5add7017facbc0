"""Queries of the catalogue, by name, with DuckDB SQL for the same rows.

The tables are read as mail: documents are messages whose folder is source/lang and whose body is the text; orders
with their customer are dated messages with line items as attachments; events are the stream of arrivals; pages are
HTML bodies; conversations are threads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import html as H
from postmill.functions import messages as M
from postmill.functions import text as T
from postmill.operators import accounts, archive, listing, postings, search
from postmill.operators.search import Query
from postmill.session import shared_dir
from postmill.sinks import mboxes, pages
from postmill.sources import mailbox
from postmill.streaming import incremental, quiescence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _utc(year: int, month: int = 1, day: int = 1) -> datetime:
    return datetime(year, month, day, tzinfo=timezone.utc)


def doc_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang").alias("folder"), F.col("text").alias("body"), F.col("source").alias("sender_name"), F.concat(F.col("source"), F.lit("@"), F.col("lang")).alias("sender_email"), F.lit(0).cast("long").alias("date"), F.lit(False).alias("has_attach"))


DOC_MAIL = "docs AS (SELECT doc_id, source || '/' || lang AS folder, text AS body, source AS sender_name, source || '@' || lang AS sender_email FROM documents)"


def doc_matches(spark: SparkSession, sf_dir: str, query: Query) -> DataFrame:
    """What query finds in doc_mail, by an index of folder and body that is kept beside the tables' other derived files."""
    docs = doc_mail(spark, sf_dir)
    return postings.index_of(docs, ["folder", "body"]).matches(docs, query)


def order_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("folder"),
        F.col("c_name").alias("sender_name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("sender_email"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("date"),
        (F.col("o_orderkey") % 3 == 0).alias("has_attach"),
    )


ORDER_MAIL = """mail AS (SELECT o_orderkey AS doc_id, o_orderpriority || '/' || o_orderstatus AS folder, c_name AS sender_name,
  lower(replace(c_name, '#', '.')) || '@example.com' AS sender_email, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS date, o_orderkey % 3 = 0 AS has_attach
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bm25_sql(wanted: list[list[str]], tail: str) -> str:
    """BM25 over folder and body in SQL; tail reads from hits (doc_id, folder, sender_name, sender_email, score)."""
    tok = lambda c: f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"
    count = lambda a, p: f"len(list_filter(range(1, greatest(len({a}) - {len(p) - 1}, 1) + 1), lambda i: {a}[i:i + {len(p) - 1}] = {p!r}))"
    tf = ", ".join(f"{count('t1', p)} + {count('t2', p)} AS tf{i}" for i, p in enumerate(wanted))
    idf = ", ".join(f"CASE WHEN ln((count(*) - count(*) FILTER (tf{i} > 0) + 0.5) / (count(*) FILTER (tf{i} > 0) + 0.5)) > 0 THEN ln((count(*) - count(*) FILTER (tf{i} > 0) + 0.5) / (count(*) FILTER (tf{i} > 0) + 0.5)) ELSE 1e-6 END AS idf{i}" for i in range(len(wanted)))
    score = " + ".join(f"idf{i} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(wanted)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(wanted)))
    return f"""WITH {DOC_MAIL}, toks AS (SELECT *, {tok("folder")} AS t1, {tok("body")} AS t2 FROM docs),
counts AS (SELECT doc_id, folder, sender_name, sender_email, len(t1) + len(t2) AS len, {tf} FROM toks),
stats AS (SELECT avg(len) AS mean, {idf} FROM counts),
hits AS (SELECT doc_id, folder, sender_name, sender_email, -({score}) AS score FROM counts, stats WHERE {every})
{tail}"""


TWO, PHRASE = [["ther"], ["the"]], [["of", "the"]]


@_query(_bm25_sql(TWO, "SELECT doc_id, folder, round(score, 6) AS score FROM hits ORDER BY hits.score, doc_id LIMIT 20"))
def fts_bm25_topk(spark, sf_dir):
    docs = doc_mail(spark, sf_dir)
    return postings.index_of(docs, ["folder", "body"]).page(docs, Query(text="ther the", limit=20)).select("doc_id", "folder", F.round("score", 6).alias("score"))


@_query(_bm25_sql(TWO, "SELECT count(*) AS total FROM hits"))
def fts_total(spark, sf_dir):
    docs = doc_mail(spark, sf_dir)
    return postings.index_of(docs, ["folder", "body"]).total(docs, Query(text="ther the"))


@_query(_bm25_sql(PHRASE, "SELECT doc_id, round(score, 6) AS score FROM hits"))
def fts_phrase(spark, sf_dir):
    return doc_matches(spark, sf_dir, Query(text="of-the")).select("doc_id", F.round("score", 6).alias("score"))


@_query(_bm25_sql([["of", "the"], ["en"]], "SELECT doc_id, round(score, 6) AS score FROM hits"))
def fts_multi_and(spark, sf_dir):
    return doc_matches(spark, sf_dir, Query(text="of-the en")).select("doc_id", F.round("score", 6).alias("score"))


@_query(_bm25_sql([["the"]], f"SELECT doc_id, folder, round(score, 6) AS score FROM hits WHERE (folder = 'src1' OR {FOLD.format('folder')} LIKE 'src1/%') AND ({FOLD.format('sender_name')} LIKE '%rc1%' OR {FOLD.format('sender_email')} LIKE '%rc1%')"))
def fts_filtered(spark, sf_dir):
    found = doc_matches(spark, sf_dir, Query(text="the", folder="src1", sender="RC1"))
    return found.select("doc_id", "folder", F.round("score", 6).alias("score"))


@_query(_bm25_sql([["of", "the"], ["on"]], "SELECT doc_id, round(score, 6) AS score FROM hits"))
def fts_postings(spark, sf_dir):
    index = postings.TextIndex(spark, f"{shared_dir(spark)}/text-{uuid.uuid4().hex}", ["folder", "body"])
    index.add(doc_mail(spark, sf_dir))
    return index.ranked("of-the on").select("doc_id", F.round("score", 6).alias("score"))


@_query(_bm25_sql([["the"], ["of"]], "SELECT doc_id, round(score, 6) AS score FROM hits").replace("FROM documents)", "FROM documents WHERE doc_id % 5 <> 2)", 1))
def fts_after_deletes(spark, sf_dir):
    docs = doc_mail(spark, sf_dir)
    index = postings.TextIndex(spark, f"{shared_dir(spark)}/text-{uuid.uuid4().hex}", ["folder", "body"])
    index.add(docs.where("doc_id % 2 = 0").withColumn("body", F.concat("body", F.lit(" an old version of the text"))))
    index.add(docs.where("doc_id % 4 <> 1"))
    index.delete(docs.where("doc_id % 5 = 2"))
    index.compact()
    index.add(docs.where("doc_id % 4 = 1 AND doc_id % 5 <> 2"))
    return index.ranked("the of").select("doc_id", F.round("score", 6).alias("score"))


@_query("SELECT doc_id FROM (SELECT doc_id FROM documents) WHERE false")
def fts_punctuation_only(spark, sf_dir):
    return doc_matches(spark, sf_dir, Query(text="* --")).select("doc_id")


@_query(f"WITH {ORDER_MAIL} SELECT doc_id, folder, date FROM mail ORDER BY date DESC, doc_id LIMIT 50")
def browse_newest(spark, sf_dir):
    return search.paged(order_mail(spark, sf_dir), Query()).select("doc_id", "folder", "date")


@_query(f"WITH {ORDER_MAIL} SELECT doc_id, folder, date FROM mail ORDER BY date DESC, doc_id LIMIT 50 OFFSET 50")
def browse_page2(spark, sf_dir):
    return search.paged(order_mail(spark, sf_dir), Query(offset=50)).select("doc_id", "folder", "date")


@_query(f"WITH {ORDER_MAIL} SELECT doc_id, date FROM mail WHERE date >= epoch(TIMESTAMP '1996-03-01') AND date < epoch(TIMESTAMP '1997-01-01')")
def filter_after_before(spark, sf_dir):
    return search.filtered(order_mail(spark, sf_dir), Query(after=_utc(1996, 3), before=_utc(1997))).select("doc_id", "date")


@_query(f"WITH {ORDER_MAIL} SELECT doc_id, date FROM mail WHERE year(to_timestamp(date) AT TIME ZONE 'UTC') = 1998")
def filter_year(spark, sf_dir):
    return search.filtered(order_mail(spark, sf_dir), search.parse_query("", year=1998)).select("doc_id", "date")


@_query("SELECT o_orderkey AS doc_id, count(*) AS n_attachments FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL")
def filter_has_attach(spark, sf_dir):
    parts = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n_attachments"))
    docs = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).join(parts.withColumnRenamed("l_orderkey", "doc_id"), "doc_id", "left").withColumn("has_attach", F.col("n_attachments").isNotNull())
    return search.filtered(docs, Query(has_attach=True)).select("doc_id", "n_attachments")


@_query(f"WITH {ORDER_MAIL}, part_dated AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE date END AS date FROM mail) SELECT doc_id, date FROM part_dated WHERE date < epoch(TIMESTAMP '1996-01-01')")
def before_includes_unknown(spark, sf_dir):
    docs = order_mail(spark, sf_dir).withColumn("date", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("date")))
    return search.filtered(docs, Query(before=_utc(1996))).select("doc_id", "date")


@_query(f"WITH {ORDER_MAIL} SELECT doc_id, sender_name FROM mail WHERE {FOLD.format('sender_name')} LIKE '%mer#00000_1%' OR {FOLD.format('sender_email')} LIKE '%mer#00000_1%'")
def sender_like_ascii(spark, sf_dir):
    return search.filtered(order_mail(spark, sf_dir), Query(sender="MER#00000_1")).select("doc_id", "sender_name")


@_query(f"WITH {ORDER_MAIL} SELECT doc_id, folder FROM mail WHERE folder = '1-urgent' OR {FOLD.format('folder')} LIKE '1-urgent/%'")
def folder_subtree(spark, sf_dir):
    return search.filtered(order_mail(spark, sf_dir), Query(folder="1-urgent")).select("doc_id", "folder")


@_query(f"WITH {DOC_MAIL} SELECT folder, count(*) AS count FROM docs GROUP BY folder")
def facet_folders(spark, sf_dir):
    return search.folder_facet(doc_mail(spark, sf_dir))


@_query(f"WITH {ORDER_MAIL} SELECT DISTINCT CAST(year(to_timestamp(date) AT TIME ZONE 'UTC') AS INTEGER) AS year FROM mail WHERE date > 0")
def facet_years(spark, sf_dir):
    return search.years(order_mail(spark, sf_dir))


@_query("SELECT count(*) AS n FROM documents")
def doc_count(spark, sf_dir):
    docs = doc_mail(spark, sf_dir)
    return postings.index_of(docs, ["folder", "body"]).total(docs, Query()).withColumnRenamed("total", "n")


def _events(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"))


EVENTS = "ev AS (SELECT event_id, user_id, event_type, ts, event_type || '/' || user_id AS key FROM events)"
MID = datetime(2024, 1, 3, tzinfo=timezone.utc)


@_query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts FROM events) WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-03'")
def since_filter(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("date", F.when(F.col("event_id") % 9 != 0, F.col("ts")))
    return archive.since(rows, MID).select("event_id")


@_query(f"WITH {EVENTS} SELECT key, min(event_id) AS event_id FROM ev WHERE ts >= TIMESTAMP '2024-01-03' AND key NOT IN (SELECT key FROM ev WHERE ts < TIMESTAMP '2024-01-03') GROUP BY key")
def incremental_new(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return archive.unseen(ev.where(F.col("ts") >= F.lit(MID)), ev.where(F.col("ts") < F.lit(MID))).select("key", "event_id")


@_query(f"WITH {EVENTS} SELECT count(*) AS skipped FROM ev WHERE ts >= TIMESTAMP '2024-01-03' AND key IN (SELECT key FROM ev WHERE ts < TIMESTAMP '2024-01-03')")
def incremental_seen(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return archive.seen(ev.where(F.col("ts") >= F.lit(MID)), ev.where(F.col("ts") < F.lit(MID))).agg(F.count("*").alias("skipped"))


@_query(f"WITH {EVENTS} SELECT key, min(event_id) AS event_id FROM ev GROUP BY key")
def dedup_first_wins(spark, sf_dir):
    return archive.first_wins(_events(spark, sf_dir)).select("key", "event_id")


@_query(f"WITH {EVENTS}, old AS (SELECT * FROM ev WHERE event_id % 2 = 0), new AS (SELECT * FROM ev WHERE event_id % 2 = 1), m AS (SELECT key, max(event_id) AS event_id FROM new GROUP BY key) SELECT * FROM m UNION ALL SELECT key, max(event_id) FROM old WHERE key NOT IN (SELECT key FROM m) GROUP BY key")
def upsert_last_wins(spark, sf_dir):
    ev = _events(spark, sf_dir).select("key", "event_id", "seq")
    old, new = (archive.last_wins(ev.where(F.col("event_id") % 2 == k)) for k in (0, 1))
    return archive.upsert(old, new).select("key", "event_id")


@_query(f"WITH {EVENTS} SELECT event_id FROM ev WHERE key NOT IN (SELECT key FROM ev WHERE event_id < 50)")
def delete_by_key(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return archive.without(ev, ev.where("event_id < 50").select("key")).select("event_id")


@_query("SELECT doc_id, source || '/' || lang || chr(0) || 'sha:' || sha256(text || chr(0) || source || chr(0)) AS key FROM documents")
def identity_key(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", M.message_key(F.concat_ws("/", "source", "lang"), M.identity(F.lit(""), "text", "source")).alias("key"))


@_query("SELECT 'sha:' || sha256(text || chr(0)) AS ident, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def dup_identities(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(M.identity(F.lit(" "), "text").alias("ident"))
    return d.groupBy("ident").agg(F.count("*").alias("n")).where("n > 1")


@_query("SELECT doc_id, coalesce(source, '') AS sender, sha256(coalesce(text, '')) AS body FROM documents")
def mbox_round_trip(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    headers = {"From": F.concat("source", F.lit(" <mail@example.org>")), "Subject": F.col("doc_id").cast("string"), "Message-ID": F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit("@example.org>"))}
    ways = {c: mboxes.raw_message(headers, F.col("text"), c, F.col("doc_id") % 3 == 0) for c in ("UTF-8", "ISO-8859-1")}
    plain = F.col("text").rlike(r"\A[\x00-\xFF]*\z") & (F.col("doc_id") % 2 == 0)
    home = f"{shared_dir(spark)}/mboxes-{uuid.uuid4().hex}"
    mboxes.write_mboxes(d.select(F.when(plain, ways["ISO-8859-1"]).otherwise(ways["UTF-8"]).alias("data")), home).write.format("noop").mode("overwrite").save()
    found = mailbox.read_mailbox(spark, home, "mbox-tree", range_bytes=1 << 20)
    return found.select(F.col("subject").cast("long").alias("doc_id"), F.col("sender_name").alias("sender"), F.sha2(F.regexp_replace("plain_body", r"\n\z", "").cast("binary"), 256).alias("body"))


_SLUG = "trim(left(CASE WHEN trim(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-._ ') = '' THEN 'untitled' ELSE trim(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-._ ') END, 60), '-._ ')"


@_query(f"SELECT doc_id, {_SLUG.format('text')} AS slug FROM documents")
def slug(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.slug("text").alias("slug"))


_SEG = "left(trim(regexp_replace(regexp_replace({0}, '[<>:\"/\\\\|?*\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g'), ' .'), 120)"


@_query(f"SELECT p_partkey, {_SEG.format('s')} AS segment FROM (SELECT p_partkey, p_name || ' <' || p_type || '>:' || p_brand || '?.' AS s FROM part)")
def sanitize_segment(spark, sf_dir):
    name = F.concat("p_name", F.lit(" <"), "p_type", F.lit(">:"), "p_brand", F.lit("?."))
    return _read(spark, sf_dir, "part").select("p_partkey", T.sanitize_segment(name).alias("segment"))


@_query("SELECT doc_id, left(sha1(text), 8) AS hash FROM documents")
def short_hash(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.short_hash("text").alias("hash"))


@_query(f"WITH {ORDER_MAIL} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '0000-00-00_0000' ELSE strftime(to_timestamp(date) AT TIME ZONE 'UTC', '%Y-%m-%d_%H%M') END || '_' || {_SLUG.format('sender_name')} || '_' || left(sha1(folder || doc_id), 8) AS stem FROM mail")
def file_stem(spark, sf_dir):
    date = F.when(F.col("doc_id") % 11 != 0, F.timestamp_seconds("date"))
    return order_mail(spark, sf_dir).select("doc_id", M.file_stem(date, "sender_name", F.concat("folder", F.col("doc_id").cast("string"))).alias("stem"))


@_query(f"SELECT doc_id, source || '/' || lang || '/' || 'in box' || '/0000-00-00_0000_' || {_SLUG.format('text')} || '_' || left(sha1(CAST(doc_id AS VARCHAR)), 8) || '.html' AS path FROM documents")
def export_path(spark, sf_dir):
    stem = M.file_stem(F.lit(None).cast("timestamp"), "text", F.col("doc_id").cast("string"))
    return _read(spark, sf_dir, "documents").select("doc_id", M.export_path("source", F.array("lang", F.lit("in/box?")), stem).alias("path"))


@_query("SELECT doc_id, CASE WHEN length(t) > 240 THEN trim(left(t, 240)) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def snippet240(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@_query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM documents")
def normalize_ws(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_ws("text").cast("binary"), 256).alias("body"))


@_query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE o_orderpriority || ', ' || o_orderstatus END AS recipients FROM orders")
def recipients_join(spark, sf_dir):
    to = F.when(F.col("o_orderkey") % 5 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority"))
    cc = F.when((F.col("o_orderkey") % 7 == 0) & (F.col("o_orderkey") % 5 != 0), F.lit("")).otherwise(F.concat(F.lit("\t"), "o_orderstatus"))
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), M.joined(to, cc).alias("recipients"))


@_query(f"WITH {ORDER_MAIL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sender_email WHEN doc_id % 4 = 1 THEN sender_name ELSE sender_name || ' <' || sender_email || '>' END AS header, CASE WHEN doc_id % 4 = 0 THEN sender_email ELSE sender_name END AS listed, CASE WHEN doc_id % 4 = 0 THEN sender_email WHEN doc_id % 4 = 1 THEN sender_name ELSE sender_name || ' ' || sender_email END AS indexed FROM mail")
def display_sender(spark, sf_dir):
    name = F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).otherwise(F.col("sender_name"))
    email = F.when(F.col("doc_id") % 4 == 1, F.lit("")).otherwise(F.col("sender_email"))
    return order_mail(spark, sf_dir).select("doc_id", M.header_sender(name, email).alias("header"), M.listing_sender(name, email).alias("listed"), M.sender(name, email).alias("indexed"))


@_query("SELECT l_orderkey AS doc_id, string_agg(p_name || '.bin', ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS attach_names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def attach_names(spark, sf_dir):
    li, p = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat("p_name", F.lit(".bin")).alias("name")))).alias("a"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), M.attachment_names(F.transform("a", lambda x: F.struct(x["name"].alias("filename")))).alias("attach_names"))


@_query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE role END AS body FROM conversations")
def body_precedence_index(spark, sf_dir):
    plain = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit("\n "))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", M.first_body(plain, "role", "text").alias("body"))


@_query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE url END AS body FROM pages")
def body_precedence_render(spark, sf_dir):
    page = F.when(F.col("page_id") % 2 == 0, F.col("html"))
    return _read(spark, sf_dir, "pages").select("page_id", M.first_body(page, "url", F.lit("rtf")).alias("body"))


@_query()
def html_to_text(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", H.html_to_text("html").alias("text"))


_BLOCK_RE = "|".join(H.BLOCKS)
_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script\\s*>', ' ', 'gis'), '<style\\b[^>]*>.*?</style\\s*>', ' ', 'gis'), '<head\\b[^>]*>.*?</head\\s*>', ' ', 'gis'), '<!--.*?-->', '', 'gs'), '</?(" + _BLOCK_RE + ")\\b[^>]*>', ' ', 'gis'), '<[^>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_a}', '{_b}')"


@_query(f"SELECT page_id, trim(regexp_replace({_TEXT}, '[\\s ]+', ' ', 'g')) AS text FROM pages")
def html_to_text_plain(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", H.html_to_text_plain("html").alias("text"))


@_query("SELECT page_id, html || '<img src=\"CID:a.' || (page_id % 3) || '@x\"><img src=\"cid:b@x\"><img src=\"cid:b@x\">' AS h FROM pages".join(("SELECT page_id, unnest(['a.' || (page_id % 3) || '@x', 'b@x']) AS cid FROM (", ")")))
def unresolved_cids(spark, sf_dir):
    body = F.concat("html", F.lit('<img src="CID:a.'), (F.col("page_id") % 3).cast("string"), F.lit('@x"><img src="cid:b@x"><img src="cid:b@x">'))
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(M.cid_references(body)).alias("cid"))


@_query("SELECT 'unresolved-inline-image' AS kind, url AS subject, 'p' || page_id || '@x' AS detail FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT 'empty-attachment', url, 'a.png' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'empty-attachment', url, 'attachment-1' FROM pages WHERE page_id % 3 = 0")
def issues_report(spark, sf_dir):
    part = lambda name, size: F.struct(F.lit(name).alias("filename"), F.lit("").alias("content_id"), F.lit(size).cast("binary").alias("content"))
    three = F.col("page_id") % 3 == 0
    parts = F.when(three, F.array(part("a.png", ""), part("", ""))).otherwise(F.array(part("b.png", "x")))
    page = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("cid:p"), F.col("page_id").cast("string"), F.lit("@x"))).otherwise(F.col("html"))
    rows = _read(spark, sf_dir, "pages").select(F.lit("f").alias("folder"), F.col("url").alias("subject"), F.lit(None).cast("date").alias("date"), F.col("url").alias("path"), parts.alias("attachments"), page.alias("html"))
    return archive.issues(rows).select("kind", "subject", "detail")


def _doc_paths(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".html")).alias("path"))


DOC_PATHS = "p AS (SELECT doc_id, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.html' AS path, source || '/' || lang AS dir FROM documents)"


@_query(f"WITH {DOC_PATHS} SELECT dir, path, CAST(row_number() OVER (PARTITION BY dir ORDER BY path DESC) AS INTEGER) AS place FROM p QUALIFY place <= 5")
def folder_listing_top(spark, sf_dir):
    return listing.folder_pages(_doc_paths(spark, sf_dir), 5).select("dir", "path", "place")


@_query(f"WITH {DOC_PATHS} SELECT dir, count(*) AS total, least(count(*), 20) AS shown, greatest(count(*) - 20, 0) AS omitted, CAST(2 AS INTEGER) AS depth FROM p GROUP BY dir")
def folder_totals(spark, sf_dir):
    return listing.folder_totals(_doc_paths(spark, sf_dir), 20)


@_query("SELECT source AS store, count(DISTINCT lang) AS folders, count(*) AS total FROM documents GROUP BY source")
def root_totals(spark, sf_dir):
    return listing.store_totals(_doc_paths(spark, sf_dir))


@_query(f"WITH {DOC_PATHS} SELECT doc_id FROM p WHERE doc_id % 10 <> 3")
def reconcile_kept(spark, sf_dir):
    docs = _doc_paths(spark, sf_dir)
    return archive.reconciled(docs, docs.where("doc_id % 10 <> 3").select("path"))[0].select("doc_id")


@_query(f"WITH {DOC_PATHS} SELECT doc_id, path FROM p WHERE doc_id % 10 = 3")
def reconcile_pruned(spark, sf_dir):
    docs = _doc_paths(spark, sf_dir)
    return archive.reconciled(docs, docs.where("doc_id % 10 <> 3").select("path"))[1].select("doc_id", "path")


@_query("""WITH d AS (SELECT *, n_chars >= 500 AND doc_id % 4 <> 0 AS new FROM documents),
a AS (SELECT doc_id, (doc_id + i) % 5 = 0 AS used, (doc_id + i) % 3 = 0 AS empty FROM (SELECT doc_id, unnest(range(0, doc_id % 4)) AS i FROM d WHERE new)),
c AS (SELECT count(*) FILTER (NOT used AND NOT empty) AS attachments, count(*) FILTER (used) AS attachments_inline, count(*) FILTER (NOT used AND empty) AS attachments_empty FROM a)
SELECT count(*) AS scanned, count(*) FILTER (n_chars < 500) AS skipped_date, count(*) FILTER (n_chars >= 500 AND doc_id % 4 = 0) AS skipped_seen, count(*) FILTER (new) AS exported,
count(*) FILTER (new AND doc_id % 7 IN (1, 2)) AS non_html, count(*) FILTER (new AND doc_id % 7 = 0) AS no_body, (SELECT attachments FROM c) AS attachments, (SELECT attachments_inline FROM c) AS attachments_inline,
(SELECT attachments_empty FROM c) AS attachments_empty, CAST(coalesce(sum(2) FILTER (new AND doc_id % 6 = 1), 0) AS BIGINT) AS unresolved_inline FROM d""")
def run_stats(spark, sf_dir):
    body = lambda k, c: F.when(k, F.col(c)).otherwise(F.lit(" "))
    seven, none = F.col("doc_id") % 7, F.array().cast("array<int>")
    places = F.when(F.col("doc_id") % 4 > 0, F.sequence(F.lit(0), (F.col("doc_id") % 4 - 1).cast("int"))).otherwise(none)
    part = lambda i: F.struct(F.when((F.col("doc_id") + i) % 3 == 0, F.lit("")).otherwise(F.lit("x")).cast("binary").alias("content"))
    page = F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit('<img src="cid:a'), F.col("doc_id").cast("string"), F.lit('@x"><img src="cid:b@x">'))).otherwise(F.lit("none"))
    rows = _read(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", body(seven > 2, "lang").alias("html_body"), body(seven == 1, "lang").alias("plain_body"), body(seven == 2, "lang").alias("rtf_body"),
        F.transform(places, part).alias("attachments"), F.transform(places, lambda i: (F.col("doc_id") + i) % 5 == 0).alias("consumed"), page.alias("html"),
    )
    return archive.run_stats(rows, F.col("n_chars") < 500, F.col("doc_id") % 4 == 0)


@_query("""WITH RECURSIVE p AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_returnflag || CASE WHEN l_partkey % 3 = 0 THEN ' (1).txt' ELSE '.txt' END AS name,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, k, name AS entry, [name] AS taken FROM p WHERE k = 1
UNION ALL SELECT l_orderkey, l_linenumber, k, entry, list_append(taken, entry) FROM (SELECT p.*, r.taken,
list_filter(list_transform(range(0, len(r.taken) + 1), lambda i: CASE WHEN i = 0 THEN p.name ELSE left(p.name, length(p.name) - 4) || ' (' || i || ').txt' END), lambda c: NOT list_contains(r.taken, c))[1] AS entry
FROM r JOIN p ON p.l_orderkey = r.l_orderkey AND p.k = r.k + 1))
SELECT l_orderkey, l_linenumber, entry FROM r""")
def dup_attachment_names(spark, sf_dir):
    name = F.concat("l_returnflag", F.when(F.col("l_partkey") % 3 == 0, F.lit(" (1).txt")).otherwise(F.lit(".txt")))
    parts = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return listing.duplicate_names(parts, "l_orderkey", "name", "at").select("l_orderkey", "l_linenumber", "entry")


@_query("SELECT event_type AS store, count(*) AS files, round(sum(value), 4) AS size FROM events GROUP BY 1")
def store_size(spark, sf_dir):
    files = _read(spark, sf_dir, "events").select(F.col("event_type").alias("store"), F.col("value").alias("size"))
    return listing.store_sizes(files).withColumn("size", F.round("size", 4))


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, CAST(epoch(min(ts)) * 1000000 AS BIGINT) AS first_us, CAST(epoch(max(ts)) * 1000000 AS BIGINT) AS last_us, count(*) AS n FROM s GROUP BY user_id, k""")
def quiescence_gaps(spark, sf_dir):
    rows = _events(spark, sf_dir)
    runs = quiescence.active_runs(rows, "user_id", "ts", "6 hours")
    return runs.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


@_query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS next, max(epoch_us(ts) // 1000) OVER () AS last FROM events)
SELECT CAST(user_id AS VARCHAR) AS store, ms AS since_ms, event_id AS size FROM e WHERE CASE WHEN next IS NULL THEN last - ms >= 21600000 ELSE next - ms > 21600000 END""")
def quiet_times(spark, sf_dir):
    polls = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("store"), F.timestamp_millis(F.unix_millis("ts")).alias("ts"), F.col("event_id").alias("size"))
    return quiescence.replay(polls, 3, 6 * 3600).select("store", F.unix_millis("since").alias("since_ms"), "size")


@_query(f"WITH {EVENTS} SELECT key, min(event_id) AS event_id FROM ev GROUP BY key")
def stream_incremental(spark, sf_dir):
    return incremental.replay(_events(spark, sf_dir).select("key", "event_id", "seq"), chunks=3)


@_query("SELECT doc_id, source AS store, left(sha1(text), 8) || '.html' AS file FROM documents UNION ALL SELECT page_id, 'pages', left(sha1(html), 8) || '.html' FROM pages")
def union_of_sources(spark, sf_dir):
    a = _read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("store"), F.concat(T.short_hash("text"), F.lit(".html")).alias("file"))
    b = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("pages").alias("store"), F.concat(T.short_hash("html"), F.lit(".html")).alias("file"))
    return a.unionByName(b)


@_query("SELECT doc_id, to_json({'folder': source, 'hasAttach': lang = 'en'}) AS json FROM documents")
def json_results(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("folder"), (F.col("lang") == "en").alias("has_attach"))
    return rows.select("doc_id", M.results_json(["folder", "has_attach"]).alias("json"))


@_query("""WITH p AS (SELECT doc_id, source || '/' || lang AS dir, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS base, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS place FROM documents),
r AS (SELECT dir, place, '<tr><td>' || CASE WHEN doc_id > 0 THEN strftime(to_timestamp(doc_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') ELSE '' END || '</td><td>(unknown)</td><td><a href="' || base || '.html">m&amp;' || doc_id || '</a></td><td>' ||
CASE WHEN doc_id % 3 = 0 THEN '<a href="' || base || '-attachments.zip">zip</a>' ELSE '' END || '</td></tr>' AS row FROM p WHERE place <= 20),
t AS (SELECT source || '/' || lang AS dir, count(*) AS n FROM documents GROUP BY 1)
SELECT dir || '/index.html' AS path, sha256('<!DOCTYPE html><html><head><meta charset="utf-8"><title>' || dir || '</title></head><body><h1>' || dir || '</h1><p><a href="../../index.html">all folders</a> ' || max(n) || ' messages' ||
CASE WHEN max(n) > 20 THEN ', ' || (max(n) - 20) || ' older not listed' ELSE '' END || '</p><table>' || string_agg(row, chr(10) ORDER BY place) || '</table></body></html>') AS page FROM r JOIN t USING (dir) GROUP BY dir""")
def folder_page_texts(spark, sf_dir):
    docs = _doc_paths(spark, sf_dir).select("path", F.concat(F.lit("m&"), F.col("doc_id").cast("string")).alias("subject"), F.lit("").alias("sender_name"), F.lit("").alias("sender_email"), F.col("doc_id").alias("date"), (F.col("doc_id") % 3 == 0).alias("has_attach"))
    return pages.folder_page_texts(docs, 20).select("path", F.sha2("html", 256).alias("page"))


@_query("""WITH s AS (SELECT s_suppkey, 'server' || s_suppkey AS server, CASE WHEN s_suppkey % 3 = 0 THEN 'mail' || s_nationkey || '.org' ELSE '' END AS hostname, CASE WHEN s_suppkey % 3 = 1 THEN '/home/m' || s_nationkey ELSE '' END AS directory,
CASE WHEN s_suppkey % 3 = 2 THEN '[ProfD]Mail/x' || s_nationkey ELSE '' END AS rel FROM supplier),
t AS (SELECT n_nationkey AS n, unnest(['/data/mail' || n_nationkey || '.org', '/data/m' || n_nationkey || '/', 'x' || n_nationkey, 'none' || n_nationkey]) AS store FROM nation),
b AS (SELECT store, regexp_extract(rtrim(store, '/'), '[^/]*$') AS name FROM t)
SELECT store, min(server) AS server FROM b LEFT JOIN s ON hostname = name OR (directory <> '' AND regexp_extract(directory, '[^/]*$') = name) OR (rel <> '' AND ends_with(rel, name)) GROUP BY store""")
def account_lookup(spark, sf_dir):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    of = lambda k, text: F.when(key % 3 == k, text).otherwise(F.lit(""))
    lines = _read(spark, sf_dir, "supplier").select(F.explode(F.array(
        F.struct(F.lit("hostname").alias("f"), of(0, F.concat(F.lit("mail"), nation, F.lit(".org"))).alias("v")), F.struct(F.lit("directory").alias("f"), of(1, F.concat(F.lit("/home/m"), nation)).alias("v")),
        F.struct(F.lit("directory-rel").alias("f"), of(2, F.concat(F.lit("[ProfD]Mail/x"), nation)).alias("v")))).alias("x"), "s_suppkey",
    ).select(F.format_string('user_pref("mail.server.server%d.%s", "%s");', "s_suppkey", "x.f", "x.v").alias("value"))
    n = F.col("n_nationkey").cast("string")
    stores = _read(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit("/data/mail"), n, F.lit(".org")), F.concat(F.lit("/data/m"), n, F.lit("/")), F.concat(F.lit("x"), n), F.concat(F.lit("none"), n))).alias("store"))
    return accounts.accounts_of(stores, accounts.accounts(accounts.preferences(lines))).select("store", "server")


@_query("""WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN coalesce(CASE WHEN s_suppkey % 3 = 0 THEN n_name END, 'Evolution ' || s_suppkey) WHEN s_suppkey % 5 = 0 THEN 'On This Computer' ELSE 'u' || s_nationkey END AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s_suppkey) AS k FROM l)
SELECT s_suppkey, label, CASE WHEN k > 1 THEN label || ' (' || k || ')' ELSE label END AS choice FROM c""")
def store_labels(spark, sf_dir):
    key = F.col("s_suppkey")
    both = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    path = F.when(key % 2 == 0, F.concat(F.lit("/cache/"), key.cast("string"))).when(key % 5 == 0, F.lit("/data/local/")).otherwise(F.concat(F.lit("/data/u"), F.col("s_nationkey").cast("string")))
    names = both.select(key.cast("string").alias("uid"), F.when(key % 3 == 0, F.col("n_name")).otherwise(F.lit(" ")).alias("display_name"))
    rows = accounts.store_labels(both.select("s_suppkey", path.alias("store"), (key % 2 == 0).alias("cached")), names)
    return accounts.distinct_labels(rows, order="s_suppkey").select("s_suppkey", "label", "choice")


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'long-' || l_partkey WHEN l_partkey % 3 = 1 THEN l_returnflag WHEN l_suppkey % 2 = 0 THEN 'attachment-' || l_linenumber || '.' || l_linestatus ELSE '' END AS name FROM lineitem")
def attachment_naming(spark, sf_dir):
    three = F.col("l_partkey") % 3
    long = F.when(three == 0, F.concat(F.lit("long-"), F.col("l_partkey").cast("string")))
    ext = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("."), "l_linestatus"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", accounts.attachment_name(long, F.when(three == 1, F.col("l_returnflag")), ext, "l_linenumber").alias("name"))


@_query("SELECT c_custkey FROM customer WHERE contains(lower(c_custkey || c_name), lower('1cUSTOMER'))")
def row_narrowing(spark, sf_dir):
    return listing.narrowed(_read(spark, sf_dir, "customer"), "1cUSTOMER", ["c_custkey", "c_name"]).select("c_custkey")
