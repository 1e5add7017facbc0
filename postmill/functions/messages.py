"""Columns that are derived from a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import _col, normalize_ws, present, sanitize_segment, short_hash, slug, trim_all

NUL = "\u0000"


def effective_date(received: Column | str = "received", sent: Column | str = "sent") -> Column:
    return F.coalesce(_col(received), _col(sent))


def identity(message_id: Column | str, *fields: Column | str) -> Column:
    """mid:<Message-ID> where there is one, else sha:<SHA-256 of fields, each followed by NUL>."""
    mid = trim_all(message_id)
    text = F.concat(*(F.concat(present(f), F.lit(NUL)) for f in fields))
    return F.when(mid != "", F.concat(F.lit("mid:"), mid)).otherwise(F.concat(F.lit("sha:"), F.sha2(text.cast("binary"), 256)))


def message_identity() -> Column:
    """identity() of a row of messages."""
    nanos = F.coalesce(F.unix_micros(effective_date()) * 1000, F.lit(0)).cast("string")
    return identity("internet_message_id", "subject", "sender_email", "to", nanos, F.size(F.coalesce(F.col("attachments"), F.array())).cast("string"), "plain_body", "html_body", "rtf_body")


def message_key(folder: Column | str, ident: Column, store: Column | str | None = None) -> Column:
    """folder and identity; with store, copies of different stores are kept apart."""
    parts = [present(folder), ident] if store is None else [present(store), present(folder), ident]
    return F.concat_ws(NUL, *parts)


def sender(name: Column | str, email: Column | str) -> Column:
    return trim_all(F.concat(trim_all(name), F.lit(" "), trim_all(email)))


def header_sender(name: Column | str, email: Column | str) -> Column:
    """name <email>; one of them where the other is blank or the same but for case."""
    n, e = trim_all(name), trim_all(email)
    return F.when((n != "") & (e != "") & (F.lower(n) != F.lower(e)), F.concat(n, F.lit(" <"), e, F.lit(">"))).when(e != "", e).otherwise(n)


def listing_sender(name: Column | str, email: Column | str) -> Column:
    return F.coalesce(F.nullif(trim_all(name), F.lit("")), F.nullif(trim_all(email), F.lit("")), F.lit("(unknown)"))


def display_subject(subject: Column | str) -> Column:
    return F.coalesce(F.nullif(trim_all(subject), F.lit("")), F.lit("(no subject)"))


def attachment_names(attachments: Column | str) -> Column:
    """The attachments' names in order, those without one left out."""
    return F.array_join(F.filter(F.transform(attachments, lambda a: a["filename"]), lambda x: x != ""), ", ")


def joined(*parts: Column | str) -> Column:
    """The parts that aren't blank, trimmed, with ", " between."""
    return F.array_join(F.filter(F.array(*(trim_all(p) for p in parts)), lambda x: x != ""), ", ")


def first_body(*bodies: Column | str) -> Column:
    """The first body that isn't blank, empty if there is none: plain, html, rtf to index; html, plain, rtf to render."""
    out = F.lit("")
    for b in reversed(bodies):
        out = F.when(trim_all(b) != "", present(b)).otherwise(out)
    return out


def file_stem(date: Column | str, subject: Column | str, key: Column | str) -> Column:
    """YYYY-MM-DD_HHMM_slug_hash; zeros for an unknown date."""
    stamp = F.coalesce(F.date_format(_col(date), "yyyy-MM-dd_HHmm"), F.lit("0000-00-00_0000"))
    return F.concat_ws("_", stamp, slug(subject, 60), short_hash(key))


def export_path(store: Column | str, folder_path: Column | str, stem: Column) -> Column:
    """store/folders/stem.html, every segment safe."""
    return F.concat(F.concat_ws("/", sanitize_segment(store), F.transform(_col(folder_path), sanitize_segment), stem), F.lit(".html"))


def attachment_label(filename: Column | str, content_id: Column | str, index: Column | str) -> Column:
    """The name, else cid:<id>, else attachment-<index>."""
    cid = F.btrim(present(content_id), F.lit("<>"))
    return F.coalesce(F.nullif(trim_all(filename), F.lit("")), F.when(cid != "", F.concat(F.lit("cid:"), cid)), F.concat(F.lit("attachment-"), _col(index).cast("string")))


def cid_references(html: Column | str) -> Column:
    """The distinct cid: references of html, in the order in which they occur first."""
    return F.array_distinct(F.regexp_extract_all(present(html), F.lit(r"(?i)cid:([a-z0-9._%+@-]{1,120})"), F.lit(1)))


def index_body(plain: Column | str, html_text: Column | str, rtf: Column | str) -> Column:
    return normalize_ws(first_body(plain, html_text, rtf))


def human_bytes(n: Column | str) -> Column:
    """Bytes with a binary unit, one decimal from KB up."""
    n = _col(n)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def unique_names(names: Column) -> Column:
    """An array of names, each once: of equal ones the first stays, others become "base (n).ext" with the least free n."""

    def free(taken: Column, name: Column) -> Column:
        ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
        base = F.left(name, F.char_length(name) - F.char_length(ext))
        numbered = F.transform(F.sequence(F.lit(0), F.size(taken)), lambda n: F.when(n == 0, name).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"), ext)))
        return F.filter(numbered, lambda x: ~F.array_contains(taken, x))[0]

    return F.aggregate(names, F.array().cast("array<string>"), lambda taken, name: F.concat(taken, F.array(free(taken, name))))


def results_json(rows: list[str]) -> Column:
    """A row's fields as JSON: names in camel case, as a search's results are handed out."""
    camel = lambda c: c.split("_")[0] + "".join(x.title() for x in c.split("_")[1:])
    return F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in rows)))
