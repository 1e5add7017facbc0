"""Text functions as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that file systems reserve.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """c with null as the empty string."""
    return F.coalesce(_col(c), F.lit(""))


def trim_all(c: Column | str) -> Column:
    """c without white space of any kind at its ends."""
    return F.regexp_replace(present(c), r"(?U)^\s+|\s+$", "")


def normalize_ws(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(present(c), r"(?U)\s+", " "))


def snippet(c: Column | str, size: int = 240) -> Column:
    """The first size characters, with an ellipsis if there are more."""
    text = normalize_ws(c)
    return F.when(F.char_length(text) > size, F.concat(F.btrim(F.left(text, F.lit(size))), F.lit("…"))).otherwise(text)


def sanitize_segment(c: Column | str) -> Column:
    """c as one path segment: no reserved characters or names, at most 120 characters, never empty."""
    text = F.regexp_replace(present(c), r'[<>:"/\\|?*\x00-\x1f]', " ")
    text = F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" ."))
    named = F.when(F.upper(text).isin(RESERVED), F.concat(F.lit("_"), text)).otherwise(text)
    return F.when(text == "", F.lit("untitled")).otherwise(F.left(named, F.lit(120)))


def sanitize_filename(c: Column | str, index: Column | int) -> Column:
    """c as a file name that keeps its extension; attachment-<index> where c is blank."""
    name = trim_all(c)
    ext = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    base = F.left(name, F.char_length(name) - F.char_length(ext))
    clean = F.concat(sanitize_segment(base), F.regexp_replace(ext, r'[<>:"/\\|?*\x00-\x1f]', ""))
    number = index if isinstance(index, Column) else F.lit(index)
    return F.when(name == "", F.concat(F.lit("attachment-"), number.cast("string"))).otherwise(clean)


def slug(c: Column | str, size: int = 60) -> Column:
    """c as a compact name of letters, digits, dots, underscores and single dashes."""
    text = F.regexp_replace(F.regexp_replace(present(c), r"[^A-Za-z0-9._-]+", "-"), r"-{2,}", "-")
    # The element of an array, so that the patterns run once a row.
    named = lambda t: F.when(t == "", F.lit("untitled")).otherwise(F.btrim(F.left(t, F.lit(size)), F.lit("-._ ")))
    return F.transform(F.array(F.btrim(text, F.lit("-._ "))), named)[0]


def short_hash(c: Column | str) -> Column:
    return F.left(F.sha1(present(c).cast("binary")), F.lit(8))


def strip_marks(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "</?mark>", "")


def tsv_clean(c: Column | str) -> Column:
    return F.translate(present(c), "\t\n\r", "   ")


def path_escape(c: Column | str) -> Column:
    """c percent-encoded as path segments, slashes kept."""
    return F.replace(F.replace(F.url_encode(present(c)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def ascii_lower(c: Column | str) -> Column:
    """A-Z folded, all other letters kept."""
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_like(c: Column | str, pattern: str) -> Column:
    """LIKE that ignores case for A-Z only; the pattern has no escape character."""
    folded = pattern.translate({i: i + 32 for i in range(65, 91)}).replace("\\", "\\\\")
    return ascii_lower(c).like(folded)


def html_escape(c: Column | str) -> Column:
    out = present(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@lru_cache
def _marked() -> tuple[str, str]:
    """Letters that decompose to one base character and marks, with those bases, and then all marks."""
    letters, bases, marks = [], [], []
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            letters.append(c)
            bases.append(d[0])
    return "".join(letters + marks), "".join(bases)


def token_text(c: Column | str) -> Column:
    """The tokens of c with a space before each and one at the end."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate(F.lower(present(c)), *_marked()), r"[^\p{L}\p{N}\p{Co}]+", " ")), F.lit(" "))


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and private characters, without diacritics."""
    text = F.lower(present(c))
    # Of ASCII, which has no diacritics, the plainer pattern finds the same in less time.
    ascii = F.octet_length(text) == F.char_length(text)
    return F.when(ascii, F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1))).otherwise(F.regexp_extract_all(F.translate(text, *_marked()), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1)))
