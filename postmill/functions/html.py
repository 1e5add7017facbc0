"""HTML to text, rendering and highlights: the functions that need a parser run over Arrow batches."""

from __future__ import annotations

import base64
import html
import mimetypes
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import normalize_ws, present

#: Elements whose tags part words, and elements whose text isn't shown.
BLOCKS = "p br div li tr td th h1 h2 h3 h4 h5 h6 ul ol table blockquote section article header footer".split()
HIDDEN = ["script", "style", "head"]


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN
        if tag in BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.depth:
            self.depth -= 1
        if tag in BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def _text_of(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    return " ".join("".join(parser.parts).split())


def texts_of(pages: pa.Array) -> pa.Array:
    """The visible text of each page, one page at a time as a string."""
    return pa.array((_text_of(page.as_py()) for page in pages), pa.string())


def html_to_text(c: Column | str) -> Column:
    """The visible text of pages, white space collapsed."""

    def run(pages: pa.Array) -> pa.Array:
        return texts_of(pages)

    return F.arrow_udf(run, "string")(c)


def html_to_text_plain(c: Column | str) -> Column:
    """The visible text by patterns alone: hidden elements and tags cut, five entities decoded; stays in the JVM."""
    text = F.regexp_replace(present(c), r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?is)</?(" + "|".join(BLOCKS) + r")\b[^>]*>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return normalize_ws(text)


def _embed(text: str, parts) -> tuple[str, list[bool]]:
    used = []
    for part in parts if parts is not None else []:
        cid = (part["content_id"] or "").strip("<>")
        find = re.compile("cid:" + re.escape(cid), re.I) if cid else None
        inside = bool(find and part["content"] and find.search(text))
        if inside:
            kind = part["mime_type"] or mimetypes.guess_type(part["filename"] or "")[0] or "application/octet-stream"
            uri = f"data:{kind};base64,{base64.b64encode(part['content']).decode()}"
            text = find.sub(lambda _, uri=uri: uri, text)
        used.append(inside)
    return text, used


def embed_images(body: Column | str, attachments: Column | str) -> Column:
    """html: body with cid: references to attachments as data URIs; consumed: which attachments went in."""

    def run(bodies: pd.Series, parts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_embed(text or "", own) for text, own in zip(bodies, parts)], columns=["html", "consumed"])

    return F.pandas_udf(run, "struct<html:string, consumed:array<boolean>>")(body, attachments)


def _document(subject, sender, to, cc, date, body, is_html) -> str:
    rows = "".join(f"<tr><th>{k}</th><td>{html.escape(v)}</td></tr>" for k, v in (("From", sender), ("To", to), ("Cc", cc), ("Date", date)) if v and v.strip())
    head = f'<div class="message-head"><h1>{html.escape(subject)}</h1><table>{rows}</table></div>'
    opening = re.search(r"<body\b[^>]*>", body, re.I) if is_html and re.search(r"<html\b", body, re.I) else None
    if opening:
        page = body[: opening.end()] + head + body[opening.end() :]
        if not re.search(r"<meta[^>]+charset", page, re.I):
            page = re.sub(r"(<head\b[^>]*>)", lambda m: m[1] + '<meta charset="utf-8">', page, count=1, flags=re.I)
        return page
    inner = body if is_html else f"<pre>{html.escape(body)}</pre>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(subject)}</title></head><body>{head}{inner}</body></html>'


def render_document(subject: Column, sender: Column, to: Column, cc: Column, date: Column, body: Column, is_html: Column) -> Column:
    """A page for each message: a full HTML body keeps its own head, a plain one is escaped."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([_document(*(x if x is not None else "" for x in row)) for row in zip(a, b, c, d, e, f, g)], dtype=object)

    return F.pandas_udf(run, "string")(subject, sender, to, cc, date, body, is_html)


#: A word as the index has it: letters, digits and private characters, with the marks that follow them.
WORD = regex.compile(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*")
#: What a snippet shows where it leaves something out, and what a window gains for each new phrase, each further hit,
#: and for its begin at a sentence or at the text's begin.
ELLIPSIS, NEW, MORE, SENTENCE, FIRST = "… ", 1000, 1, 100, 120


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")


def _windows(hits: list[tuple[int, int]], sizes: list[int], sentences: list[int], n: int, width: int) -> Iterator[tuple[int, int]]:
    """(score, begin) of the windows that come into question: around each hit, and from the last sentence before it."""

    def score(begin: int) -> tuple[int, int, int]:
        own = [(at, p) for at, p in hits if begin <= at < begin + width]
        new = len({p for _, p in own})
        if not own:
            return 0, begin, begin
        return NEW * new + MORE * (len(own) - new), own[0][0], own[-1][0] + sizes[own[-1][1]]

    for at, _ in hits:
        value, first, end = score(at)
        slack = width - (end - first)
        # Half of the slack goes before the hits; a window that would begin before the text is moved.
        yield value, max(0, min(first - int(slack / 2), n - width))
        before = [s for s in sentences if s <= at]
        if n > width and before and before[-1] < at:
            yield score(before[-1])[0] + (FIRST if before[-1] == 0 else SENTENCE), before[-1]


def best_window(text: str, phrases: list[list[str]], width: int = 12, opening: str = "<mark>", closing: str = "</mark>", escape=html.escape) -> str:
    """The width words of text that show most of the phrases, with their hits marked.

    A phrase counts most where it is seen first, further hits little, and windows that begin with a sentence are
    preferred to others; of equal ones the first is taken. Without a hit it is the text's begin.
    """
    words = [(m.start(), m.end(), _plain(m[0])) for m in WORD.finditer(text)]
    plain, n = [w for _, _, w in words], len(words)
    hits = sorted((i, k) for k, p in enumerate(phrases) for i in range(n - len(p) + 1) if plain[i : i + len(p)] == p)
    sentences = [i for i, (at, _, _) in enumerate(words) if i == 0 or (at and text[at - 1] in " \t\n\r" and text[:at].rstrip(" \t\n\r")[-1:] in (".", ":"))] if hits else []
    best, begin = 0, 0
    for value, at in _windows(hits, [len(p) for p in phrases], sentences, n, width):
        if value > best:
            best, begin = value, at
    # Hits that overlap are marked as one.
    spans: list[list[int]] = []
    for at, k in hits:
        if spans and at <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], at + len(phrases[k]) - 1)
        else:
            spans.append([at, at + len(phrases[k]) - 1])
    end = min(begin + width, n) - 1
    cut, out = words[begin][0] if begin else 0, [ELLIPSIS] if begin else []
    for a, b in spans:
        if b < begin or a > end:
            continue
        lo, hi = words[max(a, begin)][0], words[min(b, end)][1]
        out += [escape(text[cut:lo]), opening, escape(text[lo:hi]), closing]
        cut = hi
    whole = begin + width >= n
    out.append(escape(text[cut:] if whole else text[cut : words[end][1]]))
    return "".join(out) + ("" if whole else ELLIPSIS)


def highlight(body: Column | str, phrases: list[list[str] | str], width: int = 12) -> Column:
    """best_window() of each body, where a phrase may be one word; for the rows of a page, not for whole tables."""
    phrases = [[p] if isinstance(p, str) else p for p in phrases]

    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda text: best_window(text or "", phrases, width))

    return F.pandas_udf(run, "string")(body)
