"""One raw message to the columns of PARSED, with the standard library's parser. No message is dropped."""

from __future__ import annotations

import email
import email.policy
from datetime import timezone
from email.headerregistry import BaseHeader, HeaderRegistry
from email.utils import getaddresses, parsedate_to_datetime
from functools import lru_cache

FIELDS = ("subject", "sender_name", "sender_email", "to", "cc", "sent", "received", "internet_message_id", "html_body", "plain_body", "rtf_body", "attachments")

#: Characters of headers that are kept parsed, and how many of them.
KEPT_CHARS, KEPT = 1000, 1024
_PARSED = HeaderRegistry()
_kept = lru_cache(KEPT)(_PARSED)


def _header(name: str, value: str) -> BaseHeader:
    """A header, parsed once: the parser asks for some of them many times, and messages have many alike."""
    return _kept(name, value) if len(value) <= KEPT_CHARS else _PARSED(name, value)


POLICY = email.policy.default.clone(header_factory=_header)


def text_of(data: bytes, charset: str | None = None) -> str:
    """data in its charset, else as UTF-8, else as Windows-1252."""
    for name in (charset, "utf-8"):
        try:
            return data.decode(name) if name else data.decode()
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("cp1252", "replace")


def _addresses(message, name: str) -> str:
    raw = str(message.get(name, "") or "").strip()
    found = [(n, a) for n, a in getaddresses([raw]) if a]
    return ", ".join(f"{n} <{a}>" if n else a for n, a in found) or raw


def _date(message):
    try:
        when = parsedate_to_datetime(str(message.get("Date", "")))
        return when.astimezone(timezone.utc) if when.tzinfo else when.replace(tzinfo=timezone.utc)
    except (TypeError, ValueError, OverflowError):
        return None


def _parts(message, row: dict) -> None:
    for part in message.walk():
        if part.is_multipart():
            continue
        data = part.get_payload(decode=True) or b""
        kind, name = part.get_content_type(), part.get_filename()
        cid = str(part.get("Content-ID", "") or "").strip().strip("<>")
        inline = part.get_content_disposition() != "attachment"
        field = {"text/html": "html_body", "text/plain": "plain_body"}.get(kind)
        if inline and field and not (name and part.get_content_disposition() == "attachment"):
            row[field] = row[field] or text_of(data, part.get_content_charset())
        else:
            label = (cid or "inline") if inline and not name else name or ""
            row["attachments"].append({"filename": label, "mime_type": kind, "content_id": cid, "size": len(data), "content": data})


def parse(data: bytes | None) -> dict:
    """The row of one message; one that can't be parsed has a fixed subject and its bytes as plain text."""
    row = dict.fromkeys(FIELDS, "") | {"sent": None, "received": None, "attachments": []}
    data = data or b""
    try:
        message = email.message_from_bytes(data, policy=POLICY)
        if not message.keys():
            return row | {"subject": "(unparseable message)", "plain_body": text_of(data)}
        sender = getaddresses([str(message.get("From", "") or "")])
        name, address = next(((n, a) for n, a in sender if a), ("", ""))
        row |= {
            "subject": str(message.get("Subject", "") or ""),
            "sender_name": name,
            "sender_email": address,
            "to": _addresses(message, "To"),
            "cc": _addresses(message, "Cc"),
            "received": _date(message),
            "internet_message_id": str(message.get("Message-ID", "") or "").strip().strip("<>"),
        }
        _parts(message, row)
    except Exception:  # noqa: BLE001 - whatever a broken message does, it keeps its row
        row |= {"subject": row["subject"] or "(unreadable message)", "plain_body": row["plain_body"] or text_of(data)}
    return row
