"""Schemas of messages and of the tables that are derived from them. Strings are never null; empty means missing."""

from __future__ import annotations

ATTACHMENT = "filename string, mime_type string, content_id string, size long, content binary"
PARSED = (
    "subject string, sender_name string, sender_email string, `to` string, cc string, sent timestamp, received timestamp, "
    f"internet_message_id string, html_body string, plain_body string, rtf_body string, attachments array<struct<{ATTACHMENT.replace(' string', ':string').replace(' long', ':bigint').replace(' binary', ':binary')}>>"
)
#: file and offset say where in its store a message stands; postmill.sources.mailbox.scan_order() makes an order of them.
MESSAGE = f"store string, folder_path array<string>, {PARSED}, file string, offset long"
MANIFEST = "key string, path string, folder string, exported_at timestamp"
DOCS = (
    "key string, store string, folder string, sender_name string, sender_email string, recipients string, subject string, "
    "date long, path string, has_attach boolean, attach_names string, snippet string, sender string, body string"
)
ISSUE = "kind string, folder string, date date, subject string, detail string, path string"
