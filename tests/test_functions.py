from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.operators.search import phrases
from postmill.functions import html as H
from postmill.functions import messages as M
from postmill.functions import text as T
from postmill.functions.dates import parse_date, parse_since

NOW = datetime(2026, 7, 15, tzinfo=timezone.utc)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, expected", [("a/b\\c:d*e?", "a b c d e"), ("   ", "untitled"), ("con", "_con"), ("x" * 300, "x" * 120), ("..", "untitled"), (None, "untitled"), ("a\x00b. ", "a b")])
def test_sanitize_segment(spark, text, expected):
    assert one(spark, T.sanitize_segment(F.lit(text))) == expected


@pytest.mark.parametrize("name, index, expected", [("report:final.PDF", 1, "report final.PDF"), ("", 3, "attachment-3"), (None, 0, "attachment-0"), ("a.b.txt", 0, "a.b.txt")])
def test_sanitize_filename(spark, name, index, expected):
    assert one(spark, T.sanitize_filename(F.lit(name), index)) == expected


@pytest.mark.parametrize("text, expected", [("Hello, World!", "Hello-World"), ("Re: [ticket] #42", "Re-ticket-42"), ("***", "untitled"), ("é", "untitled")])
def test_slug(spark, text, expected):
    assert one(spark, T.slug(F.lit(text))) == expected


@pytest.mark.parametrize("name", ["../../etc/passwd", "..\\..\\x", "a/../b", "C:\\x", "/abs", "....", "\x00/x", "nul", "a|b", "..", "~/x"])
def test_segments_hold_no_path(spark, name):
    found = one(spark, T.sanitize_segment(F.lit(name)))
    assert found and "/" not in found and "\\" not in found and found != ".."


@pytest.mark.parametrize("text, back", [("30d", timedelta(days=30)), ("4w", timedelta(weeks=4)), ("12h", timedelta(hours=12)), ("90m", timedelta(minutes=90)), ("1h30m", timedelta(minutes=90)), ("-5d", timedelta(days=-5))])
def test_relative_windows(text, back):
    assert parse_since(text, NOW) == NOW - back


@pytest.mark.parametrize("text", ["", "nonsense", "10x", "2026-13-40", "1.5d"])
def test_bad_windows_are_refused(text):
    with pytest.raises(ValueError):
        parse_since(text, NOW)


def test_dates():
    assert parse_since("2026/07/01", NOW) == parse_date("2026-07-01") == datetime(2026, 7, 1, tzinfo=timezone.utc)
    assert parse_date("2025-01") is None and parse_date("") is None


def test_snippet_cuts_and_collapses(spark):
    assert one(spark, T.snippet(F.lit(" a \n b "))) == "a b"
    assert one(spark, T.snippet(F.lit("x" * 300))) == "x" * 240 + "…"


def test_like_folds_ascii_only(spark):
    assert one(spark, T.ascii_like(F.lit("INBOX/É"), "inbox/%"))
    assert not one(spark, T.ascii_like(F.lit("É"), "é"))
    assert one(spark, T.ascii_like(F.lit("a\\b"), "a\\b"))


def test_tokens_fold_marks(spark):
    assert one(spark, T.tokens(F.lit("Ça vÄ, straße e\u0301 42!"))) == ["ca", "va", "straße", "e", "42"]


def test_identity(spark):
    assert one(spark, M.identity(F.lit(" a@b "), F.lit("x"))) == "mid:a@b"
    a, b = (one(spark, M.identity(F.lit(""), F.lit(x), F.lit(y))) for x, y in (("ab", "c"), ("a", "bc")))
    assert a.startswith("sha:") and a != b


def test_senders(spark):
    assert one(spark, M.header_sender(F.lit("Bob"), F.lit("bob@x"))) == "Bob <bob@x>"
    assert one(spark, M.header_sender(F.lit("BOB@x"), F.lit("bob@x"))) == "bob@x"
    assert one(spark, M.listing_sender(F.lit(" "), F.lit(None))) == "(unknown)"


def test_html_to_text(spark):
    page = "<html><head><title>no</title></head><body><p>a&amp;b</p><script>x()</script><div>c</div>d</body></html>"
    assert one(spark, H.html_to_text(F.lit(page))) == "a&b c d"
    assert one(spark, H.html_to_text_plain(F.lit(page))) == "a&b c d"


def test_render_escapes_and_keeps_full_documents(spark):
    plain = one(spark, H.render_document(*map(F.lit, ("S<", "f", "t", "", "", "<b>", False))))
    assert "&lt;b&gt;" in plain and "S&lt;" in plain
    full = one(spark, H.render_document(*map(F.lit, ("S", "f", "t", "", "", "<html><head><style>p{}</style></head><body class='x'>hi</body></html>", True))))
    assert "<style>p{}</style>" in full and full.index("message-head") > full.index("<body class='x'>") and 'charset="utf-8"' in full


def test_images_are_embedded(spark):
    part = F.struct(F.lit("a.png").alias("filename"), F.lit("").alias("mime_type"), F.lit("<Img1@x>").alias("content_id"), F.lit(b"abc").alias("content"))
    row = one(spark, H.embed_images(F.lit('<img src="CID:img1@x">'), F.array(part)))
    assert row.html == '<img src="data:image/png;base64,YWJj">' and row.consumed == [True]


def test_highlight_escapes(spark):
    found = one(spark, H.highlight(F.lit("<i> one two report, end"), ["report"]))
    assert "<mark>report</mark>," in found and "&lt;i&gt;" in found


def test_path_escape_and_bytes(spark):
    assert one(spark, T.path_escape(F.lit("a b/ü+"))) == "a%20b/%C3%BC%2B"
    assert one(spark, M.human_bytes(F.lit(1536).cast("long"))) == "1.5 KB"


def test_tokens_of_all_planes(spark):
    text = "a\ue000b cafe\u0301 x\U0001d165y \U0001e8d0z n\u0303\U00010a01o \U0001f600 q"
    assert one(spark, T.tokens(F.lit(text))) == ["a\ue000b", "cafe", "x", "y", "z", "no", "q"]
    assert one(spark, T.token_text(F.lit(text))) == " a\ue000b cafe x y z no q "
    assert phrases("a\ue000b n\u0303\U00010a01o") == [["a\ue000b"], ["no"]]


def test_tokens_of_ascii_and_other_texts(spark):
    texts = ["Don't stop_me\t42x", "", None, "caf\u00e9 Na\u00efve e\u0301 x", "\u00c4b a-B", "\x00A\x7fb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(T.tokens("t")).collect()]
    assert found == [["don", "t", "stop", "me", "42x"], [], [], ["cafe", "naive", "e", "x"], ["ab", "a", "b"], ["a", "b"]]
    # A letter outside ASCII takes nothing from what the plainer pattern finds.
    more = [r[0] for r in df.select(T.tokens(F.concat(F.coalesce("t", F.lit("")), F.lit(" \u4e2d")))).collect()]
    assert more == [f + ["\u4e2d"] for f in found]


def test_pages_are_not_held_as_strings_all_at_once():
    import tracemalloc

    pages = pa.array(["<p>a</p>" + "<!-- \U0001f600" + "x" * 200_000 + " -->b", None] * 40)
    tracemalloc.start()
    try:
        found = H.texts_of(pages).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # A page is 0.8 MB as a string, all of them are 32 MB.
    assert found == ["a b", ""] * 40 and peak < 16 << 20
