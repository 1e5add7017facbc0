from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill.operators import archive, listing
from postmill.sinks import pages
from postmill.sinks.files import entry_names
from postmill.streaming import incremental, quiescence


def test_versions(spark, tmp_path):
    table = archive.Versioned(spark, f"file://{tmp_path}/t", "key string, n int")
    assert table.read().count() == 0
    table.commit(spark.createDataFrame([("a", 1)], "key string, n int"))
    table.commit(archive.upsert(table.read(), spark.createDataFrame([("a", 2), ("b", 1)], "key string, n int")))
    assert sorted(map(tuple, table.read().collect())) == [("a", 2), ("b", 1)]
    other = archive.Versioned(spark, f"file://{tmp_path}/t", "key string, n int")
    other.version = lambda: 1
    with pytest.raises(RuntimeError):
        other.commit(table.read())


def test_parts_are_added_and_made_one(spark, tmp_path):
    table = archive.Versioned(spark, f"file://{tmp_path}/t", "key string, n int", "key")
    table.MOST_PARTS = 3
    for i in range(6):
        table.add(spark.createDataFrame([("a", i), (f"k{i}", i)], "key string, n int"))
        assert sorted(map(tuple, table.read().collect())) == [("a", i), *((f"k{j}", j) for j in range(i + 1))]
    before = sorted(map(tuple, table.read().collect()))
    assert table.vacuum(1) > 0 and sorted(map(tuple, table.read().collect())) == before
    with pytest.raises(ValueError):
        archive.Versioned(spark, f"file://{tmp_path}/u", "key string").add(table.read())


def test_first_and_last_win(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, seq int")
    assert sorted(map(tuple, archive.first_wins(rows).collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, archive.last_wins(rows).collect())) == [("a", 2), ("b", 3)]
    seen = spark.createDataFrame([("b",)], "key string")
    assert [tuple(r) for r in archive.unseen(rows, seen).collect()] == [("a", 1)]


def test_issues(spark):
    part = "struct<filename:string,content_id:string,content:binary>"
    rows = spark.createDataFrame([("f", "s", datetime(2024, 1, 1), "p", [("a.png", "", b""), ("b", "", b"x")], "<img src='cid:gone@x'>"), ("f", "t", None, "q", [], "ok")], f"folder string, subject string, date timestamp, path string, attachments array<{part}>, html string")
    assert sorted((r.kind, r.detail) for r in archive.issues(rows).collect()) == [("empty-attachment", "a.png"), ("unresolved-inline-image", "gone@x")]


def test_listing_groups_split_folders(spark):
    docs = spark.createDataFrame([("A/2022-x.html",), ("A/2021/y.html",), ("A/2021-z.html",)], "path string")
    assert sorted((r.dir, r.total) for r in listing.folder_totals(docs).collect()) == [("A", 2), ("A/2021", 1)]
    assert [r.path for r in listing.folder_pages(docs, 1).where("dir = 'A'").collect()] == ["A/2022-x.html"]


def test_entry_names():
    assert entry_names(["a.txt", "a.txt", "a (1).txt", "b", "b"]) == ["a.txt", "a (1).txt", "a (1) (1).txt", "b", "b (1)"]


def test_names_of_parts_are_told_apart_in_order(spark):
    names = ["a.txt", "a (1).txt", "a.txt", "a.txt", "b", "b", ".x", ".x"]
    parts = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)] + [(2, 0, "a.txt")], "message int, i int, name string")
    found = {(r.message, r.i): r.entry for r in listing.duplicate_names(parts, "message", "name", "i").collect()}
    assert found == {(1, i): n for i, n in enumerate(entry_names(names))} | {(2, 0): "a.txt"}
    assert found[1, 2] == "a (2).txt"


def test_pages(spark, tmp_path):
    docs = spark.createDataFrame([("S/In/1.html", "A <b>", "Ann", "", 0, False), ("S/In/2 x.html", "", "", "", 86400, True), ("S/3.html", "c", "", "c@x", 0, False)], "path string, subject string, sender_name string, sender_email string, date long, has_attach boolean")
    assert {r.path for r in pages.write_pages(docs, f"file://{tmp_path}", most=1).collect()} == {"S/In/index.html", "S/index.html", "index.html"}
    page, root = (tmp_path / "S/In/index.html").read_text(), (tmp_path / "index.html").read_text()
    assert "2 messages, 1 older not listed" in page and 'href="2%20x.html"' in page and "2%20x-attachments.zip" in page and "(no subject)" in page and "../../index.html" in page
    assert root.index("S/index.html") < root.index("S/In/index.html")
    whole = {r.path: r.html for r in pages.folder_page_texts(docs).collect()}
    assert "A &lt;b&gt;" in whole["S/In/index.html"] and whole["S/In/index.html"].index("2 x") < whole["S/In/index.html"].index("1.html") if "2 x" in whole["S/In/index.html"] else True


def test_paging_and_column_order(spark):
    assert listing.pager(120, 0, 50) == {"previous": None, "next": 50} and listing.pager(120, 100, 50) == {"previous": 50, "next": None}
    rows = spark.createDataFrame([("b",), ("A",), ("a",), ("\u00e1",), ("C",)], "x string")
    assert [r.x.lower()[0] for r in listing.by_column(rows, "x").collect()] == ["a", "a", "\u00e1", "b", "c"]
    assert [r.x for r in listing.by_column(rows, "x", ascending=False).collect()][0] == "C"


def test_quiescence(spark):
    polls = spark.createDataFrame([("s", datetime(2024, 1, 1, 0, 0, t), n) for t, n in ((0, 1), (10, 1), (31, 1), (35, 2))] + [("s", datetime(2024, 1, 1, 0, 1, 10), 2)], "store string, ts timestamp, size int")
    assert [r.is_stable for r in quiescence.stable(polls).orderBy("ts").collect()] == [False, False, True, False, True]


def test_stream_equals_batch(spark):
    rows = spark.range(90).select(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")).alias("key"), F.col("id").alias("seq"), F.col("id").alias("event_id"))
    assert sorted(r.event_id for r in incremental.replay(rows, 3).collect()) == list(range(40))
