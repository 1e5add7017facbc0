"""The mbox data source: bytes, ranges, order, filters and streams."""

import mailbox
import random
import re
from datetime import datetime, timezone
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from postmill.operators.archive import first_wins
from postmill.pipeline import keyed
from postmill.sources import mbox
from postmill.sources.mailbox import read_mailbox, register


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def box_of(path, n, seed=1, create=True):
    """n generated messages, some with lines that look like separators, by the standard library."""
    r, box = random.Random(seed), mailbox.mbox(str(path), create=create)
    for i in range(n):
        kind = r.choice(["utf-8", "iso-8859-1", "koi8-r", "binary"])
        m = EmailMessage()
        m["From"], m["Subject"], m["Message-ID"] = "a@x.org", f"s{seed}-{i}", f"<{seed}-{i}@x>"
        lines = [r.choice(["From the start", ">From here", "", "Fromage", "caf\xe9 ф" if kind == "utf-8" else "caf\xe9" if kind == "iso-8859-1" else "ф" if kind == "koi8-r" else "x", "y" * r.randint(0, 300)]) for _ in range(r.randint(0, 12))]
        if kind == "binary":
            m.set_content(bytes(r.randrange(256) for _ in range(200)), "application", "octet-stream", filename="b.bin")
        else:
            m.set_content("\n".join(lines) + "\n", charset=kind, cte="8bit")
        box.add(m)
    box.flush()
    return box


def source(spark, path, size=1 << 20):
    register(spark)
    return spark.read.format("mbox").option("rangeBytes", size).load(str(path))


def test_agrees_with_the_standard_library(spark, tmp_path):
    box = box_of(tmp_path / "box", 1000)
    expected = [re.sub(rb"(?m)^>(>*From )", rb"\1", box.get_bytes(k)) for k in box.iterkeys()]
    for size in (1 << 30, 5000, 777):
        rows = source(spark, tmp_path / "box", size).orderBy("offset").collect()
        assert [bytes(r.data) for r in rows] == expected
    whole = (tmp_path / "box").read_bytes()
    assert all(whole[r.offset : r.offset + 5] == b"From " for r in rows) and {r.path for r in rows} == {f"file://{tmp_path}/box"}


def test_message_across_ranges_is_read_once(tmp_path):
    put(tmp_path / "m", b"From a\nS: 1\n\nabc\n\nFrom b\nS: 2\n\nFromage\n>From x\n\nFrom c\n\nlast")
    whole = (tmp_path / "m").read_bytes()
    marks = [0, *(m.start() + 1 for m in re.finditer(b"\nFrom ", whole))]
    expected = [(a, whole[a:b]) for a, b in zip(marks, [*marks[1:], len(whole)])]
    for size in range(1, len(whole) + 2):
        for step in (1, 3, 100):
            found = []
            for part in mbox.dealt([mbox.Range(f"file://{tmp_path}/m", 0, len(whole), len(whole))], size):
                for own in part.ranges:
                    with mbox.opened(own.path) as f:
                        found += mbox.split(f, own, step)
            assert found == expected
    assert [mbox.unpacked(d) for _, d in expected] == [b"S: 1\n\nabc\n", b"S: 2\n\nFromage\nFrom x\n", b"\nlast"]
    assert mbox.unpacked(b"From a\r\nS: 1\r\n\r\nx\r\n\r\n") == b"S: 1\r\n\r\nx\r\n" and mbox.unpacked(b"From a") == b""


def test_nothing_after_the_limit_is_read(tmp_path):
    data = b"From a\nS: 1\n\nabc\n\nFrom b\nS: 2\n\nlater"
    put(tmp_path / "m", data)
    with mbox.opened(f"file://{tmp_path}/m") as f:
        assert list(mbox.split(f, mbox.Range("", 0, 18, 18))) == [(0, data[:18])]
        assert list(mbox.split(f, mbox.Range("", 0, 10_000, 10_000))) == [(0, data[:18]), (18, data[18:])]


CHARSETS = [("iso-8859-1", "8bit", "caf\xe9"), ("koi8-r", "8bit", "письмо"), ("shift_jis", "8bit", "日本語"), ("utf-8", "8bit", "日本 caf\xe9"), ("iso-8859-1", "quoted-printable", "caf\xe9")]


def test_charsets_survive(spark, tmp_path):
    data = b""
    for i, (charset, cte, text) in enumerate(CHARSETS):
        m = EmailMessage()
        m["Subject"] = f"s{i}"
        m.set_content(text + "\n", charset=charset, cte=cte)
        data += b"From a@x Mon Jan  1 00:00:00 2024\n" + m.as_bytes() + b"\n"
    data += b"From a@x\nSubject: none\n\nna\xefve \x93quoted\x94\n\n"
    for name in ("plain", "_hidden", "sp ace+%41"):
        put(tmp_path / "Mail" / name, data)
        found = {r.subject: r.plain_body.strip() for r in read_mailbox(spark, str(tmp_path / "Mail" / name)).collect()}
        assert found == {f"s{i}": text for i, (_, _, text) in enumerate(CHARSETS)} | {"none": "na\xefve “quoted”"}


def test_attachments_survive(spark, tmp_path):
    raw = bytes(range(256)) * 40
    m = EmailMessage()
    m["Subject"] = "x"
    m.set_content("t")
    m.add_attachment(raw, maintype="application", subtype="x", filename="ä.bin", cte="base64")
    put(tmp_path / "m", b"From a@x\n" + m.as_bytes() + b"\n")
    part = read_mailbox(spark, str(tmp_path / "m"), range_bytes=100).first().attachments[0]
    assert bytes(part.content) == raw and part.filename == "ä.bin"


def test_options_leave_out_files_and_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("A", "B", "C"):
        box_of(tmp_path / "in" / name, 5, seed=ord(name))
    df, a = source(spark, tmp_path / "in", 200), f"file://{tmp_path}/in/A"
    # Queries over one DataFrame don't share their filters.
    assert (df.count(), df.where(F.col("path") == a).count(), df.where("path = 'x'").count(), df.count()) == (15, 5, 0, 15)
    own = lambda **k: spark.read.format("mbox").options(rangeBytes=200, **k).load(str(tmp_path / "in"))
    one = own(pathPrefix=a)
    offsets = sorted(r.offset for r in one.collect())
    assert len(offsets) == 5 and one.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    assert sorted(r.offset for r in own(pathPrefix=a, fromOffset=offsets[2]).collect()) == offsets[2:]
    assert sorted(r.offset for r in own(pathPrefix=a, fromOffset=offsets[2] + 1).collect()) == offsets[3:]


def test_scan_order_is_that_of_a_walk(spark, tmp_path):
    one = lambda s: f"From a@x\nSubject: {s}\nMessage-ID: <same>\n\n{s}\n\n".encode()
    put(tmp_path / "M/Inbox", one("1") + one("2"))
    put(tmp_path / "M/Inbox.sbd/Sub", one("3"))
    put(tmp_path / "M/Inbox-old", one("4"))
    put(tmp_path / "M/Post/cur/a", b"Subject: 6\n\nlonger " + b"x" * 5000)
    put(tmp_path / "M/Post/new/b", b"Subject: 5\n\nx")
    rows = keyed(read_mailbox(spark, str(tmp_path / "M"), range_bytes=20))
    assert [r.subject for r in rows.repartition(7).orderBy("seq").collect()] == ["1", "2", "3", "4", "5", "6"]
    put(tmp_path / "D/cur/a", b"Message-ID: <q>\nSubject: cur\n\n" + b"x" * 9000)
    put(tmp_path / "D/new/z", b"Message-ID: <q>\nSubject: new\n\nx")
    for parts in (1, 5):
        assert [r.subject for r in first_wins(keyed(read_mailbox(spark, str(tmp_path / "D"))).repartition(parts)).collect()] == ["new"]


# streams


def taken(spark, home, folder, size=300):
    """What a run of the stream gives, and all that it gave."""
    register(spark)
    out = f"{home}/out"
    before = {tuple(r) for r in spark.read.parquet(out).collect()} if (home / "out").exists() else set()
    arrivals = spark.readStream.format("mbox").option("rangeBytes", size).load(str(folder))
    arrivals.writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    now = [tuple(r) for r in spark.read.parquet(out).collect()] if (home / "out").exists() else []
    return [r for r in now if r not in before], now


def test_stream_gives_new_messages_of_files_that_grow(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    box_of(folder / "A", 20)
    box_of(folder / "B", 3, seed=2)
    first, _ = taken(spark, tmp_path, folder)
    assert len(first) == 23 and taken(spark, tmp_path, folder)[0] == []
    box_of(folder / "A", 7, seed=3, create=False)
    box_of(folder / "C", 2, seed=4)
    new, every = taken(spark, tmp_path, folder)
    assert len(new) == 9 and sorted(every) == sorted(tuple(r) for r in source(spark, folder).collect())
    # Written anew: shorter, longer with another begin, and longer by more of the last message.
    put(folder / "A", b"From n\nSubject: again\n\nx\n\n")
    put(folder / "B", b"From n\nSubject: other\n\n" + b"x\n" * 3000 + b"\nFrom n\nSubject: second\n\ny\n\n")
    with (folder / "C").open("ab") as f:
        f.write(b"more of the last\n\n")
    new, _ = taken(spark, tmp_path, folder)
    assert sum(b"again" in r[2] or b"other" in r[2] or b"second" in r[2] for r in new) == 3 and any(b"more of the last" in r[2] for r in new)
    (folder / "A").unlink()
    assert taken(spark, tmp_path, folder)[0] == []


def test_fields_of_a_message(spark, tmp_path):
    put(tmp_path / "m", b"From a@x\nFrom: Ann <a@x>\nDate: Mon, 1 Jan 2024 10:00:00 +0200\nSubject: =?iso-8859-1?q?caf=E9?=\n\nx\n")
    r = read_mailbox(spark, str(tmp_path / "m")).first()
    assert (r.subject, r.sender_name, r.file, r.offset) == ("caf\xe9", "Ann", "m", 0) and r.received == datetime(2024, 1, 1, 8, tzinfo=timezone.utc).replace(tzinfo=None)


def test_unknown_paths(spark, tmp_path):
    with pytest.raises(Exception, match="no/such"):
        source(spark, tmp_path / "no/such").count()
