import mailbox
from email.message import EmailMessage

import pytest

from postmill.operators.search import parse_query
from postmill.pipeline import ArchiveOptions, find, reconcile, run
from postmill.sources import mime
from postmill.sources.mailbox import UnsupportedMailbox, detect, discover, is_mailbox, read_mailbox, read_mailboxes

MBOX = (
    b"From a@x Mon Jan 01 00:00:00 2024\r\nFrom: Ann Lee <ann@x.org>\r\nTo: Bo Li <bo@x.org>\r\nSubject: First\r\nDate: Mon, 01 Jan 2024 10:00:00 +0100\r\n"
    b"Message-ID: <one@x.org>\r\nContent-Type: text/html\r\n\r\n<p>hello</p>\r\n\r\nFrom b@x Tue Jan 02 00:00:00 2024\r\nFrom: cy@x.org\r\nSubject: Second\r\n\r\nplain\r\n>From here\r\n"
)


def raw(subject, body="text"):
    return f"From: a@x.org\r\nSubject: {subject}\r\nMessage-ID: <{subject}@x>\r\n\r\n{body}\r\n".encode()


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def rows(df):
    return {r.subject: r for r in df.collect()}


def test_mbox_file(spark, tmp_path):
    put(tmp_path / "TestBox", MBOX)
    found = rows(read_mailbox(spark, str(tmp_path / "TestBox")))
    a, b = found["First"], found["Second"]
    assert (a.store, a.folder_path, a.sender_name, a.sender_email, a.to, a.internet_message_id) == ("TestBox", [], "Ann Lee", "ann@x.org", "Bo Li <bo@x.org>", "one@x.org")
    assert a.html_body.strip() == "<p>hello</p>" and a.received.isoformat() == "2024-01-01T09:00:00"
    assert b.plain_body.replace("\r", "") == "plain\nFrom here\n"
    assert a.html_body.endswith("</p>\r\n") or "\r" not in a.html_body


def test_names_that_readers_pass_over(spark, tmp_path):
    put(tmp_path / "Mail/_Kept", MBOX)
    put(tmp_path / "Mail/Inbox.sbd/_Old", MBOX)
    put(tmp_path / "Mail/plain/Sub", MBOX)
    found = read_mailbox(spark, str(tmp_path / "Mail")).collect()
    assert sorted((r.folder_path, r.subject) for r in found) == [(f, s) for f in (["Inbox", "_Old"], ["_Kept"]) for s in ("First", "Second")]
    assert set(rows(read_mailbox(spark, str(tmp_path / "Mail/_Kept")))) == {"First", "Second"}
    for size in (1, 7, 60, 200, 10_000):
        assert sorted(r.subject for r in read_mailbox(spark, str(tmp_path / "Mail/_Kept"), range_bytes=size).collect()) == ["First", "Second"]


def test_tree_of_mboxes(spark, tmp_path):
    put(tmp_path / "Mail/Inbox", MBOX)
    put(tmp_path / "Mail/Inbox.sbd/Sub", MBOX)
    put(tmp_path / "Mail/Inbox.msf", b"From index")
    put(tmp_path / "Mail/notes.txt", b"no mailbox")
    found = read_mailbox(spark, str(tmp_path / "Mail")).collect()
    assert sorted(r.folder_path for r in found) == [["Inbox"], ["Inbox"], ["Inbox", "Sub"], ["Inbox", "Sub"]]


def test_large_mbox_is_split(spark, tmp_path):
    box = mailbox.mbox(str(tmp_path / "big"))
    for i in range(300):
        m = EmailMessage()
        m["From"], m["Subject"] = "a@x.org", f"s{i}"
        m.set_content("From the start\n" + "x" * 500)
        box.add(m)
    box.flush()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_mailbox(spark, str(tmp_path / "big"))
        assert df.rdd.getNumPartitions() > 4 and sorted(r.subject for r in df.collect()) == sorted(f"s{i}" for i in range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_maildir(spark, tmp_path):
    put(tmp_path / "M/cur/1", raw("a"))
    put(tmp_path / "M/new/04/2", raw("b"))
    put(tmp_path / "M/tmp/3", raw("c"))
    assert detect(spark, str(tmp_path / "M")) == "maildir"
    assert set(rows(read_mailbox(spark, str(tmp_path / "M")))) == {"a", "b"}


def test_maildir_plus_plus(spark, tmp_path):
    root = tmp_path / "local"
    for name, subject in (("cur", "root"), (".Garden/cur", "w"), (".Garden.Roses/new", "p"), (".mail_2Eexample_2Enet.Drafts/cur", "i"), ("._2E_2E_2Fabove/cur", "e")):
        put(root / name / "1", raw(subject))
    put(root / "..maildir++", b"")
    put(root / ".Garden.cmeta", b"")
    assert detect(spark, str(root)) == "maildir++"
    found = {k: r.folder_path for k, r in rows(read_mailbox(spark, str(root))).items()}
    assert found["root"] == [] and found["w"] == ["Garden"] and found["p"] == ["Garden", "Roses"] and found["i"] == ["mail.example.net", "Drafts"]
    assert all("/" not in s and ".." not in s for s in found["e"])


def test_imap_cache(spark, tmp_path):
    root = tmp_path / "acct"
    for name in ("Post/cur/x", "Post/new/x", "Post/cur/08/912", "Kept/cur/a", "Kept/subfolders/Old/cur/b", "Web/subfolders/Any/cur/c"):
        put(root / "folders" / name, raw(name.replace("/", "-")))
    assert detect(spark, str(root)) == "imap-cache"
    assert sorted(r.folder_path for r in read_mailbox(spark, str(root)).collect()) == [["Kept"], ["Kept", "Old"], ["Post"], ["Post"], ["Post"], ["Web", "Any"]]


def test_stores_of_a_mail_client_are_called_by_their_account(spark, tmp_path):
    for uid in ("a1b2", "c3", "d4"):
        put(tmp_path / uid / "folders/In/cur/1", raw("x"))
    put(tmp_path / "sources/a1b2.source", b"[Data Source]\nDisplayName= Ann's post \nEnabled=true\n")
    put(tmp_path / "sources/c3.source", b"[Data Source]\nDisplayName=\n")
    put(tmp_path / "local/cur/1", raw("y"))
    put(tmp_path / "local/.Sub/cur/1", raw("z"))
    put(tmp_path / "local/..maildir++", b"")
    stores = {x: {r.store for r in read_mailbox(spark, str(tmp_path / x), sources=str(tmp_path / "sources")).collect()} for x in ("a1b2", "c3", "d4", "local")}
    assert stores == {"a1b2": {"Ann's post"}, "c3": {"Evolution c3"}, "d4": {"Evolution d4"}, "local": {"On This Computer"}}
    assert read_mailbox(spark, str(tmp_path / "a1b2")).first().store == "Evolution a1b2"


def test_unknown_files_are_refused(spark, tmp_path):
    put(tmp_path / "x.pst", b"!BDN")
    put(tmp_path / "x.txt", b"hello")
    for name in ("x.pst", "x.txt"):
        with pytest.raises(UnsupportedMailbox):
            detect(spark, str(tmp_path / name))


@pytest.mark.parametrize("data", [None, b"", b"Subject: x\r\n", b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nbroken", bytes(range(256)) * 4, b"A" * 200_000, b"Content-Transfer-Encoding: base64\r\n\r\n!!!!", "Subject: é\r\n\r\nü".encode("cp1252")])
def test_broken_messages_keep_a_row(data):
    assert set(mime.parse(data)) == set(mime.FIELDS)


def test_attachments():
    m = EmailMessage()
    m["Subject"] = "x"
    m.set_content("plain")
    m.add_alternative("<img src='cid:i@x'>", subtype="html")
    m.add_attachment(b"data", maintype="application", subtype="pdf", filename="a.pdf")
    row = mime.parse(m.as_bytes())
    assert row["plain_body"].strip() == "plain" and [a["filename"] for a in row["attachments"]] == ["a.pdf"] and row["attachments"][0]["size"] == 4


def test_archive_life_cycle(spark, tmp_path):
    put(tmp_path / "in/Inbox", MBOX)
    options = ArchiveOptions([str(tmp_path / "in")], f"file://{tmp_path}/out")
    first, second = run(spark, options), run(spark, options)
    assert (first["exported"], second["exported"], second["skipped_seen"]) == (2, 0, 2)
    assert (first["non_html"], first["no_body"], first["attachments"]) == (1, 0, 0)
    assert [r.subject for r in find(spark, options.output, parse_query("plain here")).collect()] == ["Second"]
    assert run(spark, ArchiveOptions(options.inputs, options.output, full=True))["exported"] == 2
    pages = sorted((tmp_path / "out/in/Inbox").glob("0*.html")) + sorted((tmp_path / "out/in/Inbox").glob("2*.html"))
    assert len(pages) == 2
    pages[0].unlink()
    assert reconcile(spark, options.output) == {"kept": 1, "pruned": 1}
    assert find(spark, options.output, parse_query("hello")).count() + find(spark, options.output, parse_query("plain")).count() == 1
    assert run(spark, options)["exported"] == 1


def test_sources_are_committed_one_by_one(spark, tmp_path):
    for name in ("A", "B"):
        put(tmp_path / "in" / name / "cur" / "1", raw(f"s{name}"))
        put(tmp_path / "in" / name / "cur" / "2", raw("both"))
    options = ArchiveOptions([f"{tmp_path}/in/A", f"{tmp_path}/in/B"], f"file://{tmp_path}/out")
    first = run(spark, options)
    assert (first["scanned"], first["exported"], first["skipped_seen"]) == (4, 3, 1)
    assert run(spark, options)["exported"] == 0
    assert {r.subject for r in find(spark, options.output, parse_query("text")).collect()} == {"sA", "sB", "both"}


def test_several_stores_once_each(spark, tmp_path):
    put(tmp_path / "A", MBOX)
    assert read_mailboxes(spark, [str(tmp_path / "A")] * 2).count() == 2
    assert read_mailboxes(spark, []).count() == 0
    put(tmp_path / "M/cur/1", raw("a"))
    put(tmp_path / "notes", b"none")
    assert read_mailboxes(spark, [str(tmp_path / "A"), str(tmp_path / "M/../A"), f"file://{tmp_path}/A"]).count() == 2


def test_discovery(spark, tmp_path):
    put(tmp_path / "in/A", MBOX)
    put(tmp_path / "stores/one/cur/1", raw("a"))
    put(tmp_path / "stores/two/Inbox.sbd/B", MBOX)
    put(tmp_path / "stores/none/notes.txt", b"none")
    put(tmp_path / "text/notes.txt", b"none")
    assert is_mailbox(spark, str(tmp_path / "in")) and not is_mailbox(spark, str(tmp_path / "text"))
    put(tmp_path / "deep/stores/x/y/z", b"none")
    found = [x.rpartition(str(tmp_path))[2] for x in discover(spark, [str(tmp_path / "in"), str(tmp_path / "stores"), str(tmp_path / "in")])]
    assert found == ["/in", "/stores"] or found == ["/in", "/stores/one", "/stores/two"]
    with pytest.raises(UnsupportedMailbox):
        discover(spark, [str(tmp_path / "text")])


def test_headers_are_parsed_once():
    import email
    import email.policy

    from postmill.sources import mime

    mime._kept.cache_clear()
    data = b"From: =?utf-8?q?J=C3=B6?= <a@x.org>\nTo: b@x, c <d@x>\nSubject: =?utf-8?b?w7Y=?=\nContent-Type: text/plain; charset=latin-1\n\n\xf6\n"
    rows = [mime.parse(data.replace(b"a@x", b"%d@x" % i)) for i in range(3)]
    assert [r["sender_email"] for r in rows] == ["0@x.org", "1@x.org", "2@x.org"] and {(r["sender_name"], r["subject"], r["plain_body"], r["to"]) for r in rows} == {("J\u00f6", "\u00f6", "\u00f6\n", "b@x, c <d@x>")}
    # Three senders, and one each of the other headers.
    assert mime._kept.cache_info().misses <= 6 < mime._kept.cache_info().hits
    long = "s" * (mime.KEPT_CHARS + 1)
    before = mime._kept.cache_info().currsize
    assert str(mime._header("Subject", long)) == str(email.policy.default.header_factory("Subject", long)) and mime._kept.cache_info().currsize == before
