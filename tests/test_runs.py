"""Archive runs: one commit for all tables, sources that fail, full mode, and pages after reconciling."""

from postmill import pipeline
from postmill.operators.search import parse_query
from postmill.operators.snapshots import Log
from postmill.pipeline import ArchiveOptions, State, find, find_page, reconcile, run


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def one(subject, body="text", mid=None):
    return f"From a@x\nFrom: a@x.org\nSubject: {subject}\nMessage-ID: <{mid or subject}@x>\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\n{body}\n\n".encode()


def contents(spark, output):
    state = State(spark, output)
    return (sorted(r.key for r in state.seen.read().collect()), sorted(r.key for r in state.docs.read().collect()), sorted(r.key for r in state.text.live().collect()) if state.text.state() else [])


STEPS = ["text.added", "docs.added", "seen.added", "commit"]


def test_a_run_that_breaks_off_leaves_all_or_nothing(spark, tmp_path, monkeypatch):
    put(tmp_path / "in/Inbox", one("a"))
    options = ArchiveOptions([str(tmp_path / "in")], f"file://{tmp_path}/out")
    assert run(spark, options)["exported"] == 1
    before = contents(spark, options.output)
    assert before[0] == before[1] == before[2] and len(before[0]) == 1
    put(tmp_path / "in/Inbox", one("a") + one("b"))

    def broken(*a, **k):
        raise OSError("the disk is full")

    for step in STEPS:
        with monkeypatch.context() as m:
            name, _, method = step.partition(".")
            kind = Log if step == "commit" else type(getattr(State(spark, options.output), name))
            own = getattr(kind, method or step)
            m.setattr(kind, method or step, lambda self, *a, own=own, name=name, step=step, **k: broken() if step == "commit" or self.name == name else own(self, *a, **k))
            failed = run(spark, options)
        assert failed["failed"] == 1 and "disk is full" in failed["errors"][0] and failed["exported"] == 0
        assert contents(spark, options.output) == before, step
    assert run(spark, options)["exported"] == 1
    after = contents(spark, options.output)
    assert after[0] == after[1] == after[2] and len(after[0]) == 2
    # What was written before the steps that failed is named by no version.
    assert State(spark, options.output).vacuum(1) >= len(STEPS) and contents(spark, options.output) == after
    assert not list((tmp_path / "out/.state").glob("scan-*"))


def test_one_source_that_fails_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    for name in "ABC":
        put(tmp_path / "in" / name / "cur/1", one(name).partition(b"\n")[2])
    own = pipeline.read_mailbox
    monkeypatch.setattr(pipeline, "read_mailbox", lambda spark, path: own(spark, path if not path.endswith("/B") else "file:///no/such", "maildir"))
    options = ArchiveOptions([f"{tmp_path}/in/{n}" for n in "ABC"], f"file://{tmp_path}/out")
    figures = run(spark, options)
    assert (figures["failed"], figures["exported"], len(figures["errors"])) == (1, 2, 1) and "/B" in figures["errors"][0]
    monkeypatch.undo()
    again = run(spark, options)
    assert (again["failed"], again["exported"], again["skipped_seen"]) == (0, 1, 2)


def test_full_writes_every_occurrence_and_keeps_the_last(spark, tmp_path):
    put(tmp_path / "in/Inbox", one("first", "early words", "m") + one("second", "late words", "m") + one("other"))
    options = ArchiveOptions([str(tmp_path / "in")], f"file://{tmp_path}/out")
    figures = run(spark, options)
    assert (figures["exported"], figures["skipped_seen"]) == (2, 1) and [r.subject for r in find(spark, options.output, parse_query("words")).collect()] == ["first"]
    figures = run(spark, ArchiveOptions(options.inputs, options.output, full=True))
    assert (figures["exported"], figures["skipped_seen"], figures["scanned"]) == (3, 0, 3)
    assert [r.subject for r in find(spark, options.output, parse_query("words")).collect()] == ["second"]
    assert len(list((tmp_path / "out/in/Inbox").glob("2024*.html"))) == 3
    assert all(len(x) == 2 for x in contents(spark, options.output))


def test_pages_after_reconciling(spark, tmp_path):
    put(tmp_path / "in/Inbox", one("kept") + one("lost"))
    put(tmp_path / "in/Old", one("gone"))
    options = ArchiveOptions([str(tmp_path / "in")], f"file://{tmp_path}/out")
    run(spark, options)
    out = tmp_path / "out/in"
    assert "lost" in (out / "Inbox/index.html").read_text() and (out / "Old/index.html").exists()
    for name in ("Inbox/*lost*.html", "Old/2024*.html"):
        next(out.glob(name)).unlink()
    assert reconcile(spark, options.output) == {"kept": 1, "pruned": 2}
    page = (out / "Inbox/index.html").read_text()
    assert "kept" in page and "lost" not in page and not (out / "Old/index.html").exists() and "in/Old" not in (tmp_path / "out/index.html").read_text()
    assert all(len(x) == 1 for x in contents(spark, options.output))
    page, total = find_page(spark, options.output, parse_query("text"))
    assert [r.subject for r in page.collect()] == ["kept"] and total.first().total == 1
    assert reconcile(spark, options.output) == {"kept": 1, "pruned": 0}
