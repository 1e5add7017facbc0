"""Stateful streams: quiescence with timers, and mailboxes that grow into an archive."""

import random
import uuid
from datetime import datetime, timedelta

import pytest

from postmill.operators.search import parse_query
from postmill.pipeline import ArchiveOptions, State, find, run, watch
from postmill.streaming import quiescence

BEGIN = datetime(2024, 1, 1)


def polls_of(seed, n, stores="abc"):
    r, rows, size = random.Random(seed), [], {}
    for i in range(n):
        for s in stores:
            if s not in size or r.random() < 0.12:
                size[s] = size.get(s, 0) + r.randint(1, 9)
            rows.append((s, BEGIN + timedelta(seconds=3 * i), size[s]))
    return rows


def replayed(spark, home, chunks, **k):
    """settled() over chunks of polls that arrive one after the other, and the rows of state that are left."""
    schema = "store string, ts timestamp, size long"
    out = f"{home}/out-{uuid.uuid4().hex}"
    for chunk in chunks:
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(schema).parquet(f"{home}/in")
        q = quiescence.settled(stream, **k).writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(out)
        q.awaitTermination()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return sorted((r.store, r.since, r["size"]) for r in spark.read.schema("store string, since timestamp, size long").parquet(out).collect()), left


def quiet_of(spark, rows, seconds):
    """The same by stable(): the last change before each first poll at which a store is stable."""
    found = quiescence.stable(spark.createDataFrame(rows, "store string, ts timestamp, size long"), seconds=seconds).collect()
    out, since, size = set(), {}, {}
    for r in sorted(found, key=lambda r: (r.ts, r.store)):
        if size.get(r.store) != r["size"]:
            since[r.store], size[r.store] = r.ts, r["size"]
        if r.is_stable:
            out.add((r.store, since[r.store], r["size"]))
    return sorted(out)


def test_timers_agree_with_the_window(spark, tmp_path):
    rows = polls_of(3, 120)
    expected = quiet_of(spark, rows, 30)
    assert len(expected) > 5
    for i, cuts in enumerate(([len(rows)], [60, 61, 200, len(rows)])):
        chunks = [rows[a:b] for a, b in zip([0, *cuts], cuts)]
        found, left = replayed(spark, tmp_path / str(i), chunks, seconds=30)
        # What became quiet just before the last poll waits for the watermark.
        assert found == expected and left > 0


def test_a_store_that_nobody_polls_any_more(spark, tmp_path):
    gone = [("x", BEGIN, 5)]
    rows = [("y", BEGIN + timedelta(seconds=t), t) for t in range(0, 40, 10)]
    late = [("w", BEGIN + timedelta(seconds=4000), 1)]
    found, left = replayed(spark, tmp_path, [gone + rows, late, [("z", BEGIN + timedelta(seconds=9000), 1)], [("z", BEGIN + timedelta(seconds=20_000), 2)]], seconds=30, forget=600)
    assert ("x", BEGIN, 5) in found and ("y", BEGIN + timedelta(seconds=30), 30) in found and {f[0] for f in found} == set("xyzw")
    # Of all stores only the last has state: its rows and one timer (by key and by time).
    assert left <= 3


def test_stores_share_state_and_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quiescence, "BUCKETS", 2)
    big = (1 << 53) + 1
    rows = [(f"s{i}", BEGIN + timedelta(seconds=i % 7), big + i) for i in range(200)]
    found, left = replayed(spark, tmp_path, [rows, [("s3", BEGIN + timedelta(seconds=20), 1), ("none", BEGIN + timedelta(seconds=36), None)]], seconds=30)
    # All but s3, whose size changed, were quiet for 30 seconds at 36.
    assert found == sorted(r for r in rows if r[0] != "s3")
    # Two buckets with a value and a timer (by key and by time) each.
    assert left <= 6


def message(k, body="text"):
    return f"From a@x\nFrom: a@x.org\nSubject: s{k}\nMessage-ID: <{k}@x>\n\n{body} {k}\n\n".encode()


def test_mailboxes_that_grow_into_an_archive(spark, tmp_path):
    boxes = tmp_path / "Mail"
    (boxes / "Inbox.sbd").mkdir(parents=True)
    (boxes / "other").mkdir()
    (boxes / "Inbox").write_bytes(message(1) + message(2))
    (boxes / "other/Elsewhere").write_bytes(message(9))
    streamed = ArchiveOptions([str(boxes)], f"file://{tmp_path}/streamed")
    home = f"file://{tmp_path}/checkpoint"
    watch(spark, streamed, home).awaitTermination()
    with (boxes / "Inbox").open("ab") as f:
        f.write(message(3) + message(1))
    (boxes / "Inbox.sbd/Sub").write_bytes(message(4))
    watch(spark, streamed, home).awaitTermination()
    # Written anew: its messages come once more, the manifest knows those that it had.
    (boxes / "Inbox").write_bytes(message(5) + message(2))
    watch(spark, streamed, home).awaitTermination()
    watch(spark, streamed, home).awaitTermination()
    state = State(spark, streamed.output)
    assert state.log.version() == 3
    (boxes / "Inbox").write_bytes(b"".join(map(message, (1, 2, 3, 1, 5, 2))))
    batch = ArchiveOptions([str(boxes)], f"file://{tmp_path}/batch")
    run(spark, batch)
    columns = ["key", "folder", "subject", "path", "body"]
    rows = [sorted(map(tuple, State(spark, x.output).docs.read().select(*columns).collect())) for x in (streamed, batch)]
    assert rows[0] == rows[1] and [r[2] for r in rows[0]] == ["s1", "s2", "s3", "s5", "s4"]
    assert [r.subject for r in find(spark, streamed.output, parse_query("text 3")).collect()] == ["s3"]
    files = [sorted(p.relative_to(tmp_path / x).as_posix() for p in (tmp_path / x).rglob("*.html")) for x in ("streamed", "batch")]
    assert files[0] == files[1]
    with pytest.raises(ValueError):
        watch(spark, ArchiveOptions([], streamed.output), home)
