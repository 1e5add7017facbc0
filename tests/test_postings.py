"""Posting blocks and the text index: coding, phrases, bounds, tombstones, folding, and one commit for all."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.operators import blocks, postings, search
from postmill.operators.search import Query
from postmill.operators.snapshots import Conflict, Log, Table


def test_codes():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        v = np.concatenate([r.integers(0, 1 << int(k), n) for k in (1, 7, 8, 14, 21, 40, 62)])
        data, ends = blocks.coded(v)
        assert blocks.decoded(data).tolist() == v.tolist() and (ends[-1] if len(v) else 0) == len(data)
    assert blocks.summed(np.array([5, 1, 2, 7]), np.array([3, 0, 1])).tolist() == [5, 6, 8, 7]


def texts(n, seed=1, words=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    pick = lambda k: " ".join(vocabulary[min(int(r.expovariate(0.15)), words - 1)] for _ in range(k))
    return [(i, pick(r.randint(0, 3)), pick(r.randint(0, 30))) for i in range(n)]


def made(rows):
    lists = [pa.array([c.split() for c in col], pa.list_(pa.string())) for col in list(zip(*rows))[1:]]
    return blocks.Entries.inverted(np.array([r[0] for r in rows], np.int64), lists)


def zone(rows, phrases, gone=None):
    table = pa.Table.from_batches([made(rows[i : i + 50]).blocks() for i in range(0, len(rows), 50)])
    return blocks.Zone(table.filter(pa.compute.is_in(table["term"], pa.array(sorted({w for p in phrases for w in p})))), phrases, gone)


def count(row, phrase):
    return sum(own[i : i + len(phrase)] == phrase for c in row[1:] for own in [c.split()] for i in range(len(own)))


def brute(rows, phrases, weights, mean):
    out = {}
    for row in rows:
        tfs = [count(row, p) for p in phrases]
        if all(tfs):
            out[row[0]] = -sum(w * blocks.impact(tf, sum(len(c.split()) for c in row[1:]), mean) for w, tf in zip(weights, tfs))
    return out


PHRASES = [[["w0"]], [["w3"], ["w1"]], [["w0", "w0"]], [["w1", "w0", "w1"], ["w2"]], [["w20"]], [["none"]], [["w2"], ["none", "w1"]]]


@pytest.mark.parametrize("phrases", PHRASES)
def test_zone_against_brute_force(phrases):
    rows = texts(700)
    weights, mean = [1.3, 0.4][: len(phrases)], 17.0
    expected = brute(rows, phrases, weights, mean)
    docs, score = zone(rows, phrases).scores(weights, mean)
    assert dict(zip(docs.tolist(), score.tolist())) == pytest.approx(expected)
    assert zone(rows, phrases).counts() == [sum(count(r, p) > 0 for r in rows) for p in phrases]
    gone = np.arange(0, 700, 3)
    docs, score = zone(rows, phrases, gone).scores(weights, mean)
    assert dict(zip(docs.tolist(), score.tolist())) == pytest.approx({d: s for d, s in expected.items() if d % 3})
    for k in (1, 3, 20, 5000):
        docs, score = zone(rows, phrases).best(weights, mean, k)
        last = sorted(expected.values())[min(k, len(expected)) - 1] if expected else 0
        assert dict(zip(docs.tolist(), score.tolist())) == pytest.approx({d: s for d, s in expected.items() if s <= last + 1e-12})


def test_blocks_that_cannot_reach_the_page_are_skipped():
    # Few documents are good: short ones that have the word often.
    rows = [(i, "", "a " * 30 if i in (900, 2500) else "a " + "b " * 60) for i in range(5000)]
    whole, some = zone(rows, [["a"]]), zone(rows, [["a"]])
    docs, score = whole.scores([1.0], 50.0)
    best, values = some.best([1.0], 50.0, 2)
    assert sorted(best.tolist()) == [900, 2500] and sorted(values) == sorted(score)[:2]
    assert some.decoded <= 4 < some.n_blocks // 10 and whole.decoded == whole.n_blocks
    both, two = zone(rows, [["a"], ["b"]]), zone(rows, [["a"], ["b"]])
    assert len(both.best([1.0, 0.1], 50.0, 3)[0]) >= 3 and two.scores([1.0, 0.1], 50.0)[0].tolist()


def test_blocks_stay_in_zones_and_sizes():
    doc = np.array([0, 5, (1 << 16) - 1, 1 << 16, (1 << 33) + 3, *range(1 << 40, (1 << 40) + 300)])
    e = blocks.Entries.inverted(doc, [pa.array([["a", "b"]] * len(doc))])
    out = e.blocks()
    assert out["n"].to_pylist() == [3, 1, 1, 128, 128, 44] * 2 and out["first"].to_pylist()[:4] == [0, 1 << 16, (1 << 33) + 3, 1 << 40]
    back = blocks.Entries.of(out)
    assert back.doc.tolist() == doc.tolist() * 2 and back.places.tolist() == [0] * len(doc) + [1] * len(doc)
    shuffled = blocks.Entries.of(pa.Table.from_batches([out]).take(pa.array([5, 3, 1, 0, 2, 4]))).ordered()
    assert shuffled.doc.tolist() == doc.tolist() and blocks.Entries.inverted(doc[:0], [pa.array([], pa.list_(pa.string()))]).blocks().num_rows == 0


COLUMNS = ["subject", "body"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "f", "s", "e", r[0], False) for r in rows], "doc_id long, subject string, body string, folder string, sender_name string, sender_email string, date long, has_attach boolean")


def same(index, docs, query):
    a, b = ({r.doc_id: round(r.score, 9) for r in x.collect()} for x in (index.matches(docs, query), search.matches(docs, query, COLUMNS)))
    assert a == b
    key = lambda r: (r.doc_id, round(r.score, 9))
    assert [key(r) for r in index.page(docs, query).collect()] == [key(r) for r in search.paged(search.matches(docs, query, COLUMNS), query).collect()]
    assert index.total(docs, query).first().total == len(b)


def test_index_through_its_life(spark, tmp_path):
    rows = texts(400, seed=4)
    docs = table(spark, rows).repartition(3)
    index = postings.TextIndex(spark, str(tmp_path / "ix"), COLUMNS)
    queries = [Query(text=t, limit=n, offset=o) for t, n, o in (("w1-w0 w2", 20, 3), ("w30", 50, 0))]
    index.add(docs.where("doc_id < 250").withColumn("body", F.lit("w0 w0 old")))
    index.add(docs.where("doc_id < 100"))
    index.add(docs.where("doc_id >= 100"))
    for q in [*queries, Query(text="w0", limit=5), Query(text="absent")]:
        same(index, docs, q)
    left = docs.where("doc_id % 3 <> 1")
    index.delete(docs.where("doc_id % 3 = 1"))
    index.delete(docs.where("doc_id = 7"))
    assert sum(p["n"] for p in index.state()) == left.count() and len(index.state()) == 3
    for q in queries:
        same(index, left, q)
    before = {r.doc_id for r in index.live().collect()}
    index.compact()
    assert len(index.state()) == 1 and index.state()[0]["gone"] is None and {r.doc_id for r in index.live().collect()} == before
    assert sorted(r.doc for r in index.live().collect()) == list(range(len(before)))
    for q in queries:
        same(index, left, q)
    assert index.vacuum(1) > 0
    index.add(docs.where("doc_id % 3 = 1"))
    same(index, docs, queries[1])


def test_ties_at_the_end_of_a_page(spark, tmp_path):
    docs = table(spark, [(i, "", "same text") for i in range(50)] + [(99, "", "same")])
    index = postings.TextIndex(spark, str(tmp_path / "ix"), COLUMNS)
    index.add(docs)
    same(index, docs, Query(text="same", limit=4, offset=2))
    more, postings.MORE = postings.MORE, 5
    try:
        same(index, docs, Query(text="same", limit=4, offset=2))
    finally:
        postings.MORE = more


@pytest.mark.parametrize("slice_bytes", [postings.SLICE_BYTES, 2000])
def test_many_parts_are_folded(spark, tmp_path, monkeypatch, slice_bytes):
    monkeypatch.setattr(postings, "SLICE_BYTES", slice_bytes)
    rows = texts(60, seed=9)
    index = postings.TextIndex(spark, str(tmp_path / "ix"), COLUMNS)
    index.MOST_PARTS = 2
    for k in range(4):
        index.add(table(spark, [r for r in rows if r[0] % 4 == k]))
    assert len(index.state()) <= 2
    same(index, table(spark, rows), Query(text="w0 w1"))


def test_index_is_smaller_than_the_text(spark, tmp_path):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = [(i, "", " ".join(words[min(int(r.paretovariate(0.7)), 2999)] for _ in range(400))) for i in range(800)]
    index = postings.TextIndex(spark, str(tmp_path / "ix"), COLUMNS)
    index.add(table(spark, rows).coalesce(1))
    size = sum(f.stat().st_size for f in (tmp_path / "ix").rglob("*.parquet"))
    assert size < 0.6 * sum(len(x[2]) for x in rows)
    assert not list((tmp_path / "ix").glob("staged*"))


def test_a_search_reads_the_blocks_of_its_terms(spark, tmp_path):
    index = postings.TextIndex(spark, str(tmp_path / "ix"), COLUMNS)
    index.add(table(spark, texts(100)))
    plan = index.hits("w0 w1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "term" in plan and "documents-" not in plan and "Join" not in plan


# one log


def test_all_tables_change_at_once(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log")
    a, b = (Table(spark, f"file://{tmp_path}/{n}", "key string, n int", "key", log, n) for n in "ab")
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "key string, n int")
    log.commit(0, {"a": a.added(rows), "b": b.replaced(rows)})
    assert a.read().count() == b.read().count() == 2
    staged = a.added(spark.createDataFrame([("x", 9), ("z", 3)], "key string, n int"))
    assert {tuple(r) for r in a.read().collect()} == {("x", 1), ("y", 2)}
    base = log.version()
    log.commit(base, {"b": b.removed(rows.where("n = 1"))})
    with pytest.raises(Conflict):
        log.commit(base, {"a": staged})
    assert a.read().count() == 2 and b.read().count() == 1
    log.commit(log.version(), {"a": staged})
    assert {tuple(r) for r in a.read().collect()} == {("x", 9), ("y", 2), ("z", 3)} and b.read().count() == 1
    assert a.removed(spark.createDataFrame([("none",)], "key string")) == a.parts()
    # What no version names goes.
    a.added(rows)
    assert a.vacuum(1) >= 1 and a.read().count() == 3


def test_added_rows_need_no_shuffle_of_the_others(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "key string, n int", "key")
    for i in range(3):
        t.add(spark.createDataFrame([(f"k{i}", i)], "key string, n int"))
    assert "Exchange" not in t.read()._jdf.queryExecution().executedPlan().toString() and t.read().count() == 3


def test_adding_shuffles_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "b a"), (2, None, "")], "doc_id long, subject string, body string").withColumn("doc", F.monotonically_increasing_id())
    lists = rows.select("doc", "doc_id", F.split("subject", " ").alias("c0"), F.split("body", " ").alias("c1"))
    found = postings.inverted(lists, ["c0", "c1"], "doc_id").sortWithinPartitions("kind", "term", "first")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.length) for r in found.where("kind = 'documents'").collect()) == [(1, 3), (2, 1)]
    # Texts are read once, and nothing is staged: two folders of one write.
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    docs = table(spark, texts(50)).mapInArrow(counted, table(spark, texts(1)).schema)
    index = postings.TextIndex(spark, str(tmp_path / "ix"), COLUMNS)
    index.add(docs)
    assert reads.value == 50
    same(index, table(spark, texts(50)), Query(text="w1-w0 w2"))
    index.add(docs.where("false"))
    same(index, table(spark, texts(50)), Query(text="w0"))
    index.vacuum(1)
    same(index, table(spark, texts(50)), Query(text="w0"))
    empty = postings.TextIndex(spark, str(tmp_path / "empty"), COLUMNS)
    empty.add(docs.where("false"))
    assert empty.state()[0]["n"] == 0 and empty.ranked("w0").count() == 0
