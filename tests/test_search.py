import sqlite3

import pytest
from pyspark.sql import functions as F

from postmill.operators import postings, search
from postmill.operators.search import Query, parse_query, phrases

COLUMNS = ["subject", "folder", "body"]
ROWS = [
    (1, "invoice for july", "Inbox/Clients", "please pay the invoice unique-alpha today", "Bob", "bob@x.org", 1751500800, True),
    (2, "lunch", "Inbox", "shared plans and Zürich", "Carol", "carol@x.org", 1749427200, False),
    (3, "old invoice", "Archive", "shared old news, alpha unique", "Bob", "bob@x.org", 1548979200, False),
    (4, "", "Archive/2021", "", "", "", 0, False),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, subject string, folder string, body string, sender_name string, sender_email string, date long, has_attach boolean")


def ids(df):
    return [r.doc_id for r in df.collect()]


def found(docs, **k):
    q = Query(**k)
    return ids(search.paged(search.matches(docs, q, COLUMNS), q))


def test_terms_and_phrases(docs):
    assert sorted(found(docs, text="invoice")) == [1, 3]
    assert found(docs, text="invoice unique-alpha") == [1]
    assert sorted(found(docs, text="alpha shared")) == [3]
    assert found(docs, text="zurich") == [2]
    assert found(docs, text="july inbox") == [1]


def test_filters(docs):
    assert sorted(found(docs, sender="BOB")) == [1, 3]
    assert found(docs, has_attach=True) == [1]
    assert found(docs, folder="inbox") == [1]
    assert sorted(found(docs, folder="Inbox")) == [1, 2]
    assert found(docs, after=parse_query("after:2025-01-01").after, sender="bob") == [1]
    assert 4 in found(docs, before=parse_query("before:2000-01-01").before)


def test_browse_facets_and_pages(docs):
    assert found(docs) == [1, 2, 3, 4]
    assert found(docs, limit=2, offset=2) == [3, 4]
    assert [r.year for r in search.years(docs).collect()] == [2025, 2019]
    assert [(r.folder, r["count"]) for r in search.folder_facet(docs).collect()] == [("Archive", 1), ("Archive/2021", 1), ("Inbox", 1), ("Inbox/Clients", 1)]


@pytest.mark.parametrize("text", ["report OR 1", '"', "NEAR(a b)", "report AND (", "*", 'report"', "foo: bar", 'a"b"c', "%", "\\"])
def test_operators_are_plain_text(docs, text):
    found(docs, text=text)


def test_punctuation_alone_finds_nothing(docs):
    assert found(docs, text="* --") == []


def test_inline_tokens():
    q = parse_query("from:bob folder:Inbox after:2025-01 has:attachment invoice", limit=999)
    assert (q.sender, q.folder, q.after, q.has_attach, q.text, q.limit) == ("bob", "Inbox", None, True, "invoice", 200)
    assert parse_query("before:2020-01-01", year=2024).before.year == 2025


def test_ranks_like_a_full_text_index(docs):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(subject, folder, body, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    db.executemany("insert into t(rowid, subject, folder, body) values (?, ?, ?, ?)", [r[:4] for r in ROWS])
    for text in ("invoice", "shared", "old invoice", "unique-alpha", "the"):
        expected = db.execute("select rowid, bm25(t) from t where t match ? order by 2, 1", [" ".join(f'"{w}"' for w in text.split())]).fetchall()
        own = sorted((r.score, r.doc_id) for r in search.matches(docs, Query(text=text), COLUMNS).collect())
        assert [i for _, i in own] == [i for i, _ in expected]
        assert [s for s, _ in own] == pytest.approx([s for _, s in expected], abs=1e-6)


def test_index_gives_the_same_rows(spark, docs, tmp_path):
    index = postings.TextIndex(spark, str(tmp_path / "ix"), COLUMNS)
    with pytest.raises(ValueError):
        index.ranked("x")
    half = docs.where("doc_id % 2 = 0")
    index.add(docs.withColumn("body", F.lit("invoice of old")))
    index.add(half)
    index.add(docs.exceptAll(half))
    for q in (Query(text="invoice"), Query(text="unique-alpha invoice"), Query(text="old-news shared"), Query(text="the the"), Query(text="* --"), Query(folder="Inbox"), Query(text="invoice", folder="Inbox")):
        a, b = ({r.doc_id: round(r.score, 9) if q.text else 0 for r in x.collect()} for x in (index.matches(docs, q), search.matches(docs, q, COLUMNS)))
        assert a == b
    # Documents that went no longer count, before and after the parts are one.
    q = Query(text="invoice")
    index.delete(docs.exceptAll(half).unionByName(docs.limit(1).withColumn("doc_id", F.lit(999).cast("long"))))
    for _ in range(2):
        assert {r.doc_id: round(r.score, 9) for r in index.matches(half, q).collect()} == {r.doc_id: round(r.score, 9) for r in search.matches(half, q, COLUMNS).collect()}
        assert index.live().count() == half.count()
        index.compact()


def test_snippet_and_total(docs):
    page, total = search.search(docs, Query(text="invoice"), COLUMNS)
    assert "<mark>invoice</mark>" in {r.doc_id: r.snippet for r in page.collect()}[1] and total.first().total == 2
