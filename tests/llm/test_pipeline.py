from pathlib import Path

import pytest

import corpus_pipeline
from postmill.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_stages_filter_their_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == first, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(kept) <= ids and kept, name
        if name != "mixing":
            assert len(kept) == len(set(kept)), name
        docs = out.checkpoint()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert last.count() == docs.count()


def test_stages_take_odd_rows(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    good = "the quick brown fox jumps over a lazy dog while many other animals look on"
    rows = [(None, good, None, None, None), (None, good, None, None, None), (1, None, None, None, None), (2, good + " today", "en", "s", 3), (2, good + " today", "en", "s", 3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(DATA))
        docs.collect()


def test_stages_take_further_columns_of_any_name_and_type(spark):
    words = "the quick brown fox jumps over a lazy dog while many other animals look on and of the".split()
    text = lambda i: " ".join(f"{w}{i}{k}" if k % 3 else w for k, w in enumerate(words))
    long = " ".join(f"word{i}" if i % 4 else "the" for i in range(150_000))
    rows = [(i, text(i), "en", f"s{i % 2}", 1, f"own{i}", i, "row", {"b": i, "a": 1}, [{"x": i}], b"fp") for i in range(30)]
    rows += [(100, text(3), "en", "s1", 1, "copy", 1, "row", {"a": 1}, [], b"fp"), (101, long, None, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, own string, tag int, `row` string, shard map<string,int>, size array<map<string,int>>, fp binary"
    docs, kept = spark.createDataFrame(rows, schema).repartition(3), {r[0]: r for r in rows if r[0] != 100}
    plain = lambda r: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        found = [plain(r) for r in out.collect()]
        if name == "quality rules":
            assert len(found) == 32
        elif name == "mixing":
            assert {r[0] for r in found} <= set(kept) and all(r == kept[r[0]] for r in found)
        else:
            assert sorted(found, key=lambda r: r[0]) == [kept[i] for i in sorted(kept)], name
        docs = out.checkpoint()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert last.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and last.count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_whole_tables(spark, name):
    out = queries.QUERIES[name](spark, str(DATA))
    if name.split("_")[0] not in ("op2", "op3"):
        assert out.count() == spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op5') else 'documents'}.parquet").count()
    else:
        assert out.count() > 0 or name.startswith("op2")
