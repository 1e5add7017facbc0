"""The near-duplicate stage keeps exactly one row of each component, also where rows share a doc_id."""

import random
from collections import Counter

import corpus_pipeline


def test_rows_that_share_an_id(spark):
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    same_words = b.upper()
    rows = [(3, b, "en", "s", 1), (5, a, "en", "s", 1), (5, same_words, "en", "s", 1), (9, a, "en", "s", 1), (9, c, "de", "s", 1), (9, c, "de", "s", 1), (9, c, None, "s", 1), (None, d, None, None, None), (None, d.upper(), None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    seen = set()
    for parts in (1, 3, 7):
        out = [tuple(x) for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, schema).repartition(parts), "").collect()]
        assert Counter((x[0], x[1].lower()) for x in out) == Counter([(3, b), (5, a), (9, c), (None, d)])
        seen.add(frozenset(out))
    assert len(seen) == 1
