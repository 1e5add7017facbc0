"""Rules are timed with the words that they share found beforehand."""

import pyarrow as pa

from postmill.llm import quality


def test_copies_share_what_is_known_and_no_more():
    first = quality.Measures(pa.array(["a b c a b c", None, "# # #"]))
    words = first.words
    own = first.copy()
    assert own.words is words and own.n_symbols.tolist() == [0, 0, 3]
    assert "n_symbols" not in first._known and first.copy().n_words.tolist() == [6, 0, 3]


def test_order_has_every_rule_once(spark):
    order = quality.rule_order(spark.createDataFrame([(f"w{i} " * 40,) for i in range(50)] + [(None,)], "text string"))
    assert sorted(order) == list(range(len(quality.RULES)))
    assert sorted(quality.rule_order(spark.createDataFrame([], "text string"))) == sorted(order)
