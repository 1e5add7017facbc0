"""Snippets against SQLite's full-text index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from postmill.functions import html as H

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "Été", "zoo", "x", "y1"]


@pytest.mark.parametrize("seed", range(4))
def test_same_window_as_a_full_text_index(seed):
    r, db = random.Random(seed), sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(a, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    seen = cut = 0
    for _ in range(2500):
        text = "  (" if r.random() < 0.2 else ""
        for _ in range(r.choice([3, 11, 12, 13, 14, 30, 80, 200])):
            text += r.choice(WORDS if r.random() < r.choice([0.1, 0.5]) else ["m", "n", "o", "p", "q"]) + r.choice([" ", " ", " ", ". ", ": ", ", ", "  ", ".\n", "-", "."])
        phrases = [[r.choice(WORDS[:8]).lower().replace("é", "e") for _ in range(r.choice([1, 1, 2]))] for _ in range(r.choice([1, 2, 3]))]
        db.execute("delete from t")
        db.execute("insert into t values (?)", (text,))
        found = db.execute("select snippet(t, 0, '<mark>', '</mark>', '… ', 12) from t where t match ?", (" ".join(f'"{" ".join(p)}"' for p in phrases),)).fetchone()
        if found:
            seen += 1
            own = H.best_window(text, phrases, escape=lambda x: x)
            cut += own.startswith("…")
            assert own == found[0]
    assert seen > 300 and cut > 50


def test_hits_far_apart(spark):
    body = "first alpha here. " + "filler " * 60 + "alpha and then beta <b> stand close. " + "filler " * 60
    found = spark.range(1).select(H.highlight(F.lit(body), [["alpha"], ["beta"]])).first()[0]
    assert "<mark>alpha</mark> and then <mark>beta</mark> &lt;b&gt;" in found and found.startswith("… ")
    assert H.best_window("no hit in a text of a few words. " * 5, [["none"]]).startswith("no hit in") and H.best_window("", [["a"]]) == "" and H.best_window("...", [["a"]]) == "..."
