"""Quality rules as a short-circuit cascade.

Each rule is a predicate over the texts of a batch that are still in play. On a bounded sample the cost and the
rejection rate of every rule are measured; the cascade runs the rules by rejection per cost, and a rule sees only
what the ones before it left. The order changes the work, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import SPACE, U64, Texts, hash_runs, mix, slices, windows

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Rows on which costs and rejection are measured.
SAMPLE_ROWS = 2000


class Measures:
    """What rules ask of a batch of texts; each is computed when first asked for."""

    def __init__(self, column: pa.Array):
        self.texts = Texts(column)
        self._known: dict = {}

    def of(self, rows: np.ndarray, column: pa.Array) -> Measures:
        """The measures of some rows (column: their texts); the counts that are known already are carried along."""
        out = Measures(column)
        out._known = {k: v[rows] for k, v in self._known.items() if k.startswith("n_") or k == "word_chars"}
        return out

    def copy(self) -> Measures:
        """The same texts with what is known of them; what is computed later is the copy's alone."""
        out = Measures.__new__(Measures)
        out.texts, out._known = self.texts, dict(self._known)
        return out

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = getattr(type(self), f"_get_{name}")(self)
        return self._known[name]

    def _get_inside(self):
        return ~SPACE[self.texts.bytes]

    def _get_words(self):
        starts, ends = self.texts.runs(self.inside)
        return starts, ends, self.texts.docs_of(starts)

    def _get_word_hashes(self):
        return hash_runs(self.texts.bytes, *self.words[:2])

    def _get_n_echoes(self):
        """Words equal to the word before."""
        docs, h = self.words[2], self.word_hashes
        same = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
        return np.bincount(docs[1:][same], minlength=self.texts.n)

    def _get_n_words(self):
        return np.bincount(self.words[2], minlength=self.texts.n)

    def _get_word_chars(self):
        return self.texts.per_text(self.inside & ((self.texts.bytes & 0xC0) != 0x80))

    def _get_n_symbols(self):
        return self.texts.per_text(SYMBOLS[self.texts.bytes])

    def _get_n_letters(self):
        return self.texts.per_text(LETTERS[self.texts.bytes] & ((self.texts.bytes & 0xC0) != 0x80))

    def _get_lines(self):
        """The texts of the lines with a word, and their hashes."""
        starts, ends = self.texts.runs(self.texts.bytes != 10)
        total = np.zeros(len(self.inside) + 1, dtype=np.int64)
        np.cumsum(self.inside, out=total[1:])
        some = total[ends] > total[starts]
        starts, ends = starts[some], ends[some]
        return self.texts.docs_of(starts), hash_runs(self.texts.bytes, starts, ends)

    def _get_n_lines(self):
        return np.bincount(self.lines[0], minlength=self.texts.n)

    def _get_n_dup_lines(self):
        docs, h = self.lines
        _, first = np.unique(mix(h + docs.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
        return self.n_lines - np.bincount(docs[first], minlength=self.texts.n)

    def _get_n_repeat_words(self):
        docs = self.words[2]
        h, at = windows(self.word_hashes, docs, 5)
        keys = mix(h + docs[at].astype(U64) * U64(0xD6E8FEB86659FD93))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            return np.zeros(self.texts.n, dtype=np.int64)
        spot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        at = at[twice[spot] == keys]
        change = np.zeros(len(docs) + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + 5, -1)
        return np.bincount(docs[np.cumsum(change[:-1]) > 0], minlength=self.texts.n)


@dataclass(frozen=True)
class Rule:
    """A named predicate; True for a text that it rejects."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


def _rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m.n_words < 10),
        Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
        Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
        Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
        Rule("word_length", lambda m: (m.word_chars > 15 * m.n_words) | (m.word_chars < 2 * m.n_words)),
        Rule("letters", lambda m: 4 * m.n_letters < m.word_chars),
        Rule("echoes", lambda m: 10 * m.n_echoes > 4 * m.n_words),
    ]


#: The first two are what the measures call base_failed.
RULES = _rules()


def _text(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def cascade(column: pa.Array, order: list[int], known: Measures | None = None) -> np.ndarray:
    """Which texts no rule rejects; each rule reads only the texts that the rules before it left."""
    kept, measures = np.arange(len(column)), known or Measures(column)
    for k in order:
        if not len(kept):
            break
        good = np.flatnonzero(~RULES[k].rejects(measures))
        if len(good) < len(kept):
            kept = kept[good]
            measures = measures.of(good, column.take(pa.array(kept)))
    out = np.zeros(len(column), dtype=bool)
    out[kept] = True
    return out


def rule_order(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """Rules by rejection per second, measured on at most sample_rows texts; the verdict does not depend on it.

    Words are found once for all rules, so they are in no rule's cost; what only some rules share is in each one's.
    """
    names = [r.name for r in RULES]

    def measured(batches):
        for batch in slices(batches, text):
            column = _text(batch, text)
            words = Measures(column)
            words.n_words
            for k, rule in enumerate(RULES):
                own = words.copy()
                began = time.perf_counter()
                out = rule.rejects(own)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "n": pa.array([len(column)], pa.int64()), "bad": pa.array([int(out.sum())], pa.int64()), "s": [time.perf_counter() - began]})

    share = min(1.0, 2.0 * sample_rows / max(1, df.count()))
    some = df.select(F.col(text)).where(F.col(text).isNotNull()).sample(share, seed=7).limit(sample_rows)
    seen = {r.k: r for r in some.mapInArrow(measured, "k long, n long, bad long, s double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("s").alias("s")).collect()}
    gain = lambda k: (seen[k].bad + 0.5) / (seen[k].n + 1) / max(seen[k].s / max(1, seen[k].n), 1e-9) if k in seen else 0.0
    return sorted(range(len(names)), key=lambda k: (-gain(k), k))


def keep_good(df: DataFrame, text: str = "text", order: list[int] | None = None) -> DataFrame:
    """The rows of df whose text no rule rejects, with all their columns.

    A null or empty text has no words and goes. Equal texts share their verdict; an empty table stays empty.
    """
    order = rule_order(df, text) if order is None else order

    def filtered(batches):
        for batch in slices(batches, text):
            yield batch.filter(pa.array(cascade(_text(batch, text), order)))

    return df.mapInArrow(filtered, df.schema)


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality(df: DataFrame, order: list[int] | None = None) -> DataFrame:
    """One row per document (doc_id, text): the measures, base_failed and the cascade's verdict.

    A null or empty text has no words, so it fails; null ids stay null; rows that repeat have a row each and share
    their verdict; an empty table gives no rows; texts of any length are measured whole, and further columns of df are
    not read.
    """
    order = rule_order(df) if order is None else order
    rest = [k for k in order if k > 1]

    def scored(batches):
        for batch in slices(batches, "text"):
            column = _text(batch, "text")
            m = Measures(column)
            failed = (m.n_words < 10) | (100 * m.n_repeat_words > 20 * m.n_words)
            kept = np.zeros(len(column), dtype=bool)
            left = np.flatnonzero(~failed)
            some = column.take(pa.array(left))
            kept[left] = cascade(some, rest, m.of(left, some))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(np.asarray(getattr(m, c), dtype=np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, SCORED)
