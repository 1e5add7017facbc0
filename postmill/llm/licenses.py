"""License scans by patience alignment.

A template is aligned with a stretch of a document: words that occur once in both are anchors, their longest
increasing subsequence is kept, and the gaps between kept anchors are aligned the same way. Coverage is the share
of the template's words that the alignment matches. Stretches are the places where a template's words stand close
together: any word of the template begins one. All stretches count. Those that cannot reach the threshold, or beat the
best one found, by the words they share or by the longest common subsequence with the template, which no alignment
exceeds, are left out of the alignment.

A name that tells a license apart (as "GNU General Public License" or "version 3") must stand unbroken in what is
matched, and a template of few words must stand there whole, since one word more or less makes another license of it.
Where licenses overlap the one that matches most words counts, and the others are sought in the rest of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import Texts, hash_runs, slices
from postmill.llm.decontaminate import WORD_BYTES
from postmill.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
#: A stretch has at most so many times the template's words: what is spread wider is no copy of it.
SPREAD = 4
#: Templates of fewer words must be found whole and unbroken.
WHOLE_BELOW = 20
#: What of a template is a name: capitalised words that end in License, and version numbers.
NAME = r"(?:[A-Z][\w-]*\s+){1,5}License\b|\b[Vv]ersion\s+\d+(?:\.\d+)*"
FOUND = "doc_id long, license string, coverage double, n_matched long, first_word long, last_word long"


def _rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1], at[k : k + 1] = [p], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text word, template word) pairs, rising in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        kept = [anchors[i] for i in _rising([x for x, _ in anchors])]
        if kept:
            out += kept
            edges = [(a - 1, c - 1), *kept, (b, d)]
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(out)


def _word_lists(texts: list[str]) -> list[list[int]]:
    """The word hashes of each text."""
    h, docs, _ = words_of(Texts(pa.compute.utf8_lower(pa.array(texts, pa.string()))))
    return [h[docs == i].tolist() for i in range(len(texts))]


class Templates:
    """The templates as word hashes; their number and size are fixed, so they go to every task."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = _word_lists(list(templates.values()))
        h, docs = np.array([x for own in self.words for x in own], dtype=np.uint64), np.repeat(np.arange(len(self.names)), [len(x) for x in self.words])
        #: For each template its names, as the places of each one's occurrences.
        self.titles = []
        for own, text in zip(self.words, templates.values()):
            titles = {tuple(x) for x in _word_lists(sorted(set(re.findall(NAME, text))))}
            self.titles.append([[range(i, i + len(x)) for i in range(len(own) - len(x) + 1) if tuple(own[i : i + len(x)]) == x] for x in sorted(titles)])
        distinct = [np.unique(h[docs == i], return_counts=True) for i in range(len(self.names))]
        self.sets, self.times = [d[0] for d in distinct], [d[1] for d in distinct]
        self.vocabulary = np.unique(h)


def words_of(texts: Texts):
    starts, ends = texts.runs(WORD_BYTES[texts.bytes])
    docs = texts.docs_of(starts)
    return hash_runs(texts.bytes, starts, ends), docs, np.searchsorted(docs, np.arange(texts.n + 1))


def _within(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[np.minimum(np.searchsorted(values, h), len(values) - 1)] == h


def _shared_words(words: np.ndarray, at: np.ndarray, docs: np.ndarray, own: np.ndarray, times: np.ndarray, width: int) -> np.ndarray:
    """For each hit how many of the template's words (own, so often as times says) the stretch of width from it has.

    A hit counts for the starts from which fewer hits of its word lie before it than the template has of that word.
    """
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    name = np.searchsorted(own, words)
    order = np.lexsort((at, name, docs))
    place, most = np.arange(n), times[name[order]]
    first = np.flatnonzero(np.append(True, (name[order][1:] != name[order][:-1]) | (docs[order][1:] != docs[order][:-1])))
    start = np.repeat(first, np.diff(np.append(first, n)))
    before = place - most
    # The start after the hit, so many of its word back, that would be one too many.
    floor = np.full(n, 0)
    floor[order] = np.where(before >= start, order[np.maximum(before, 0)] + 1, 0)
    reach = np.maximum(floor, np.maximum(np.searchsorted(at, at - width, side="right"), np.searchsorted(docs, docs)))
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, reach, 1)
    change[1:] -= 1
    return np.cumsum(change[:-1])


def common_lengths(text: list[int], template: list[int]) -> list[int]:
    """For each word of text the length of the longest common subsequence of the template and text from that word on.

    Bits of one integer hold where the length rises along the template, taken from its end; each word updates all of
    them at once.
    """
    spots: dict[int, int] = {}
    for i, w in enumerate(reversed(template)):
        spots[w] = spots.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    rises, out = full, [0] * len(text)
    for i in range(len(text) - 1, -1, -1):
        if own := spots.get(text[i]):
            met = rises & own
            rises = (rises + met | rises - met) & full
        out[i] = len(template) - rises.bit_count()
    return out


def _titled(pairs: list[tuple[int, int]], titles: list[list[range]]) -> bool:
    """Whether each of the template's names stands unbroken in the matched words."""
    at = {j: i for i, j in pairs}
    return all(any(all(j in at and at[j] - at[own[0]] == j - own[0] for j in own) for own in places) for places in titles)


def best_stretch(words: np.ndarray, templates: Templates, t: int, threshold: float, spread: int, whole_below: int) -> tuple[int, int, int] | None:
    """(matched words, first word, last word) of a text's best stretch for a template, the first of equally good ones."""
    own = templates.words[t]
    size, width = len(own), spread * len(own)
    if size < whole_below:
        at = np.flatnonzero(words[: len(words) - size + 1] == np.uint64(own[0])) if len(words) >= size else np.zeros(0, np.int64)
        for k in range(1, size):
            at = at[words[at + k] == np.uint64(own[k])]
        return (size, int(at[0]), int(at[0]) + size - 1) if len(at) else None
    need = threshold * size - 1e-9
    hits = np.flatnonzero(_within(words, templates.sets[t])) if len(words) else np.zeros(0, np.int64)
    shared = _shared_words(words[hits], hits, np.zeros(len(hits), np.int64), templates.sets[t], templates.times[t], width)
    starts = hits[shared >= need]
    # Runs of starts share one pass for their bounds, to the end of the last one's stretch.
    run, bound = max(1, width // 4), {}
    for _, mine in _grouped(starts, run):
        lo, hi = int(mine[0]), int(mine[-1]) + width
        lengths = common_lengths(words[lo:hi].tolist(), own)
        bound.update((int(i), lengths[int(i) - lo]) for i in mine)
    best = None
    for i in sorted((i for i, n in bound.items() if n >= need), key=lambda i: (-bound[i], i)):
        worse = lambda n: n < need or (best and (n < best[0] or (n == best[0] and i > best[3])))  # noqa: B023, E731
        if best and bound[i] < best[0]:
            break
        text = words[i : i + width].tolist()
        if worse(bound[i]) or worse(common_lengths(text, own)[0]):
            continue
        pairs = align(text, own)
        if pairs and not worse(len(pairs)) and _titled(pairs, templates.titles[t]):
            best = (len(pairs), i + pairs[0][0], i + pairs[-1][0], i)
    return best[:3] if best else None


def _grouped(starts: np.ndarray, run: int):
    part = starts // run
    for k in np.unique(part).tolist():
        yield k, starts[part == k]


def licenses_of(words: np.ndarray, among: list[int], templates: Templates, threshold: float, spread: int, whole_below: int) -> dict[int, tuple[int, int, int]]:
    """The best stretch of each template among those given that a text has, none of them overlapping another."""
    seek = lambda t: best_stretch(words, templates, t, threshold, spread, whole_below)
    words, left, out = words.copy(), {t: seek(t) for t in among}, {}
    while left := {t: v for t, v in left.items() if v}:
        t = min(left, key=lambda t: (-left[t][0], -left[t][0] / len(templates.words[t]), t))
        n, a, b = out[t] = left.pop(t)
        words[a : b + 1] = 0
        left = {x: v if v[1] > b or v[2] < a else seek(x) for x, v in left.items()}
    return out


def scan(column: pa.Array, templates: Templates, threshold: float = THRESHOLD, spread: int = SPREAD, whole_below: int = WHOLE_BELOW) -> list[tuple[int, int, int, int, int]]:
    """(text, template, matched words, first word, last word) of the licenses found in each text."""
    h, docs, begin = words_of(Texts(pa.compute.utf8_lower(column)))
    among: dict[int, list[int]] = {}
    known = np.flatnonzero(_within(h, templates.vocabulary)) if len(h) and len(templates.vocabulary) else []
    for t, own in enumerate(templates.sets):
        size = len(templates.words[t])
        need = threshold * size - 1e-9
        if not size or len(known) < need:
            continue
        hits = known[_within(h[known], own)]
        shared = _shared_words(h[hits], hits, docs[hits], own, templates.times[t], spread * size)
        for d in np.unique(docs[hits[shared >= need]]).tolist():
            among.setdefault(d, []).append(t)
    found = {d: licenses_of(h[begin[d] : begin[d + 1]], own, templates, threshold, spread, whole_below) for d, own in among.items()}
    return sorted((d, t, *v) for d, own in found.items() for t, v in own.items())


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, spread: int = SPREAD, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """One row per document (doc_id, text) and license whose coverage is the threshold or more.

    coverage is that of the best stretch in which the template's names stand unbroken; a template of fewer words than
    whole_below must stand there whole. Licenses of a document don't overlap. first_word and last_word count the document's words (letters and digits)
    from 0. Words are compared in lower case. A stretch starts at one of the template's words and has at most spread
    times as many; of equally good ones the first counts. A null or empty text has no row, rows that repeat have their
    rows again, further columns are not read, an empty table gives none, and texts of any length are scanned whole.
    Templates are the caller's own list and go to every task.
    """
    sent = df.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    def run(batches):
        own = sent.value
        for batch in slices(batches, "text"):
            found = scan(batch.column(1), own, threshold, spread, whole_below)
            d, t, n, a, b = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(d, pa.int64())), pa.array([own.names[x] for x in t], pa.string()), pa.array([x / len(own.words[y]) for x, y in zip(n, t)], pa.float64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                names=["doc_id", "license", "coverage", "n_matched", "first_word", "last_word"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
