"""Posting blocks: coding, inversion and evaluation, over NumPy arrays inside tasks.

A block has up to BLOCK documents of one term within one zone (a range of document numbers): their numbers, how often
and where each has the term, and their lengths, all as variable-length integers of differences. Its largest frequency
and smallest length bound the score of any document in it, whatever the corpus' mean length is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

BLOCK, ZONE_BITS = 128, 16
#: Places are col << COL_BITS | pos.
COL_BITS = 32
FIELDS = "term string, first long, n int, tf_max long, len_min long, docs binary, tfs binary, lens binary, places binary"
NAMES = [c.split()[0] for c in FIELDS.split(", ")]
K1, B = 1.2, 0.75


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values, none negative, as bytes of seven bits with a continuation bit, and where each one's bytes end."""
    v = np.asarray(values, dtype=np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, dtype=np.uint8)
    start = ends - size
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        out[start[live] + k] = ((v[live] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[live] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def decoded(data: np.ndarray) -> np.ndarray:
    """The values of coded() bytes."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(data < 128)
    start = np.append(0, last[:-1] + 1)
    shift = np.arange(len(data)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), start).astype(np.int64)


def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew after each of counts values."""
    if not len(values):
        return values
    total = np.cumsum(values)
    start = np.cumsum(counts) - counts
    own = counts > 0
    return total - np.repeat(total[start[own]] - values[start[own]], counts[own])


def bytes_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All bytes of a binary column in a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=np.uint8)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]


class Entries:
    """Postings as flat arrays, one entry for each document of a term, by term and document: term (an index), doc, tf, len; places of all entries in a row."""

    def __init__(self, terms: pa.Array, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, places: np.ndarray):
        self.terms, self.term, self.doc, self.tf, self.length, self.places = terms, term, doc, tf, length, places

    @classmethod
    def inverted(cls, doc: np.ndarray, columns: list[pa.Array]) -> Entries:
        """The postings of documents with these numbers, whose columns are lists of tokens."""
        rank = np.empty(len(doc), dtype=np.int64)
        order = np.argsort(doc, kind="stable")
        rank[order] = np.arange(len(doc))
        words, owners, places, length = [], [], [], np.zeros(len(doc), dtype=np.int64)
        for i, c in enumerate(columns):
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(c), 0)).astype(np.int64)
            words.append(c.flatten())
            owners.append(np.repeat(rank, n))
            places.append((i << COL_BITS) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            length += n
        coded_words = pa.concat_arrays(words).dictionary_encode()
        code = np.asarray(coded_words.indices).astype(np.int64)
        owner, place = np.concatenate(owners), np.concatenate(places)
        # The tokens of a document stand in the order of its columns, which a stable sort keeps.
        key = code * max(1, len(doc)) + owner
        by = np.argsort(key, kind="stable")
        key = key[by]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.append(start, len(key)))
        at = owner[by][start]
        return cls(coded_words.dictionary, code[by][start], doc[order][at], tf, length[order][at], place[by])

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, places: bool = True) -> Entries:
        """The postings of blocks, those of a term in a row."""
        column = table["term"].combine_chunks() if isinstance(table["term"], pa.ChunkedArray) else table["term"]
        terms = column.dictionary_encode()
        n = np.asarray(table["n"]).astype(np.int64)
        doc = summed(decoded(bytes_of(table["docs"])), n) + np.repeat(np.asarray(table["first"]).astype(np.int64), n)
        tf, length = decoded(bytes_of(table["tfs"])), decoded(bytes_of(table["lens"]))
        spots = summed(decoded(bytes_of(table["places"])), tf) if places else np.zeros(0, np.int64)
        return cls(terms.dictionary, np.repeat(np.asarray(terms.indices).astype(np.int64), n), doc, tf, length, spots)

    def kept(self, keep: np.ndarray) -> Entries:
        return Entries(self.terms, self.term[keep], self.doc[keep], self.tf[keep], self.length[keep], self.places[np.repeat(keep, self.tf)] if len(self.places) else self.places)

    def ordered(self) -> Entries:
        """By term and document."""
        by = np.lexsort((self.doc, self.term))
        start = (np.cumsum(self.tf) - self.tf)[by]
        tf = self.tf[by]
        spots = np.repeat(start - (np.cumsum(tf) - tf), tf) + np.arange(tf.sum())
        return Entries(self.terms, self.term[by], self.doc[by], tf, self.length[by], self.places[spots])

    def blocks(self) -> pa.RecordBatch:
        """The entries, which are in order, as blocks."""
        n = len(self.term)
        if not n:
            return pa.RecordBatch.from_pylist([], pa.schema(dict(zip(NAMES, [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]))))
        new = np.append(True, (self.term[1:] != self.term[:-1]) | (self.doc[1:] >> ZONE_BITS != self.doc[:-1] >> ZONE_BITS))
        run = np.flatnonzero(new)
        within = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
        start = np.flatnonzero(within % BLOCK == 0)
        ends = np.append(start[1:], n)
        step = np.diff(self.doc, prepend=0)
        step[start] = 0
        first = np.cumsum(self.tf) - self.tf
        spot = np.diff(self.places, prepend=0)
        spot[first] = self.places[first]
        upto = np.cumsum(self.tf)

        def binary(values: np.ndarray, cut: np.ndarray) -> pa.Array:
            data, at = coded(values)
            offsets = np.append(0, at[cut - 1]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

        largest, least = np.maximum.reduceat(self.tf, start), np.minimum.reduceat(self.length, start)
        columns = [self.terms.take(pa.array(self.term[start])), pa.array(self.doc[start], pa.int64()), pa.array(ends - start, pa.int32()), pa.array(largest, pa.int64()), pa.array(least, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, binary(step, ends), binary(self.tf, ends), binary(self.length, ends), binary(spot, upto[ends - 1])], names=NAMES)


def impact(tf, length, mean: float):
    """The part of BM25 that a document's frequency and length make."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))


class Zone:
    """The blocks of a query's terms in one zone, and the documents there that no longer count."""

    def __init__(self, table: pa.Table, phrases: list[list[str]], gone: np.ndarray | None = None):
        self.phrases = phrases
        self.gone = np.zeros(0, np.int64) if gone is None else gone
        table = table.sort_by([("term", "ascending"), ("first", "ascending")])
        self.terms = {w: table.filter(pa.compute.equal(table["term"], w)) for w in {w for p in phrases for w in p}}
        #: Blocks that were decoded, of those that there are.
        self.decoded, self.n_blocks = 0, table.num_rows

    def _entries(self, term: str, picked: np.ndarray | None = None) -> Entries:
        own = self.terms[term]
        own = own if picked is None else own.take(pa.array(picked))
        self.decoded += own.num_rows
        return Entries.of(own, any(term in p for p in self.phrases if len(p) > 1))

    def _hits(self, phrase: list[str], found: dict[str, Entries]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with the phrase, how often they have it, and their lengths."""
        first = found[phrase[0]]
        if len(phrase) == 1:
            docs, tf, length = first.doc, first.tf, first.length
        else:
            base = int(min((found[w].doc.min() for w in phrase if len(found[w].doc)), default=0))
            spots = None
            for i, w in enumerate(phrase):
                e = found[w]
                # Zone number, column and position in one number; a shift past a column's begin leaves no match.
                col, pos = e.places >> COL_BITS, (e.places & ((1 << COL_BITS) - 1)) - i
                ok = pos >= 0
                own = (np.repeat(e.doc - base, e.tf) << 40 | col << COL_BITS | pos)[ok]
                spots = own if spots is None else np.intersect1d(spots, own, assume_unique=True)
            at, tf = np.unique(spots >> 40, return_counts=True)
            docs, length = at + base, first.length[np.searchsorted(first.doc, at + base)]
        if len(self.gone) and len(docs):
            live = ~np.isin(docs, self.gone)
            docs, tf, length = docs[live], tf[live], length[live]
        return docs, tf, length

    def counts(self) -> list[int]:
        """How many documents have each phrase."""
        found = {w: self._entries(w) for w in self.terms}
        return [len(self._hits(p, found)[0]) for p in self.phrases]

    def _scored(self, found: dict[str, Entries], weights: list[float], mean: float) -> tuple[np.ndarray, np.ndarray]:
        docs = score = None
        for phrase, weight in zip(self.phrases, weights):
            own, tf, length = self._hits(phrase, found)
            part = weight * impact(tf.astype(np.float64), length, mean)
            if docs is None:
                docs, score = own, part
            else:
                docs, a, b = np.intersect1d(docs, own, assume_unique=True, return_indices=True)
                score = score[a] + part[b]
        return docs, -score

    def scores(self, weights: list[float], mean: float) -> tuple[np.ndarray, np.ndarray]:
        """All documents with all phrases, and their scores: the lower the better."""
        return self._scored({w: self._entries(w) for w in self.terms}, weights, mean)

    def best(self, weights: list[float], mean: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents, and those that are as good as the last of them.

        Blocks of the rarest term are taken by their bound, the best first, until no block left can hold a document
        as good as the k-th that was found.
        """
        if any(not t.num_rows for t in self.terms.values()):
            return np.zeros(0, np.int64), np.zeros(0)
        lead = min(self.terms, key=lambda w: (int(np.asarray(self.terms[w]["n"]).sum()), w))
        firsts = {w: np.asarray(t["first"]) for w, t in self.terms.items()}
        tops = {w: impact(np.asarray(t["tf_max"]).astype(np.float64), np.asarray(t["len_min"]), mean) for w, t in self.terms.items()}
        begin = firsts[lead]
        end = np.append(begin[1:], np.int64(1) << 62)
        # The blocks of each term that overlap a block of the lead.
        lo = {w: np.maximum(np.searchsorted(f, begin, side="right") - 1, 0) for w, f in firsts.items()}
        hi = {w: np.searchsorted(f, end, side="left") for w, f in firsts.items()}
        most = {w: np.array([tops[w][a:b].max(initial=0.0) for a, b in zip(lo[w], hi[w])]) for w in self.terms}
        bound = sum(weight * np.min([most[w] for w in phrase], axis=0) for phrase, weight in zip(self.phrases, weights))
        order = np.argsort(-bound, kind="stable")
        docs, score, limit, at, step = np.zeros(0, np.int64), np.zeros(0), np.inf, 0, 1
        while at < len(order):
            some = np.sort(order[at : at + step][-bound[order[at : at + step]] <= limit + 1e-9])
            if not len(some):
                break
            found = {lead: self._entries(lead, some)}
            for w in self.terms:
                if w != lead:
                    found[w] = self._entries(w, np.unique(np.concatenate([np.arange(lo[w][i], hi[w][i]) for i in some])))
            own, value = self._scored(found, weights, mean)
            docs, score = np.append(docs, own), np.append(score, value)
            if len(score) >= k:
                limit = np.partition(score, k - 1)[k - 1]
                docs, score = docs[score <= limit], score[score <= limit]
            at, step = at + step, step * 2
        return docs, score
