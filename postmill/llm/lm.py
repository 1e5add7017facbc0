"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Texts are packed into blocks (see blocks.py). Each block sends its distinct n-grams to buckets by their hash. A bucket
adds up their counts and puts those of two words and more into its own segment of the filter: an n-gram of count c is
inserted once for each level 1 to 1 + log_b(c). A probe asks for levels 1, 2, ... until one is missing, and the last one
found gives the count back within a factor of b. Counts of single words stay exact, as the add-one base score asks for
them; they go back to the blocks that asked.

Where a filter can't have more than Sizes.broadcast bytes it is broadcast to the workers. As it grows with the texts, a
larger one stays where it is built: the blocks then send the n-grams of held-out texts too, with a count of 0, and each
bucket probes its segment once for every n-gram that it was sent and gives the levels back. The probes are the same, with
the same result.

N-grams of two and more words count from min_count occurrences on, MIN_COUNT unless given.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.blocks import BLOCK_BYTES, NOTES, TABLE_BYTES, BlockTexts, noted, notes_of, per_block, table_of_blocks
from postmill.llm.common import ASCII_LOWER, SPACE, U64, Texts, equal_runs, hash_runs, mix, released, stored

ORDER, LAMBDA, LOG_BASE, MIN_COUNT = 3, 0.6, 1.5, 2
PROBES = 5
START, END = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)
#: Bits below those that name a bucket by which n-grams of two words and more are told apart there.
NAME_BITS = 40
#: N-grams that are probed at once, and the compression of what is sent.
PROBED, ZSTD = 1 << 18, pa.Codec("zstd", 1)
SENT = "bucket int, block long, n int, keys binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Sizes:
    """How work is cut; no result depends on it but for bits, the filter's bits for each n-gram and level."""

    block: int = BLOCK_BYTES
    table: int = TABLE_BYTES
    #: Text whose n-grams share a bucket, on average.
    bucket: int = 16 << 20
    #: Most bytes that a filter may come to if it is to be broadcast, and buckets that are broadcast as one object.
    broadcast: int = 192 << 20
    piece: int = 4
    bits: int = 8


class Tokens:
    """Hashes of START, the lower-cased words and END of each text, one text after another."""

    def __init__(self, texts: Texts):
        data = ASCII_LOWER[texts.bytes]
        starts, ends = texts.runs(~SPACE[texts.bytes])
        docs = texts.docs_of(starts)
        n = np.bincount(docs, minlength=texts.n)
        self.begin = np.zeros(texts.n + 1, dtype=np.int64)
        np.cumsum(n + 2, out=self.begin[1:])
        self.h = np.empty(self.begin[-1], dtype=U64)
        self.h[self.begin[:-1]] = START
        self.h[self.begin[1:] - 1] = END
        self.h[np.arange(len(docs)) + 2 * docs + 1] = hash_runs(data, starts, ends)
        self.first = np.zeros(len(self.h), dtype=bool)
        self.first[self.begin[:-1]] = True
        self.n_tokens = n + 1
        self.doc = np.repeat(np.arange(texts.n), n + 2)

    def grams(self):
        """For each order the keys of the n-grams that end at each token; a text's first ones begin with START.

        Where a text has too few tokens before a place the key is that of the longest n-gram there is, which is
        why places is True only where the n-gram is of that order.
        """
        own, places = self.h, np.ones(len(self.h), dtype=bool)
        yield mix(own ^ U64(1)), places
        for k in range(2, ORDER + 1):
            before = np.concatenate([own[:1], own[:-1]])
            places = places & ~self.first & np.concatenate([[False], places[:-1]])
            own = mix(before * U64(0x9E3779B97F4A7C15) + self.h)
            yield mix(own ^ U64(k)), places


def _positions(keys: np.ndarray, level: np.ndarray | int, probe: int, n_bits) -> np.ndarray:
    g = mix(keys + U64(0xD6E8FEB86659FD93) * np.asarray(level, dtype=U64) + U64(0x2545F4914F6CDD1D) * U64(probe))
    return ((g >> U64(32)) * np.asarray(n_bits, dtype=U64)) >> U64(32)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(LOG_BASE) + 1e-9).astype(np.int64)


def expected(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 for level 0."""
    table = np.array([0.0, *(max(1.0, (LOG_BASE ** (j - 1) + LOG_BASE**j - 1) / 2) for j in range(1, 256))])
    return table[levels]


def build_segment(keys: np.ndarray, counts: np.ndarray, bits_per_entry: int) -> tuple[bytes, int]:
    """The Bloom filter of keys at all levels of their counts, and its number of bits."""
    levels = levels_of(counts)
    n_bits = max(64, bits_per_entry * int(levels.sum()))
    if n_bits >= 1 << 32:
        raise ValueError("a bucket of n-grams is too large; lower Sizes.bucket")
    flags = np.zeros(n_bits, dtype=bool)
    live, level = np.arange(len(keys)), 1
    while len(live):
        for i in range(PROBES):
            flags[_positions(keys[live], level, i, n_bits)] = True
        level += 1
        live = live[levels[live] >= level]
    return np.packbits(flags, bitorder="little").tobytes(), n_bits


class Model:
    """Segments of buckets that follow one another."""

    def __init__(self, segments: list):
        """segments: (bucket, filter, number of bits), without gaps."""
        self.first, self.last = segments[0][0], segments[-1][0]
        self.filter = np.frombuffer(b"".join(s[1] for s in segments), dtype=np.uint8)
        self.n_bits = np.array([s[2] for s in segments], dtype=U64)
        self.base = np.cumsum([0] + [len(s[1]) for s in segments][:-1])

    def levels(self, names: np.ndarray, order: int) -> np.ndarray:
        """The level of each name of these buckets, by repeated membership probes."""
        bucket, keys = (names >> U64(NAME_BITS)).astype(np.int64) - self.first, _of_order(names, order)
        out = np.zeros(len(names), dtype=np.uint8)
        live, level = np.arange(len(names)), 1
        while len(live) and level < 256:
            for i in range(PROBES):
                own = bucket[live]
                at = _positions(keys[live], level, i, self.n_bits[own]).astype(np.int64)
                live = live[(self.filter[self.base[own] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0]
            out[live] = level
            level += 1
        return out


def _of_order(names: np.ndarray, order: int) -> np.ndarray:
    return names * U64(4) + U64(order)


def _coded(values: np.ndarray) -> bytes:
    """Values of 0 or more as their bytes in the least width that has them all, first bytes first, compressed."""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return (len(values) << 4 | width).to_bytes(5, "little") + ZSTD.compress(planes.ravel(), asbytes=True)


def _decoded(data: bytes) -> np.ndarray:
    n, width = divmod(int.from_bytes(data[:5], "little"), 16)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(ZSTD.decompress(data[5:], n * width), dtype=np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _shift(order: int, bits: int) -> int:
    """The bits of a name below those that name its bucket."""
    return 64 - bits if order == 1 else NAME_BITS


def most_bytes(size: int, rows: int, bits: int) -> float:
    """What the filter of so many rows with so many bytes of text can come to.

    A text of n bytes has at most (n + 1) / 2 words and its end, and no n-gram has more levels than occurrences.
    """
    return (ORDER - 1) * bits / 8 * (size + 3 * rows) / 2


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept out of training; one without an id is not."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Grams:
    """A block's tokens, and for each order the distinct n-grams, by name, and which one ends at each token (or -1).

    A word's name is its hash; that of a longer n-gram has the bits that name a bucket and NAME_BITS more.
    """

    def __init__(self, table: pa.Table, bits: int):
        texts = BlockTexts(table)
        self.ids, self.bits = texts.ids, bits
        self.held = np.array([held_out(x) for x in texts.ids.to_pylist()], dtype=bool)
        self.tokens = Tokens(texts)
        trained, self.names, self.at, self.counts = ~self.held[self.tokens.doc], [], [], []
        for order, (keys, places) in enumerate(self.tokens.grams(), 1):
            names, back = np.unique((keys if order == 1 else keys >> U64(64 - NAME_BITS - bits))[places], return_inverse=True)
            at = np.full(len(keys), -1, dtype=np.int64)
            at[places] = back
            self.names.append(names)
            self.at.append(at)
            self.counts.append(np.bincount(at[places & trained], minlength=len(names)))

    def buckets(self, order: int) -> np.ndarray:
        return self.names[order - 1] >> U64(_shift(order, self.bits))

    def dealt(self, block: int, trained: bool) -> pa.Table:
        """SENT: names as the steps between them, with their counts in what is trained on; of n-grams all or those trained on."""
        rows = []
        for order in range(1, ORDER + 1):
            names, counts, shift = self.names[order - 1], self.counts[order - 1], _shift(order, self.bits)
            if trained and order > 1:
                names, counts = names[counts > 0], counts[counts > 0]
            buckets, start, end = equal_runs(names >> U64(shift))
            low = names & U64((1 << shift) - 1)
            steps = np.diff(low, prepend=U64(0))
            steps[start] = low[start]
            rows += [(k, block, order, _coded(steps[a:b]), _coded(counts[a:b])) for k, a, b in zip(buckets.tolist(), start.tolist(), end.tolist())]
        columns = zip(*rows) if rows else ((),) * 5
        kinds = {"bucket": pa.int32(), "block": pa.int64(), "n": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns)})


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, rising, the sum of each one's counts, and the place among them of every key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.append(True, keys[1:] != keys[:-1])
    back, start = np.empty(len(keys), dtype=np.int32), np.flatnonzero(first)
    back[order] = np.cumsum(first) - 1
    return keys[start], np.add.reduceat(counts[order], start), back


def _gather(bucket: int, table: pa.Table, bits: int, bits_per_entry: int, min_count: int, probed: bool) -> pa.Table:
    """For each block the exact counts of the words that it sent, and the bucket's segment or, if probed, its levels.

    An n-gram is probed once, however many blocks sent it, and the n-grams of all blocks are probed together.
    """
    rows, grams = [], []
    orders = np.asarray(table.column("n"))
    for order in range(1, ORDER + 1):
        part = table.filter(pa.array(orders == order))
        if not part.num_rows:
            continue
        keys = [np.cumsum(_decoded(x), dtype=U64) for x in part.column("keys").to_pylist()]
        sent = list(per_block(part, map(len, keys)))
        counts = np.concatenate([_decoded(x) for x in part.column("counts").to_pylist()]).astype(np.int64)
        names, total, back = _summed(np.concatenate(keys) | U64(bucket << _shift(order, bits)), counts)
        if order > 1:
            grams.append((order, names, total, back, sent))
            continue
        start = names == mix(np.array([START]) ^ U64(1))[0]
        n_tokens, n_words = int(total[~start].sum()), int((total[~start] > 0).sum())
        found = total[back]
        rows += [(block, "words", bucket, _coded(found[a:b]), None) for block, a, b in sent]
        rows.append((None, "total", bucket, n_tokens.to_bytes(8, "big"), n_words.to_bytes(8, "big")))
    kept = [(_of_order(names[total >= min_count], order), total[total >= min_count]) for order, names, total, _, _ in grams]
    if not sum(len(x) for x, _ in kept):
        return notes_of(rows)
    segment, n_bits = build_segment(*map(np.concatenate, zip(*kept)), bits_per_entry)
    if not probed:
        return notes_of([*rows, (None, "segment", bucket, segment, n_bits.to_bytes(8, "little"))])
    model = Model([(bucket, segment, n_bits)])
    for order, names, _, back, sent in grams:
        found = np.concatenate([model.levels(names[a : a + PROBED], order) for a in range(0, len(names), PROBED)])[back]
        rows += [(block, f"levels{order}", bucket, _coded(found[a:b]), None) for block, a, b in sent]
    return notes_of(rows)


def scores_of(grams: Grams, words: np.ndarray, levels: list[np.ndarray], n_train: int, vocabulary: int) -> pa.Table:
    """SCORES of a block; words are its words' counts, levels those of its n-grams of each order from 2 on.

    Orders are interpolated with LAMBDA where the filter knows the context; the lowest has one added to each count.
    """
    tokens, total = grams.tokens, float(n_train + vocabulary + 1)
    begin = tokens.begin[:-1]
    count = words[grams.at[0]].astype(np.float64)
    p, context = (count + 1) / total, count
    for own, at in zip(levels, grams.at[1:]):
        seen = np.where(at >= 0, expected(own.astype(np.int64))[at] if len(own) else 0.0, 0.0)
        before = np.concatenate([[0.0], context[:-1]])
        p = np.where((before > 0) & (at >= 0), LAMBDA * np.minimum(1.0, seen / np.maximum(before, 1.0)) + (1 - LAMBDA) * p, p)
        context = seen
    score, base, known = np.log10(p), np.log10((count + 1) / total), (count > 0).astype(np.int64)
    sums = []
    for x in (known, base, score):
        x[begin] = 0
        sums.append(np.add.reduceat(x, begin) if len(begin) else x)
    return pa.table({"doc_id": grams.ids, "held_out": pa.array(grams.held), "n_tokens": pa.array(tokens.n_tokens.astype(np.int64)), "n_known": pa.array(sums[0]), "train_tokens": pa.array(np.full(len(begin), n_train, np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})


def language_scores(df: DataFrame, sizes: Sizes = Sizes(), min_count: int = MIN_COUNT) -> DataFrame:
    """SCORES of every row of df (doc_id, text), by a model of those that are not held out.

    min_count: how often an n-gram of two or more words must stand in what is trained on to count as more than its end.

    A null or empty text is its end alone; a null doc_id is not held out. With nothing to train on all counts are 0.
    Texts that repeat count as often as they occur, rows that repeat have a row each, further columns are not read and
    an empty table gives no rows. Texts of any length are scored whole.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    bits = min(64 - NAME_BITS, max(2, math.ceil(math.log2(max(1, size / sizes.bucket)))))
    probed = most_bytes(size, rows, sizes.bits) > sizes.broadcast
    blocks = table_of_blocks(docs, size, "lm-blocks", sizes.block, sizes.table)
    released(spark)
    count = lambda key, table: Grams(table, bits).dealt(key[0].as_py(), not probed)
    gather = lambda key, table: _gather(key[0].as_py(), table, bits, sizes.bits, min_count, probed)
    notes = stored(blocks.groupBy("block").applyInArrow(count, SENT).groupBy("bucket").applyInArrow(gather, NOTES), "lm-notes")
    released(spark)
    whole = lambda c: F.sum(F.conv(F.hex(c), 16, 10).cast("long"))
    n_train, vocabulary = (x or 0 for x in notes.where("kind = 'total'").agg(whole("one"), whole("two")).first())
    pieces = [] if probed else _broadcast(notes.where("kind = 'segment'"), bits, sizes.piece)

    def score(key, own, notes):
        grams = Grams(own, bits)
        words, levels = np.zeros(len(grams.names[0]), dtype=np.int64), []
        for at, one, _ in noted(notes, "words", grams.buckets(1)):
            words[at] = _decoded(one)
        for order in range(2, ORDER + 1):
            names, found = grams.names[order - 1], np.zeros(len(grams.names[order - 1]), dtype=np.uint8)
            for piece in pieces:
                at = slice(*np.searchsorted(grams.buckets(order), np.array([piece.value.first, piece.value.last + 1], dtype=U64)).tolist())
                found[at] = piece.value.levels(names[at], order)
            for at, one, _ in noted(notes, f"levels{order}", grams.buckets(order)):
                found[at] = _decoded(one)
            levels.append(found)
        return scores_of(grams, words, levels, n_train, vocabulary)

    return blocks.groupBy("block").cogroup(notes.where("block is not null").groupBy("block")).applyInArrow(score, SCORES)


def _broadcast(segments: DataFrame, bits: int, size: int) -> list:
    """The whole filter, broadcast in pieces of so many buckets; a bucket without n-grams has an empty segment."""
    out = []
    for k in range(0, 1 << bits, size):
        own = {r.bucket: r for r in segments.where(F.col("bucket").between(k, k + size - 1)).select("bucket", "one", "two").collect()}
        rows = [(b, bytes(own[b].one), int.from_bytes(own[b].two, "little")) if b in own else (b, bytes(8), 64) for b in range(k, min(k + size, 1 << bits))]
        out.append(segments.sparkSession.sparkContext.broadcast(Model(rows)))
    return out
