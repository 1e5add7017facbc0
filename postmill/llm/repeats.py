"""Repeated byte strings across documents, found with suffix arrays.

A repeat of 50 bytes has 27 substrings of 24 bytes. The one with the smallest hash (the leftmost, if several) is the
same in every occurrence of the repeat, so it is the repeat's anchor: equal 50-byte strings meet at their anchor,
and an anchor's context, the text around it that its own strings cover, is short.

Documents are packed into blocks (see blocks.py), so that what comes back for a block meets its text without another
shuffle of the texts:

1. each block sends the hashes of its anchors; back comes which of them other blocks have too;
2. each block sends the contexts of those, equal ones once with their smallest doc_id. The contexts of an anchor are
   one text of a suffix array, an anchor being one symbol, and a context that several documents have is in it twice:
   for the document with the smallest doc_id and for all others. The array puts equal strings side by side, and the
   smallest doc_id among them decides which of them go;
3. each block cuts these from its documents.

An anchor that very many blocks have sends each of its strings by itself, so no task gets all that surrounds it.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.blocks import BLOCK_BYTES, NOTES, TABLE_BYTES, BlockTexts, noted, notes_of, per_block, table_of_blocks
from postmill.llm.common import U64, equal_runs, hash_runs, mix, released, stored
from postmill.llm.suffixes import spread, suffix_arrays

LENGTH, GRAM = 50, 24
SIDE = LENGTH - GRAM
NEVER = np.uint32(0xFFFFFFFF)
#: No doc_id: greater than all.
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Sizes:
    """How work is cut; no result depends on it."""

    #: Text bytes: of a block, of a bucket of the table of blocks, of a bucket of hashes and of one of contexts, on average.
    block: int = BLOCK_BYTES
    table: int = TABLE_BYTES
    keys: int = 64 << 20
    contexts: int = 8 << 20
    #: Text that is cut to anchors at once.
    cut: int = 1 << 20
    #: An anchor that more blocks have sends its strings one by one.
    hot_blocks: int = 256
    #: Symbols of one anchor's text at most (its strings become texts of their own beyond), and of all texts at once.
    text: int = 1000
    array: int = 400_000


KEYS = "bucket int, block long, keys binary"
SENT = "bucket int, block long, keys binary, size long, rest binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _slide(a: np.ndarray, pick, width: int) -> np.ndarray:
    """pick over each width neighbours."""
    step = 1
    while 2 * step <= width:
        a = pick(a[:-step], a[step:])
        step *= 2
    return pick(a[: len(a) - (width - step)], a[width - step :]) if step < width else a


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(h, p, a, b) of texts, data[offsets[i]:offsets[i + 1]]: an anchor's hash and place, and its strings' first and last start."""
    n = len(data)
    none = (np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)
    if n < LENGTH:
        return none
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data
    eight = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded, strides=(1,)).copy()
    m = n - GRAM + 1
    h = eight[:m] * U64(0x9E3779B97F4A7C15)
    part = h >> U64(29)
    h ^= part
    h += eight[8 : 8 + m]
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, U64(31), out=part)
    h += eight[16 : 16 + m]
    h *= U64(0x94D049BB133111EB)
    h ^= np.right_shift(h, U64(32), out=part)
    h *= U64(0xD6E8FEB86659FD93)
    # The upper half picks the anchor, which all 64 bits then name.
    w = np.minimum(np.right_shift(h, U64(32), out=part).astype(np.uint32), NEVER - np.uint32(1))
    del part, eight
    ends = offsets[1:].tolist()
    for e in ends:
        w[max(0, e - GRAM + 1) : e] = NEVER
    least = _slide(w, np.minimum, SIDE + 1)
    for e in ends:
        least[max(0, e - LENGTH + 1) : e] = NEVER
    for lo, hi in zip(offsets[:-1].tolist(), ends):
        if hi - lo < LENGTH:
            least[lo:hi] = NEVER
    start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    end, value = np.append(start[1:], len(least)) - 1, least[start]
    before = np.append(NEVER, least[start[1:] - 1])
    real = value != NEVER
    start, end, value, before = start[real], end[real], value[real], before[real]
    # A smaller hash that has come in is the last of the window; where the least one left, the next is searched.
    p = start + SIDE
    open_ = np.flatnonzero((before < value) | (before == NEVER))
    for x in range(SIDE):
        if not len(open_):
            break
        hit = w[start[open_] + x] == value[open_]
        p[open_[hit]] = start[open_[hit]] + x
        open_ = open_[~hit]
    first, last = start, np.minimum(end, p)
    again = np.flatnonzero(end > p)
    if len(again):
        # The least hash occurs again in these runs: each place is the leftmost for the starts behind the one before.
        sizes = end[again] - start[again] + 1 + SIDE
        run = np.repeat(again, sizes)
        at = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[run]
        hit = w[at] == value[run]
        at, run = at[hit], run[hit]
        new = np.append(True, run[1:] != run[:-1])
        begin = np.where(new, start[run], np.append(0, at[:-1]) + 1)
        stop = np.minimum(end[run], at)
        good = begin <= stop
        once = end <= p
        p, first, last = (np.concatenate(z) for z in ((p[once], at[good]), (first[once], begin[good]), (last[once], stop[good])))
        order = np.argsort(p, kind="stable")
        p, first, last = p[order], first[order], last[order]
    # Least hashes are small: mixed, names are even.
    return mix(h[p]), p, first, last


class Block:
    """A block's documents (null ids as NO_ID) and anchors."""

    def __init__(self, table: pa.Table, cut: int = Sizes.cut):
        texts = BlockTexts(table)
        self.null_ids, self.data, self.offsets = texts.ids, texts.bytes, texts.offsets
        self.ids = np.asarray(pa.compute.fill_null(texts.ids, NO_ID))
        found = []
        for cuts in self._slices(cut):
            h, p, a, b = anchors(self.data[cuts[0] : cuts[-1]], cuts - cuts[0])
            found.append((h, p + cuts[0], a + cuts[0], b + cuts[0]))
        self.h, self.p, self.a, self.b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)
        self.doc = np.searchsorted(self.offsets, self.p, side="right") - 1

    def _slices(self, size: int):
        """Ends of texts of about size bytes together; a longer document is cut so that each string is in one piece."""
        i, n = 0, len(self.ids)
        while i < n:
            lo, hi = int(self.offsets[i]), int(self.offsets[i + 1])
            if hi - lo > size:
                for s in range(lo, hi - LENGTH + 1, size):
                    yield np.array([s, min(hi, s + size + LENGTH - 1)])
                i += 1
            else:
                k = int(np.searchsorted(self.offsets, lo + size, side="right")) - 1
                yield self.offsets[i : k + 1]
                i = k

    def keys(self, bits: int) -> np.ndarray:
        """The anchors' names as sent: the bits that name a bucket and 32 more."""
        return self.h >> U64(32 - bits)


class Contexts:
    """A block's contexts of anchors that several documents may have, by key: what is sent for them, and where they are."""

    def __init__(self, block: Block, notes: pa.Table, key_bits: int):
        keys = block.keys(key_bits)
        order = np.argsort(keys, kind="stable")
        start = _starts(keys[order])
        level = np.zeros(len(start), dtype=np.uint8)
        for own, *both in noted(notes, "keys", keys[order][start] >> U64(32)):
            level[own] = sum(np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=own.stop - own.start) for x in both)
        docs = block.doc[order]
        both = np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start) if len(start) else level > 0
        level = np.repeat(np.maximum(level, both), np.diff(np.append(start, len(order))))
        cold, hot = order[level == 1], order[level > 1]
        times = block.b[hot] - block.a[hot] + 1
        first = spread(block.a[hot], times)
        h, p = np.concatenate([block.h[cold], mix(hash_runs(block.data, first, first + LENGTH))]), np.concatenate([block.p[cold], np.repeat(block.p[hot], times)])
        a, b = np.concatenate([block.a[cold], first]), np.concatenate([block.b[cold], first])
        prints = mix(hash_runs(block.data, a, b + LENGTH) + (p - a).astype(U64))
        ids = block.ids[np.concatenate([block.doc[cold], np.repeat(block.doc[hot], times)])]
        order = np.lexsort((ids, prints, h))
        start = _starts(h[order], prints[order])
        count = np.diff(np.append(start, len(order)))
        #: Of each place: the context that is there, its anchor and doc_id.
        self.which, self.p, self.ids = np.repeat(np.arange(len(start)), count), p[order], ids[order]
        kept = order[start]
        self.key, self.least, self.more = h[kept], ids[kept], ids[order[start + count - 1]] > ids[kept]
        self.data, self.at, self.left, self.right = block.data, a[kept], p[kept] - a[kept], b[kept] + LENGTH - p[kept] - GRAM

    def dealt(self, block: int, bits: int) -> pa.Table:
        full, first, last = (x.tolist() for x in equal_runs(self.key >> U64(64 - bits)))
        codec, sizes, rest = pa.Codec("zstd", compression_level=1), [], []
        for own in map(slice, first, last):
            at, left, right = self.at[own], self.left[own], self.right[own]
            base = np.cumsum(left + right) - left - right
            text = np.empty(int((left + right).sum()), dtype=np.uint8)
            text[spread(base, left)] = self.data[spread(at, left)]
            text[spread(base + left, right)] = self.data[spread(at + left + GRAM, right)]
            raw = b"".join((self.least[own].tobytes(), left.astype(np.uint8).tobytes(), right.astype(np.uint8).tobytes(), self.more[own].tobytes(), text.tobytes()))
            sizes.append(len(raw))
            rest.append(codec.compress(raw, asbytes=True))
        keys = [self.key[a:b].tobytes() for a, b in zip(first, last)]
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int64()), "keys": pa.array(keys, pa.binary()), "size": pa.array(sizes, pa.int64()), "rest": pa.array(rest, pa.binary())})


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal entries start."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _removed(left, right, at, data, docs, unit) -> np.ndarray:
    """For each context (a row of a unit's text, units one after another) a bit for each string that a smaller doc has.

    Bit x is the string with x bytes left of the anchor. One suffix array a unit puts equal strings side by side. Only
    suffixes that start left of an anchor or at it are asked for, so what is right of it is read four bytes a symbol,
    the first of which is the anchor as well; short ones are filled up with zeros, which keeps equal beginnings together.
    """
    wide = np.maximum(1, (right + 3) // 4)
    sizes = left + wide
    base = np.cumsum(sizes) - sizes + unit
    begin = np.append(base[_starts(unit)], base[-1] + sizes[-1] + 1)
    symbols = np.zeros(int(begin[-1]), dtype=np.int64)
    symbols[spread(base, left)] = data[spread(at, left)] + np.int64(1)
    place, source = spread(base + left, wide), np.repeat(at + left, wide) + 4 * spread(np.zeros_like(wide), wide)
    rest = np.repeat(at + left + right, wide) - source
    for k in range(4):
        symbols[place] = symbols[place] << 8 | np.where(k < rest, data[np.minimum(source + k, len(data) - 1)], 0)
    symbols[place] += 257
    order = suffix_arrays(symbols, begin)
    owner = np.full(len(symbols), -1, dtype=np.int64)
    owner[spread(base, sizes)] = np.repeat(np.arange(len(base)), sizes)
    who = owner[order]
    lefts = (base + left)[who] - order
    real = (who >= 0) & (lefts >= SIDE - right[who])
    who, lefts = who[real], lefts[real]
    text = data[(at + left)[who][:, None] - lefts[:, None] + np.arange(SIDE)]
    new = np.append(True, (text[1:] != text[:-1]).any(axis=1) | (lefts[1:] != lefts[:-1]) | (unit[who[1:]] != unit[who[:-1]]))
    start = np.flatnonzero(new)
    smallest = np.repeat(np.minimum.reduceat(docs[who], start), np.diff(np.append(start, len(who))))
    gone = smallest < docs[who]
    return np.bincount(who[gone], weights=(1 << lefts[gone]).astype(np.float64), minlength=len(base)).astype(np.uint32)


def decide(key, left, right, at, data, least, more, sizes=Sizes()):
    """Which strings of contexts go: for the document least of each entry, and for its other documents, if it has more.

    An entry's context is left + right bytes of data from at; entries of equal key have the same anchor.
    """
    prints = mix(hash_runs(data, at, at + left + right) + left.astype(U64))
    order = np.lexsort((prints, key))
    start = _starts(key[order], prints[order])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
    first = np.minimum.reduceat(least[order], start)
    others = (np.maximum.reduceat(least[order], start) > first) | np.logical_or.reduceat(more[order], start)
    kept = order[start]
    key, left, right, at = key[kept], left[kept], right[kept], at[kept]
    flags = np.zeros((2, len(kept)), dtype=np.uint32)
    begin = _starts(key)
    size = np.add.reduceat((1 + others) * (left + right // 4 + 1), begin)
    unit = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    alone = np.add.reduceat(1 + others, begin) == 1
    large = size > sizes.text
    if large.any():
        own = np.flatnonzero(large[unit])
        times = left[own] + right[own] - SIDE + 1
        rows, x = np.repeat(own, times), spread(SIDE - right[own], times)
        begins = at[rows] + left[rows] - x
        name = mix(mix(key[rows] + x.astype(U64)) ^ hash_runs(data, begins, begins + SIDE))
        for k, some in enumerate(decide(name, x, SIDE - x, begins, data, first[rows], others[rows], sizes)):
            flags[k] += np.bincount(rows, weights=np.where(some > 0, 1 << x, 0).astype(np.float64), minlength=len(kept)).astype(np.uint32)
    # Texts of like size together: arrays are built in steps that all of them take.
    small = np.flatnonzero((~alone & ~large)[unit])
    small = small[np.argsort(size[unit[small]], kind="stable")]
    copies = np.repeat(small, 1 + others[small])
    follows = np.append(False, copies[1:] == copies[:-1])
    docs = np.where(follows, NO_ID, first[copies])
    new = _starts(unit[copies])
    weight = size[unit[copies[new]]]
    part = np.repeat((np.cumsum(weight) - weight) // sizes.array, np.diff(np.append(new, len(copies))))
    for some in np.split(np.arange(len(copies)), np.flatnonzero(np.diff(part)) + 1):
        if len(some):
            c = copies[some]
            number = np.cumsum(np.append(False, unit[c][1:] != unit[c][:-1]))
            flags[follows[some].astype(np.int64), c] = _removed(left[c], right[c], at[c], data, docs[some], number)
    return np.where(least == first[which], flags[0][which], flags[1][which]), flags[1][which]


def _meet_keys(key, table, hot_blocks: int):
    """For each block the flags of the keys that it sent: those that other blocks have, and those that very many have."""
    sent = [np.frombuffer(x, dtype=np.uint32) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(sent)
    order = np.argsort(keys, kind="stable")
    start = _starts(keys[order])
    count = np.diff(np.append(start, len(keys)))
    level = np.empty(len(keys), dtype=np.uint8)
    level[order] = np.repeat((count > 1).astype(np.uint8) + (count > hot_blocks), count)
    rows = []
    for block, a, b in per_block(table, map(len, sent)):
        if level[a:b].any():
            rows.append((block, "keys", key[0].as_py(), np.packbits(level[a:b] > 0).tobytes(), np.packbits(level[a:b] > 1).tobytes()))
    return notes_of(rows)


def _meet_contexts(key, table, sizes: Sizes):
    """For each block the strings of the contexts that it sent which go."""
    codec = pa.Codec("zstd")
    keys = [np.frombuffer(x, dtype=U64) for x in table.column("keys").to_pylist()]
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    for own, size, rest in zip(keys, table.column("size").to_pylist(), table.column("rest").to_pylist()):
        raw, n = np.frombuffer(codec.decompress(rest, size), dtype=np.uint8), len(own)
        for c, x in zip(columns, (raw[: 8 * n].view(np.int64), raw[8 * n : 9 * n], raw[9 * n : 10 * n], raw[10 * n : 11 * n].view(bool), raw[11 * n :])):
            c.append(x)
    least, left, right, more, data = (np.concatenate(c) for c in columns)
    del columns
    left, right = left.astype(np.int64), right.astype(np.int64)
    one, two = decide(np.concatenate(keys), left, right, np.cumsum(left + right) - left - right, data, least, more, sizes)
    rows = []
    for block, a, b in per_block(table, map(len, keys)):
        if two[a:b].any() or one[a:b].any():
            rows.append((block, "masks", key[0].as_py(), one[a:b].tobytes(), two[a:b].tobytes()))
    return notes_of(rows)


def remove_repeats(df: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """RESULT for every row of df (doc_id, text): what is left without the 50-byte strings that a smaller doc_id has.

    Every byte covered by such a string goes; strings are judged on the input. A null or empty text has no bytes and
    keeps none; an empty table gives no rows; further columns of df are not read. Rows with the same doc_id do not
    count against each other; a null doc_id counts as greater than all. A text of any length is searched whole.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key_bits, bits = (max(2, math.ceil(math.log2(max(1, total / x)))) for x in (sizes.keys, sizes.contexts))
    blocks = table_of_blocks(docs, total, "repeat-blocks", sizes.block, sizes.table)
    released(spark)

    def keys(key, table):
        found = np.unique(Block(table, sizes.cut).keys(key_bits))
        full, first, last = (x.tolist() for x in equal_runs(found >> U64(32)))
        low = found.astype(np.uint32)
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int64()), "keys": pa.array([low[a:b].tobytes() for a, b in zip(first, last)], pa.binary())})

    def send(key, own, notes):
        return Contexts(Block(own, sizes.cut), notes, key_bits).dealt(key[0].as_py(), bits)

    def cut(key, own, notes):
        block = Block(own, sizes.cut)
        found = Contexts(block, notes, key_bits)
        one, two = np.zeros((2, len(found.key)), dtype=np.uint32)
        for at, *both in noted(notes, "masks", found.key >> U64(64 - bits)):
            one[at], two[at] = (np.frombuffer(x, dtype=np.uint32) for x in both)
        masks = np.where(found.ids == found.least[found.which], one[found.which], two[found.which])
        begins = np.zeros(len(block.data) + 1, dtype=bool)
        for x in range(SIDE + 1):
            begins[found.p[(masks >> np.uint32(x)) & 1 > 0] - x] = True
        upto = np.cumsum(begins[:-1], dtype=np.int32)
        gone = upto > 0
        gone[LENGTH:] = upto[LENGTH:] > upto[:-LENGTH]
        return _kept(block, gone)

    notes = stored(blocks.groupBy("block").applyInArrow(keys, KEYS).groupBy("bucket").applyInArrow(lambda key, table: _meet_keys(key, table, sizes.hot_blocks), NOTES), "repeat-keys")
    released(spark)
    sent = blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(send, SENT)
    masks = stored(sent.groupBy("bucket").applyInArrow(lambda key, table: _meet_contexts(key, table, sizes), NOTES), "repeat-masks")
    released(spark)
    return blocks.groupBy("block").cogroup(notes.unionAll(masks).groupBy("block")).applyInArrow(cut, RESULT)


def _kept(block: Block, gone: np.ndarray) -> pa.Table:
    """RESULT of a block; gone: a flag for each byte."""
    n, total = len(block.ids), np.zeros(len(gone) + 1, dtype=np.int64)
    np.cumsum(gone, out=total[1:])
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = block.offsets[:-1][block.offsets[:-1] < len(gone)]
    first[inner] = gone[inner]
    spans = np.zeros(len(gone) + 1, dtype=np.int64)
    np.cumsum(first, out=spans[1:])
    lo, hi = block.offsets[:-1], block.offsets[1:]
    data = block.data[~gone].tobytes()
    stay = (block.offsets - total[block.offsets]).tolist()
    sums = [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(stay, stay[1:])]
    return pa.table({"doc_id": block.null_ids, "n_bytes": pa.array(hi - lo), "n_removed": pa.array(total[hi] - total[lo]), "n_spans": pa.array(spans[hi] - spans[lo]), "kept_sha256": pa.array(sums, pa.string())})
