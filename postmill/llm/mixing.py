"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in a fixed random order; its words in that order, repeated as often as its target
asks, are cut into blocks. The tree splits the exact numbers of blocks of all sources among the output shards: at
each node the left half's counts are one multivariate-hypergeometric draw. A shard then gets so many blocks of each
source, disjoint runs of that source's randomly permuted blocks, and its blocks are shuffled among themselves.

mixture() cuts documents where blocks end; mixed() has blocks of whole documents, of each those that start in it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import stored

WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Documents of a source that stand in one step of its order, on average at most.
STEP_ROWS = 20_000
#: Blocks that a shard gets, on average, and words of a block at most: a larger mix has more blocks, not larger ones.
BLOCKS_A_SHARD, BLOCK_WORDS = 256, 1 << 20
#: Sources at most: their sizes and targets are one small table.
MOST_SOURCES = 100_000
#: Words of a shard that one task writes, on average at most.
SLICE_WORDS = 4_000_000


def targets(totals: DataFrame, weights=WEIGHTS, most=MOST_REPEATS) -> DataFrame:
    """totals (source, source_size) with target: double.

    min(most * source_size, level * weight), at the level where targets add up to all sizes; weights repeat over the
    sources by code point, null last. Works on one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    whole, by_cap = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.max(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))).over(whole)
    return rows.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("w"))).select("source", "source_size", "target")


def splitting_tree(counts: np.ndarray, shards: int, seed: int = 7) -> np.ndarray:
    """counts of blocks per source, split exactly among shards: an array (shards, sources)."""
    out, rng = np.zeros((shards, len(counts)), dtype=np.int64), np.random.default_rng(seed)
    todo = [(0, shards, np.asarray(counts, dtype=np.int64))]
    while todo:
        a, b, own = todo.pop()
        if b - a == 1:
            out[a] = own
            continue
        half = (b - a) // 2
        left = rng.multivariate_hypergeometric(own, int(own.sum()) * half // (b - a), method="marginals") if own.sum() else own
        todo += [(a + half, b, own - left), (a, a + half, left)]
    return out


def ordered(df: DataFrame, seed: int = 7) -> DataFrame:
    """df (doc_id, source, size, tag) with source_size, target, quota (whole words), step, place and before.

    before is the number of words of the documents that stand before in the source's order; step and place number
    the rows of a source. The order is that of hashes of doc_id and tag (a digest of the text), so texts that share an
    id, or have none, are spread. The sizes are stored first, so that the texts they come from are read once.
    """
    df = stored(df, "mix-sizes")
    totals = stored(df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    if (sources := totals.count()) > MOST_SOURCES:
        raise ValueError(f"{sources} sources: targets are for at most {MOST_SOURCES}, as their table goes to every task")
    wanted = targets(totals.select("source", "source_size"))
    n = df.count()
    digits = min(8, max(1, math.ceil(math.log(max(2, n / STEP_ROWS), 16))))
    keyed = df.withColumn("perm", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("tag"), F.lit(f"|{seed}")))).withColumn("step", F.substring("perm", 1, digits))
    sums = keyed.groupBy("source", "step").agg(F.sum("size").alias("step_size"))
    upto = F.sum("step_size").over(Window.partitionBy("source").orderBy("step")) - F.col("step_size")
    steps = sums.withColumn("step_before", upto).drop("step_size").join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    within = Window.partitionBy("source", "step").orderBy("perm", "doc_id", "size")
    own = keyed.withColumn("place", F.row_number().over(within)).withColumn("own_before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    both = own.join(steps.withColumnsRenamed({"source": "s", "step": "t"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("t"))).drop("s", "t")
    return both.withColumn("before", F.col("step_before") + F.col("own_before")).withColumn("quota", F.floor("target")).drop("step_before", "own_before", "perm")


def _quotas(docs: DataFrame) -> DataFrame:
    """(source, quota) of ordered() rows."""
    return docs.groupBy("source").agg(F.max("quota").alias("quota"))


def _block_words(quotas: DataFrame, shards: int, most: int) -> tuple[int, int]:
    """The words that a mix of these quotas draws, and those of a block."""
    words = quotas.agg(F.sum("quota")).first()[0] or 0
    return words, max(16, min(most, math.ceil(words / (shards * BLOCKS_A_SHARD))))


def _dealt(pieces: DataFrame, blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """pieces (source, block) with shard and draw_key: the tree splits the blocks (source, block; each once) among shards.

    The driver has the tree alone, a row a source. The blocks of a source are permuted by a window over its blocks, and
    a shard gets the run of them that the tree's counts give it.
    """
    blocks = stored(blocks, "mix-blocks")
    counts = blocks.groupBy("source").count().orderBy(F.col("source").asc_nulls_last()).collect()
    tree = np.cumsum(splitting_tree(np.array([r["count"] for r in counts], dtype=np.int64), shards, seed), axis=0)
    ends = pieces.sparkSession.createDataFrame([(r.source, tree[:, i].tolist()) for i, r in enumerate(counts)], "s string, ends array<long>")
    permuted = Window.partitionBy("source").orderBy(F.xxhash64("block", "source", F.lit(~seed)), "block")
    ranked = blocks.withColumn("rank", F.row_number().over(permuted) - 1)
    # A block that lies behind the last shard's end has no shard.
    shard = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    dealt = ranked.join(F.broadcast(ends), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("block").alias("b"), shard.alias("shard")).where(F.col("shard") < shards)
    # Documents that are not drawn have no block: their places spread them over the tasks of the join.
    own = F.coalesce("block", -F.col("place").cast("long"))
    drawn = pieces.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (own == F.col("b")), "left").drop("s", "b")
    return drawn.withColumn("draw_key", F.xxhash64("source", "block", F.lit(seed)))


def mix(df: DataFrame, shards: int = 16, seed: int = 7, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The drawn pieces of df (doc_id, source, size, tag), one row each; a document that is not drawn has one with nulls.

    Adds to ordered(): epoch, block, from_word, n_words, shard and draw_key, by which a shard's blocks are shuffled.
    Documents of size 0 and null are never drawn; null is a source of its own; rows that repeat are drawn apart. A block
    has at most block_words words.
    """
    return _mix(df, shards, seed, block_words)[0]


def _mix(df: DataFrame, shards: int, seed: int, most: int) -> tuple[DataFrame, int]:
    """mix(), and the words that it draws."""
    docs = stored(ordered(df, seed), "mix-order")
    quotas = _quotas(docs)
    words, block_words = _block_words(quotas, shards, most)
    start = F.col("epoch") * F.col("source_size") + F.col("before")
    epochs = docs.withColumn("epoch", F.explode_outer(F.when((F.col("size") > 0) & (F.col("quota") > F.col("before")), F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - F.col("before") - 1) / F.col("source_size"))))))
    taken = epochs.withColumn("lo", start).withColumn("hi", F.least(start + F.col("size"), F.col("quota")))
    pieces = taken.withColumn("block", F.explode_outer(F.when(F.col("hi") > F.col("lo"), F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words)))))
    at = F.greatest("lo", F.col("block") * block_words)
    pieces = pieces.withColumn("from_word", at - F.col("lo")).withColumn("n_words", F.least("hi", (F.col("block") + 1) * block_words) - at).drop("lo", "hi")
    blocks = quotas.where("quota > 0").select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / block_words))).alias("block"))
    return _dealt(pieces, blocks, shards, seed), words


def slices_of(words: int, shards: int) -> int:
    """How many tasks write a shard of a mix of so many words."""
    return max(1, math.ceil(words / (shards * SLICE_WORDS)))


def shuffled(pieces: DataFrame, shards: int, slices: int = 1) -> DataFrame:
    """The drawn pieces, a shard's together, blocks in random order and each block's words in their own.

    With more slices than one a shard is written by so many tasks, each a run of its blocks.
    """
    part = F.least(F.floor((F.col("draw_key").cast("double") / 2.0**63 + 1) / 2 * slices), F.lit(slices - 1))
    return pieces.where("shard is not null").repartitionById(shards * slices, (F.col("shard") * slices + part).cast("int")).sortWithinPartitions("shard", "draw_key", "source", "block", "epoch", "before")


def placed(pieces: DataFrame) -> DataFrame:
    """The drawn pieces with at_word, the number of words that stand before the piece in its shard."""
    drawn = pieces.where("shard is not null")
    sums = drawn.groupBy("shard", "draw_key", "source", "block").agg(F.sum("n_words").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("shard").orderBy("draw_key", "source", "block")) - F.col("words")
    starts = sums.select(F.col("source").alias("s"), F.col("block").alias("b"), upto.alias("block_at"))
    within = Window.partitionBy("source", "block").orderBy("epoch", "before")
    own = drawn.withColumn("own_at", F.sum("n_words").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_words"))
    both = own.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return both.withColumn("at_word", F.col("block_at") + F.col("own_at")).drop("s", "b", "block_at", "own_at")


WORDS = r"[^\x20\x09-\x0D]+"


def sized(df: DataFrame, *more) -> DataFrame:
    """(doc_id, source, size, tag) and more columns of df (doc_id, text, source); size is the number of words."""
    found = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")).cast("long")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "source", found.alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tag"), *more)


def mixture_places(df: DataFrame, shards: int = 16, block_words: int = BLOCK_WORDS) -> DataFrame:
    """mixture() with places: the pieces of the document in the written mix as (shard, at_word, n_words), in order."""
    pieces, words = _mix(sized(df), shards, 7, block_words)
    written = stored(shuffled(placed(pieces), shards, slices_of(words, shards)), "mix-written")
    rows = written.unionByName(pieces.where("block is null"), allowMissingColumns=True)
    place = F.when(F.col("shard").isNotNull(), F.struct("shard", "at_word", "n_words"))
    firsts = (F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target"))
    out = rows.groupBy("source", "step", "place").agg(*firsts, F.coalesce(F.sum("n_words"), F.lit(0)).alias("taken"), F.count("n_words").alias("n_pieces"), F.array_sort(F.collect_list(place)).alias("places"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "places")


def mixture(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, text, source): size, source_size, target, taken (words that the mix takes).

    Of each source exactly floor(target) words are taken, of a document at most three times its size. The mix is
    written shard by shard, and taken and n_pieces are what was written. Null and empty texts have size 0 and nothing
    is taken of them; null is a source of its own, the last; rows that repeat are drawn apart; an empty table gives no
    rows, and further columns are not read.
    """
    return mixture_places(df).drop("places")


def drawn_documents(rows: DataFrame, shards: int = 16, seed: int = 7, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """The drawn copies of rows (row_id, doc_id, source, size, tag), one row each, with shard and draw_key; all quotas.

    Documents stay whole: the one that a source's quota cuts is drawn if half of it or more is inside. A copy is in
    the block that its first word is in; the tree splits the blocks that hold a copy.
    """
    docs = stored(ordered(rows, seed), "mix-order")
    words, block_words = _block_words(_quotas(docs), shards, block_words)
    copies = docs.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("quota") / F.col("source_size")))))
    copies = copies.withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("before"))
    copies = copies.where(F.least(F.col("size"), F.col("quota") - F.col("lo")) * 2 >= F.col("size")).withColumn("block", F.floor(F.col("lo") / block_words)).drop("lo")
    return _dealt(copies, copies.select("source", "block").distinct(), shards, seed), words


def mixed(df: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The rows of df, each as often as the mix draws the document, with all their columns, as shuffled() has them.

    Rows are told apart by a number, so those that share a doc_id, or are equal, are drawn apart; ties in the draw are
    broken by hashes of id and text. Null and empty texts have no words and are not drawn; null is a source of its own;
    an empty table gives no rows; further columns may have any name.
    """
    rows = stored(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.monotonically_increasing_id().alias("row_id")), "mix-rows")
    named = rows.select("row_id", "row.doc_id", "row.text", "row.source")
    copies, words = drawn_documents(sized(named, "row_id"), shards, seed)
    kept = rows.join(copies.select("row_id", "shard", "draw_key", "source", "block", "epoch", "before"), "row_id")
    return shuffled(kept, shards, slices_of(words, shards)).select("row.*")
