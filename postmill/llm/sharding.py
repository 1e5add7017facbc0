"""Sharding by a k-d tree: nodes split at weighted medians along their widest metadata dimension.

The points are groups of equal texts, weighted by their bytes, so that copies share a shard; only a group that exceeds
a whole shard is dealt row by row. Points above a quarter of a shard, at most four a shard, get their leaf first, the
heaviest where most room is left; what room they leave is what the tree's medians aim at. Languages and sources are dimensions by their rank. A median is found by descending a 48-bit key (24 bits of the
dimension, 24 bits of a hash that breaks ties), twelve bits a pass: each pass is one aggregate over all points, of
which 4,096 sums a node are scanned for the bin that holds the cut.
"""

from __future__ import annotations

import heapq
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import stored

ROW_BYTES = 16
BINS, PASSES = 12, 4
#: Nodes that are looked up in a map of literals at most; a table of more is joined.
MOST_LITERALS = 200
#: Rows that share one step of the numbering within a shard, on average.
SLOT_ROWS = 20_000


def ranks(df: DataFrame, c: str) -> DataFrame:
    """(c, rank: double) of the distinct values of c in order, from 1; null has none.

    Values are sorted over all partitions and numbered within each; only the partitions' row counts meet in one place.
    """
    own = df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)
    own = stored(own.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "shard-ranks")
    counts = own.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return own.join(before, "part").select(c, (F.col("before") + F.col("place") + 1).cast("double").alias("rank"))


def _with(df: DataFrame, values: dict[str, dict[int, object]], most_literals: int) -> DataFrame:
    """df with columns that have values[name][node] for each row, null for other nodes."""
    nodes = sorted({k for own in values.values() for k in own})
    if len(nodes) <= most_literals:
        look_up = lambda own: F.element_at(F.create_map(*(F.lit(x) for k, v in own.items() for x in (k, v))), F.col("node"))
        return df.withColumns({name: look_up(own) for name, own in values.items()})
    kinds = {name: "double" if isinstance(next(iter(own.values())), float) else "long" for name, own in values.items()}
    table = df.sparkSession.createDataFrame([(k, *(own.get(k) for own in values.values())) for k in nodes], "node int, " + ", ".join(f"{n} {t}" for n, t in kinds.items()))
    return df.join(F.broadcast(table), "node", "left")


def _split(points: DataFrame, left: dict[int, float], most_literals: int) -> dict[int, int]:
    """For each node (left: weight wanted below the cut) the cut as the largest key that goes left."""
    below, prefix, cuts = dict.fromkeys(left, 0), dict.fromkeys(left, 0), {}
    for step in range(PASSES):
        shift = BINS * (PASSES - 1 - step)
        live = _with(points, {"__prefix": prefix}, most_literals).where(F.shiftright("key", shift + BINS) == F.col("__prefix")) if step else points
        bins = live.groupBy("node", F.shiftright("key", shift).bitwiseAND((1 << BINS) - 1).alias("bin")).agg(F.sum("weight").alias("weight"))
        upto = bins.withColumn("upto", F.sum("weight").over(Window.partitionBy("node").orderBy("bin")))
        wanted = _with(upto, {"__wanted": {k: float(left[k] - below[k]) for k in left}}, most_literals)
        hit = wanted.where("upto >= __wanted").groupBy("node").agg(F.min_by(F.struct("bin", "weight", "upto"), "bin").alias("h"))
        for k, h in ((r.node, r.h) for r in hit.collect()):
            below[k] += h.upto - h.weight
            prefix[k] = prefix[k] << BINS | h.bin
            if step == PASSES - 1:
                over, under = below[k] + h.weight - left[k], left[k] - below[k]
                cuts[k] = prefix[k] if over <= under else prefix[k] - 1
    return {k: cuts.get(k, (1 << BINS * PASSES) - 1) for k in left}


def kd_leaves(points: DataFrame, dims: list[str], leaves: int, most_literals: int = MOST_LITERALS, room: list[float] | None = None) -> DataFrame:
    """points (weight: long, tie: long, dims: double) with leaf: int, 0 to leaves - 1, of weights near equal.

    room: what each leaf shall get in proportion, the same unless given. A node is named by its first leaf. Each level
    is stored, so that its passes read one narrow table.
    """
    tree, span = {0: leaves}, None
    upto = list(accumulate(room or [1.0] * leaves, initial=0.0))
    share = lambda k, m, n: (upto[k + m] - upto[k]) / (upto[k + n] - upto[k]) if upto[k + n] > upto[k] else m / n
    now = points.withColumn("node", F.lit(0).cast("int"))
    while any(n > 1 for n in tree.values()):
        stats = {r.node: r for r in now.groupBy("node").agg(F.sum("weight").alias("w"), *(F.min(d).alias(f"lo_{d}") for d in dims), *(F.max(d).alias(f"hi_{d}") for d in dims)).collect()}
        width = lambda r, d: max(r[f"hi_{d}"] - r[f"lo_{d}"], 1e-12)
        span = span or {d: width(stats[0], d) if stats else 1.0 for d in dims}
        wide = {k: max(range(len(dims)), key=lambda i, k=k: (width(stats[k], dims[i]) / span[dims[i]], -i)) for k, n in tree.items() if n > 1 and k in stats}
        if not wide:
            break
        named = _with(now, {"__dim": {k: d + 1 for k, d in wide.items()}, "__low": {k: float(stats[k][f"lo_{dims[d]}"]) for k, d in wide.items()}, "__width": {k: float(width(stats[k], dims[d])) for k, d in wide.items()}}, most_literals)
        value = F.element_at(F.array(*dims), F.col("__dim").cast("int"))
        key = F.shiftleft(((value - F.col("__low")) / F.col("__width") * ((1 << 24) - 1)).cast("long"), 24).bitwiseOR(F.col("tie").bitwiseAND((1 << 24) - 1))
        keyed = named.withColumn("key", F.when(F.col("__dim").isNotNull(), key)).drop("__dim", "__low", "__width")
        cuts = _split(keyed.where("key is not null").select("node", "key", "weight"), {k: stats[k].w * share(k, tree[k] // 2, tree[k]) for k in wide}, most_literals)
        cut = _with(keyed, {"__cut": cuts, "__right": {k: k + tree[k] // 2 for k in wide}}, most_literals)
        now = stored(cut.withColumn("node", F.when(F.col("key") > F.col("__cut"), F.col("__right")).otherwise(F.col("node")).cast("int")).drop("key", "__cut", "__right"), "shard-level")
        tree = {x: n for k, m in tree.items() for x, n in (((k, m // 2), (k + m // 2, m - m // 2)) if k in wide else ((k, 1),))}
    return now.withColumnRenamed("node", "leaf")


def numbered(df: DataFrame, group: str, order: list[str], n_rows: int, name: str) -> DataFrame:
    """df with a gapless number from 0 within each group, without sorting a whole group in one task."""
    steps = max(1, math.ceil(n_rows / SLOT_ROWS))
    dealt = df.withColumn("__step", F.pmod(F.xxhash64(*order), F.lit(steps)))
    counts = dealt.groupBy(group, "__step").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__step")) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy(group, "__step").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(before, [group, "__step"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__step", "__own", "__before")


def _heaviest(points: DataFrame, shards: int, full: float) -> tuple[DataFrame, list[float]]:
    """(t1, t2, apart, shard) of the points above a quarter of a full shard, and the room that is left in each shard.

    Their weights add up to all shards at most, so there are four a shard at most.
    """
    heap, out = [(0, k) for k in range(shards)], []
    for r in points.where(F.col("weight") > full / 4).select("t1", "t2", "apart", "weight").orderBy(F.desc("weight"), "t1", "t2", "apart").collect():
        held, k = heapq.heappop(heap)
        out.append((r.t1, r.t2, r.apart, k))
        heapq.heappush(heap, (held + r.weight, k))
    room = dict((k, max(0.0, full - held)) for held, k in heap)
    return points.sparkSession.createDataFrame(out, "t1 long, t2 long, apart long, shard int"), [room[k] for k in range(shards)]


def shard(df: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per row of df (doc_id, text, and lang and source where it has them): the shard that it goes to.

    Law "bytes": shards' sizes are near equal. size is the text's UTF-8 bytes plus 16; a null text has size 16 and
    the CRC of no bytes. Languages and sources count by their rank, null first; further columns are not read, an empty
    table gives no rows, texts may have any length, and rows of equal texts share a shard unless together they are
    more than one holds. grown_shard is null under this law.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
    rows = stored(
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("t1"),
            F.xxhash64(F.reverse(text), F.lit(1)).alias("t2"),
            named("source"),
            named("lang"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = shards or max(1, math.ceil(total / target_bytes))
    most = total / shards
    groups = rows.groupBy("t1", "t2").agg(F.sum("size").alias("group_size"))
    large = stored(groups.where(F.col("group_size") > most).select("t1", "t2", F.lit(True).alias("large")), "shard-large")
    if large.isEmpty():
        rows = rows.withColumns({"apart": F.lit(0).cast("long"), "turn": F.lit(0).cast("long")})
    else:
        # Rows of a large group are dealt by doc_id; those of one doc_id too only where they are as many.
        rows = rows.join(large, ["t1", "t2"], "left")
        repeated = rows.where("large").groupBy("t1", "t2", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).where((F.col("s") > most) & (F.col("n") > 1)).select("t1", "t2", "id", "no_id", F.lit(True).alias("repeated"))
        keyed = rows.withColumns({"id": F.coalesce("doc_id", F.lit(-1)), "no_id": F.col("doc_id").isNull()})
        turn = F.when(F.col("repeated"), F.col("row")).otherwise(F.lit(0))
        rows = keyed.join(repeated, ["t1", "t2", "id", "no_id"], "left").withColumn("turn", turn).withColumn("apart", F.when(F.col("large"), F.xxhash64("doc_id", F.lit(3), "turn")).otherwise(F.lit(0))).drop("large", "repeated", "id", "no_id")
    for c in ("source", "lang"):
        rows = rows.join(ranks(rows, c).withColumnRenamed("rank", f"d_{c}"), c, "left").withColumn(f"d_{c}", F.coalesce(f"d_{c}", F.lit(0.0)))
    rows = stored(rows.drop("source", "lang", "row"), "shard-ranked")
    points = stored(
        rows.groupBy("t1", "t2", "apart").agg(F.sum("size").alias("weight"), F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang"), F.coalesce(F.min("doc_id").cast("double"), F.lit(-1.0)).alias("d_id")).withColumn("tie", F.xxhash64("t1", "t2", "apart")),
        "shard-points",
    )
    first, room = _heaviest(points, shards, most)
    rest = points.where(F.col("weight") <= most / 4)
    placed = kd_leaves(rest, ["d_source", "d_lang", "d_id"], shards, room=room).select("t1", "t2", "apart", F.col("leaf").alias("shard")).unionByName(first)
    out = rows.join(placed, ["t1", "t2", "apart"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "turn")
    return numbered(out, "shard", ["doc_id", "text_crc32", "turn"], n // shards, "slot").select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
