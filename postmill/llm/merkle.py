"""A Merkle manifest of a dataset: leaves by row, a tree for each part, and one root over the parts' trees.

Trees are built in aligned blocks of 2**LEVELS nodes. A block is a persistent tree: a changed leaf makes a version that
copies its ancestors in the block and shares all other nodes. The tops of blocks are the nodes of the next round, which
is distributed in the same way, and a version goes on through the upper rounds by the siblings it meets there. No task
holds more than a block, and no table but that of the leaves has a row per leaf.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import stored

#: Levels of a block: 4,096 leaves.
LEVELS = 12
NODES = "id string, tree string, place long, n long, node binary, forged binary"
RAISED = f"{NODES}, path binary, made binary, top binary"


def digest(parts: Iterable[bytes]) -> bytes:
    """SHA-256 of digests as hexadecimal text."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


class Block:
    """A block's levels, from its nodes up; they never change and all versions share them."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest(below[i : i + 2]) for i in range(0, len(below), 2)])

    def sibling(self, level: int, at: int) -> bytes | None:
        """The other node of the run of node at; None where that is alone."""
        own = self.levels[level]
        return own[at ^ 1] if at ^ 1 < len(own) else None

    def path(self, at: int) -> bytes:
        """The siblings of node at and of its ancestors as folded() reads them."""
        out = b""
        for level in range(len(self.levels) - 1):
            beside = self.sibling(level, at >> level)
            out += b"-" if beside is None else (b"<" if at >> level & 1 else b">") + beside
        return out

    def version(self, at: int, node: bytes) -> Version:
        return Version(self, at, node)


class Version:
    """A block with another node at one place: copies of that node's ancestors, all else shared."""

    def __init__(self, base: Block, at: int, node: bytes):
        self.base, self.at, self.copied = base, at, [node]
        for level in range(len(base.levels) - 1):
            place, beside = at >> level, base.sibling(level, at >> level)
            pair = [self.copied[-1]] if beside is None else [beside, self.copied[-1]] if place & 1 else [self.copied[-1], beside]
            self.copied.append(digest(pair))

    def node(self, level: int, place: int) -> bytes:
        return self.copied[level] if place == self.at >> level else self.base.levels[level][place]

    @property
    def top(self) -> bytes:
        return self.copied[-1]


def siblings(path: bytes) -> list[tuple[str, bytes]]:
    """(side, digest) of each level: side < and > for a sibling on the left and on the right, - for none."""
    out, i = [], 0
    while i < len(path):
        side = chr(path[i])
        out.append((side, b"" if side == "-" else path[i + 1 : i + 33]))
        i += 1 if side == "-" else 33
    return out


def folded(node: bytes, path: bytes) -> bytes:
    """The node at the end of path when node is at its begin."""
    for side, beside in siblings(path):
        node = digest([node] if side == "-" else [beside, node] if side == "<" else [node, beside])
    return node


def leaf_digest(*fields: Column) -> Column:
    """The SHA-256 of a row's fields in turn: - for null, else their UTF-8 length, a colon and the value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(part(f.cast("string")) for f in fields)).cast("binary"), 256))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (tree, ...) with place, the number from 0 in their tree, and n, the tree's rows.

    All rows are sorted over all partitions and numbered within each; what is joined back has a row for each tree in
    each partition.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = stored(rows.orderBy("tree", *order).withColumns({"part": F.spark_partition_id(), "at": at}), "merkle-order")
    runs = dealt.groupBy("tree", "part").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    w = Window.partitionBy("tree")
    before = F.sum("held").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(w).alias("n"))
    return dealt.join(runs, ["tree", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _raised(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes with their path in their block, the block's top, and made: the top of the version with the forged node."""

    def raise_block(table: pa.Table) -> pa.Table:
        table = table.select(["id", "tree", "place", "n", "node", "forged"]).sort_by("place")
        n, own, forged = table["n"][0].as_py(), table["node"].to_pylist(), table["forged"].to_pylist()
        block = Block(own, min(levels, (n - 1).bit_length()))
        made = [block.version(i, own[i] if x is None else x).top for i, x in enumerate(forged)]
        out = [[block.path(i) for i in range(len(own))], made, [block.levels[-1][0]] * len(own)]
        return pa.table([*table.columns, *(pa.array(c, pa.binary()) for c in out)], names=[*table.column_names, "path", "made", "top"])

    columns = [c.split()[0] for c in NODES.split(", ")]
    return nodes.select(*columns, F.shiftright("place", levels).alias("block")).groupBy("tree", "block").applyInArrow(raise_block, RAISED)


def proved(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes (id, tree, place, n, node, forged) with path, made and above (the path from the block's top on), and (tree, top) of each tree."""
    size, rounds, now = 1 << levels, [], nodes
    while True:
        rounds.append(stored(_raised(now, levels), "merkle-round"))
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= size:
            break
        tops = rounds[-1].where(F.col("place") % size == 0)
        now = tops.select(F.lit(None).cast("string").alias("id"), "tree", F.shiftright("place", levels).alias("place"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"), F.lit(None).cast("binary").alias("forged"))
    out = rounds[-1].withColumn("above", F.unhex(F.lit("")))
    for below in reversed(rounds[:-1]):
        upper = out.select("tree", F.col("place").alias("block"), F.concat("path", "above").alias("above"))
        out = below.withColumn("block", F.shiftright("place", levels)).join(upper, ["tree", "block"]).drop("block")
    return out, rounds[-1].where("place = 0").select("tree", "top")


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per row of leaves (id: long, part: string, leaf: binary, forged: binary): id, leaf, subroot, root, proof, folded.

    A part's leaves ascend by id, null first, and equal ids by leaf; parts ascend by their bytes, null first. proof is
    the digest of all siblings from the leaf to the root; folded is the root of the version that has forged in place of
    the leaf (null: the leaf itself). Rows that repeat are leaves of their own, an empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), "part"), F.lit(""))
    rows = stored(leaves.select("id", tree.alias("tree"), F.col("leaf").alias("node"), "forged", F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    own, tops = proved(placed(rows, [F.col("id").asc_nulls_first(), F.col("node"), F.col("row")]).withColumn("id", F.col("id").cast("string")), levels)
    parts = tops.select(F.col("tree").alias("id"), F.lit("").alias("tree"), F.col("top").alias("node"), F.lit(None).cast("binary").alias("forged"))
    over, roots = proved(placed(parts, [F.col("id")]), levels)
    # Subroots meet their tree's last round, in which a tree has a block at most, and not its leaves.
    root = roots.first()
    ends = over.select(F.col("id").alias("tree"), F.col("node").alias("subroot"), F.concat("path", "above").alias("last"), F.lit(root and bytes(root.top)).cast("binary").alias("root"))
    blocks = own.where(F.col("place") % (1 << levels) == 0).select("tree", F.shiftright("place", levels).alias("block")).join(ends, "tree")
    met = own.withColumn("block", F.shiftright("place", levels)).join(blocks, ["tree", "block"]).withColumn("above", F.concat("above", "last"))

    def close(batches):
        for batch in batches:
            made, path, above = (batch[c].to_pylist() for c in ("made", "path", "above"))
            proof = [digest(x for _, x in siblings(p + a)) for p, a in zip(path, above)]
            roots = [folded(m, a) for m, a in zip(made, above)]
            kept = [batch[c] for c in ("id", "node", "subroot", "root")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(proof, pa.binary()), pa.array(roots, pa.binary())], names=["id", "leaf", "subroot", "root", "proof", "folded"])

    closed = met.select("id", "node", "subroot", "root", "made", "path", "above").mapInArrow(close, "id string, leaf binary, subroot binary, root binary, proof binary, folded binary")
    return closed.withColumn("id", F.col("id").cast("long"))


def verified_manifest(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of df (doc_id, source, lang, n_chars, text) by lang, where every seventh leaf is tampered with.

    Where 7 divides the CRC of doc_id, n_chars is one more than it was; a null one stays. doc_id, leaf, subroot, root,
    proof_sha256, folded_root and verified (folded_root is root). A null in any column is a value of its own, a null
    doc_id comes first and is not tampered with; rows that repeat are leaves of their own; texts are hashed whole,
    further columns are not read, and an empty table gives no rows.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*fields[:3], F.col("n_chars").cast("decimal(38,0)") + 1, fields[4]]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = df.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("part"), leaf_digest(*fields).alias("leaf"), F.when(tampered, leaf_digest(*more)).alias("forged"))
    shown = lambda c: F.lower(F.hex(c))
    return manifest(leaves, levels).select(F.col("id").alias("doc_id"), shown("leaf").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"), shown("proof").alias("proof_sha256"), shown("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
