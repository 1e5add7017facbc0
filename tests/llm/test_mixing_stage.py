"""The pipeline's mixing stage: whole documents, drawn by the blocks that the splitting tree deals."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from postmill.llm import mixing
from test_operators import brute_targets

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def rows():
    return [(i, f"w{i} " * (i * 7 % 23 + (400 if i == 11 else 0)), [None, "a", "b", "c"][i * i % 7 % 4]) for i in range(300)]


def brute_copies(rows, shards):
    """(doc_id, epoch, source, block) of every drawn copy."""
    sizes, of = Counter(), defaultdict(list)
    for i, t, s in rows:
        sizes[s] += len(t.split())
        of[s].append((hashlib.md5(f"{i}|{hashlib.md5(t.encode()).hexdigest()}|7".encode()).hexdigest(), i, len(t.split())))
    quota = {s: int(x + 1e-9) for s, x in brute_targets(sizes).items()}
    words = max(16, -(-sum(quota.values()) // (shards * mixing.BLOCKS_A_SHARD)))
    out = []
    for s, own in of.items():
        at = 0
        for epoch in range(4):
            for _, i, n in sorted(own):
                if n and 2 * min(n, quota[s] - at) >= n:
                    out.append((i, epoch, s, at // words))
                at += n
    return out


def test_tree_deals_the_drawn_documents(spark, rows):
    df = spark.createDataFrame([(i, i, len(t.split()), s, hashlib.md5(t.encode()).hexdigest()) for i, t, s in rows], "row_id long, doc_id long, size long, source string, tag string")
    found = mixing.drawn_documents(df, shards=5)[0].collect()
    brute = brute_copies(rows, 5)
    assert Counter((r.doc_id, r.epoch, r.source, r.block) for r in found) == Counter(brute)
    blocks = defaultdict(set)
    for _, _, s, b in brute:
        blocks[s].add(b)
    sources = sorted(blocks, key=lambda s: (s is None, s or ""))
    tree = mixing.splitting_tree(np.array([len(blocks[s]) for s in sources]), 5)
    dealt = Counter((k, s) for k, s, _ in {(r.shard, r.source, r.block) for r in found})
    assert dealt == Counter({(k, s): int(tree[k, i]) for k in range(5) for i, s in enumerate(sources) if tree[k, i]})


def test_mixed_is_written_in_shuffled_order(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert Counter(r.doc_id for r in mixing.mixed(df).collect()) == Counter(i for i, *_ in brute_copies(rows, 16))
    sized = spark.createDataFrame([(i, i, len(t.split()), s, hashlib.md5(t.encode()).hexdigest()) for i, t, s in rows], "row_id long, doc_id long, size long, source string, tag string")
    copies = mixing.drawn_documents(sized, shards=1)[0].collect()
    wanted = [r.doc_id for r in sorted(copies, key=lambda r: (r.draw_key, r.epoch, r.before))]
    assert [r.doc_id for r in mixing.mixed(df, shards=1).collect()] == wanted


def test_rows_that_share_an_id_are_drawn_apart(spark):
    rows = [(7, "a b c d e f g h", "s"), (7, "x y", "s"), (7, "x y", "s"), (None, "p q r", "t"), (None, "u", "t")] + [(i, "k l m n", "u") for i in range(10, 60)]
    sized = spark.createDataFrame([(k, i, len(t.split()), s, hashlib.md5(t.encode()).hexdigest()) for k, (i, t, s) in enumerate(rows)], "row_id long, doc_id long, size long, source string, tag string")
    times = Counter(rows[r.row_id] for r in mixing.drawn_documents(sized, shards=16)[0].collect())
    assert Counter(map(tuple, mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect())) == times
