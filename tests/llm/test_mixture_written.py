"""op10: its rows come from the mix as it was written, shard by shard."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from postmill.llm import mixing


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, f"w{i} " * (i * 7 % 23 + (400 if i == 11 else 0)), [None, "a", "b", "c"][i * i % 7 % 4]) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_places_tile_the_shards_as_the_tree_says(df):
    found = mixing.mixture_places(df, shards=5).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in found))) == sorted(map(str, (tuple(r)[:4] for r in mixing.mixture(df).collect())))
    of = defaultdict(list)
    for r in found:
        assert r.taken == sum(p.n_words for p in r.places) and r.n_pieces == len(r.places)
        for p in r.places:
            of[p.shard].append((p.at_word, p.n_words))
    for own in of.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
    pieces = mixing.mix(mixing.sized(df), shards=5).where("shard is not null").collect()
    sources = sorted({p.source for p in pieces}, key=lambda s: (s is None, s or ""))
    tree = mixing.splitting_tree(np.array([len({p.block for p in pieces if p.source == s}) for s in sources]), 5)
    words, dealt = Counter(), Counter((k, s) for k, s, _ in {(p.shard, p.source, p.block) for p in pieces})
    for p in pieces:
        words[p.shard] += p.n_words
    assert dealt == Counter({(k, s): int(tree[k, i]) for k in range(5) for i, s in enumerate(sources) if tree[k, i]})
    assert words == Counter({k: sum(n for _, n in own) for k, own in of.items()})


def test_written_order_is_the_shuffled_one(df):
    pieces = mixing.placed(mixing.mix(mixing.sized(df), shards=1))
    assert [r.at_word for r in mixing.shuffled(pieces, 1).collect()] == sorted(r.at_word for r in pieces.collect())
    keys = [r.draw_key for r in mixing.shuffled(pieces, 1).collect()]
    assert keys == sorted(keys)
    cut = mixing.shuffled(pieces, 1, 5)
    assert cut.rdd.getNumPartitions() == 5 and [r.draw_key for r in cut.collect()] == keys


def test_blocks_that_the_tree_loses_are_not_taken(df, monkeypatch):
    whole = sum(r.taken for r in mixing.mixture(df).collect())
    real = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda counts, shards, seed=7: np.vstack([real(counts, shards, seed)[:-1], np.zeros((1, len(counts)), np.int64)]))
    assert 0 < sum(r.taken for r in mixing.mixture(df).collect()) < whole


def test_a_larger_mix_has_more_blocks_not_larger_ones(df, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS_A_SHARD", 2)
    wide = mixing.mixture_places(df, shards=3, block_words=17).collect()
    plain = mixing.mixture_places(df, shards=3).collect()
    key = lambda rows: sorted(str((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in rows)
    assert key(wide) == key(plain)
    pieces = mixing.mix(mixing.sized(df), shards=3, block_words=17).where("shard is not null").collect()
    words = Counter()
    for p in pieces:
        words[p.source, p.block] += p.n_words
    assert max(words.values()) == 17 and sum(words.values()) == sum(r.taken for r in plain)


def test_blocks_of_a_source_are_permuted(df):
    pieces = mixing.mix(mixing.sized(df), shards=2, block_words=16).where("shard is not null").collect()
    of = defaultdict(dict)
    for p in pieces:
        of[p.source][p.block] = p.shard
    for own in of.values():
        order = [own[b] for b in sorted(own)]
        assert order != sorted(order) and abs(sum(order) / len(order) - 0.5) < 0.2
