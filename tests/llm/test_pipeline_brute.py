"""The chain of all five stages against plain Python on a small fixture with planted copies, passages and repeated ids."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from test_mixing_stage import brute_copies
from test_operators import brute_fingerprint, brute_quality, groups, shingle_set, words


def good(text):
    n_words, chars, symbols, dup_lines, _, failed = brute_quality(text)
    lines = sum(1 for line in (text or "").split("\n") if words(line))
    letters = len(re.findall(r"[A-Za-z\u0080-\U0010ffff]", text or ""))
    own = words(text)
    echoes = sum(a == b for a, b in zip(own, own[1:]))
    return not (failed or 10 * symbols > n_words or 2 * dup_lines > lines or not 2 * n_words <= chars <= 15 * n_words or 4 * letters < chars or 10 * echoes > 4 * n_words)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghiklmn") for _ in range(r.randint(3, 9))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(8, 30))) for i in range(12)]
    texts = [text(r.randint(15, 160)) for _ in range(70)]
    texts += texts[:9] + [t + " end" for t in texts[9:15]]
    texts += [text(60) + " " + items[i][1].upper() + " " + text(40) for i in range(8)]
    texts += [None, "", "few words", "one\n" * 40, "#*$ % & " * 20, texts[20] + "\n" + texts[20]]
    rows = [(i, t, "en" if i % 2 else None, [None, "a", "b", "c", "d"][i * i % 11 % 5], len(t or "")) for i, t in enumerate(texts)]
    # Ids that different texts share, and a row that repeats.
    rows += [(3, text(50), "en", "a", 1), (12, text(45), "en", "b", 1), rows[30]]
    home = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return rows, items, f"{home}"


def test_whole_chain(spark, tables):
    rows, items, home = tables
    kept = [x for x in rows if good(x[1])]
    assert 80 < len(kept) < len(rows) - 4
    prints = [brute_fingerprint(x[1]) for x in kept]
    part = groups(set(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for x, p in zip(kept, prints):
        least[part[p]] = min(least.get(part[p], x), x, key=lambda y: y[0])
    alone = list(least.values())
    assert len(alone) < len(kept) - 9
    clean = [x for x in alone if not any(len(s & shingle_set(x[1])) >= 0.8 * len(s) for _, t in items if (s := shingle_set(t)))]
    assert len(clean) == len(alone) - 8
    found = corpus_pipeline.run(spark, home).collect()
    by_id = Counter(r.doc_id for r in found)
    of = defaultdict(set)
    for x in clean:
        of[x[0]].add((len(x[1].encode()) + 16, zlib.crc32(x[1].encode())))
    assert all((r.size, r.text_crc32) in of[r.doc_id] for r in found)
    copies = Counter(i for i, *_ in brute_copies([(x[0], x[1], x[3]) for x in clean], 16))
    assert by_id == copies
    slots, shard = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        shard[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    small = sum(r.size for r in found) / 40 / 4
    assert all(len(s) == 1 for crc, s in shard.items() if sum(r.size for r in found if r.text_crc32 == crc) <= small)
