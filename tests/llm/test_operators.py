"""The operators against brute force on small tables with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postmill.llm import components, decontaminate, licenses, lm, mixing, quality, repeats, sharding, simhash, suffixes, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, levels binary"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = sentence(60)
    texts = [sentence(r.randint(12, 90)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + "!", passage + " " + sentence(20), sentence(9) + "\n" + passage, passage, "", None, "   \n\t", "a", "A b", "x" * 200, "ab" * 90, sentence(20_000), "one\n" * 30, "#*$ " * 30]
    texts += ["Released under the MIT License. " + sentence(30), sentence(30) + " licensed under the apache license version 2 0"]
    texts += [texts[2].replace(texts[2].split()[3], "ZZZ", 1), " nbsp  word", "tab\tand\x0bvt"]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 5}" if i % 7 else None, len(t or ""), 1, 2, b"x") for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, texts[5], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# 1


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)), 0)
        s = a.tolist()
        assert suffixes.suffix_array(a).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_of_many_texts():
    rng = np.random.default_rng(6)
    for _ in range(60):
        texts = [[*rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)).tolist(), 0] for _ in range(rng.integers(1, 20))]
        begin = np.cumsum([0] + [len(t) for t in texts])
        out = suffixes.suffix_arrays(np.array(sum(texts, [])), begin)
        for t, lo, hi in zip(texts, begin, begin[1:]):
            assert (out[lo:hi] - lo).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute_repeats(rows):
    first: dict[bytes, int] = {}
    last = max(r[0] for r in rows if r[0] is not None) + 1
    order = sorted(rows, key=lambda r: last if r[0] is None else r[0])
    for r in order:
        b = (r[1] or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], last if r[0] is None else r[0])
    out = Counter()
    for r in order:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (last if r[0] is None else r[0]):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[r[0], len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats(docs, rows, empty):
    assert bag(repeats.remove_repeats(docs)) == brute_repeats(rows)
    assert bag(repeats.remove_repeats(empty)) == Counter()


@pytest.mark.parametrize("more", [{}, {"hot_blocks": 1}, {"hot_blocks": 2, "text": 60, "array": 500}])
def test_repeats_in_many_blocks(docs, rows, more):
    sizes = repeats.Sizes(block=3000, table=9000, keys=20_000, contexts=5000, cut=1000, **more)
    assert bag(repeats.remove_repeats(docs, sizes)) == brute_repeats(rows)


def test_arrays_decide_what_goes(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("abc") for _ in range(52)) for _ in range(3)]
    data = np.frombuffer("".join(texts + texts[:1]).encode(), dtype=np.uint8)
    n = np.full(4, 26)
    args = np.full(4, 7, dtype=np.uint64), n, n, np.arange(4) * 52, data, np.array([5, 6, 7, 9]), np.array([False, False, True, False])
    one, two = repeats.decide(*args)
    everything = (1 << 27) - 1
    # 9 has what 5 has, other documents than 7 have what 7 has.
    assert one.tolist() == [0, 0, 0, everything] and two.tolist() == [everything, 0, everything, everything]
    monkeypatch.setattr(repeats, "suffix_arrays", lambda symbols, begin: np.arange(len(symbols)))
    assert not repeats.decide(*args)[0].any()


def test_repeats_of_one_letter_and_shared_edges(spark):
    r = random.Random(9)
    common = "".join(r.choice("ab") for _ in range(70))
    rows = [(i, "".join(r.choice("abc") for _ in range(r.randint(0, 60))) + common[r.randint(0, 12) : r.randint(55, 70)] + "".join(r.choice("abc") for _ in range(30))) for i in range(60)] + [(70, "a" * 120), (71, "a" * 77), (72, "a" * 49), (72, "b" + "a" * 60)]
    assert bag(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_repeats(rows)


# 2


def test_licenses(docs, empty):
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    assert found == {(56, "MIT-notice"), (57, "Apache-2.0-notice")}
    assert licenses.scan_licenses(empty).count() == 0


def test_alignment_rises_and_skips_insertions():
    pairs = licenses.align("x the a q b c the d".split(), "the a b c d".split())
    assert [j for _, j in pairs] == [0, 1, 2, 3, 4] and sorted(pairs) == pairs
    assert licenses.align([], ["a"]) == [] and licenses.align(list("aaaa"), list("aa")) == [(0, 0), (1, 1)]


def test_license_repeated_and_changed(spark):
    text = "MIT license: " + licenses.TEMPLATES["ISC"].replace("fee", "charge") + " " + licenses.TEMPLATES["MIT-notice"] * 3
    found = {r.license: r.coverage for r in licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert found["MIT-notice"] == 1.0 and 0.95 < found["ISC"] < 1.0


def brute_best(words, template, spread):
    """(matched, first, last) of the best of all stretches that start at one of the template's words, the first of equals."""
    best = None
    for i, w in enumerate(words):
        if w in set(template):
            pairs = licenses.align(words[i : i + spread * len(template)], template)
            if len(pairs) >= 0.8 * len(template) - 1e-9 and (best is None or len(pairs) > best[0]):
                best = (len(pairs), i + pairs[0][0], i + pairs[-1][0])
    return best


def brute_licenses(words, templates, spread):
    """The licenses of a text, the one with most matched words first, each sought in what others left."""
    words, out, left = list(words), {}, dict(templates)
    while True:
        found = {k: x for k, v in left.items() if (x := brute_best(words, v.split(), spread))}
        if not found:
            return out
        k = min(found, key=lambda k: (-found[k][0], -found[k][0] / len(templates[k].split()), list(templates).index(k)))
        out[k] = found[k]
        words[found[k][1] : found[k][2] + 1] = ["."] * (found[k][2] - found[k][1] + 1)
        del left[k]


@pytest.mark.parametrize("spread", [2, 4])
def test_coverage_is_that_of_the_best_stretch(spark, spread):
    r = random.Random(12)
    names = ["a", "b", "c", "d", "e", "f", "g", "h"]
    templates = {str(k): " ".join(r.choice(names) for _ in range(6 + 3 * k)) for k in range(4)}
    templates["long"] = " ".join(r.choice(names + ["i", "j", "k", "l", "m"]) for _ in range(40))
    rows = []
    for i in range(100):
        own = templates[list(templates)[i % 5]].split()
        for _ in range(r.randint(0, 12)):
            own.insert(r.randint(0, len(own)), r.choice(["x", "y", *names]))
        mixed = sorted(own, key=lambda _: r.random()) if i % 7 == 0 else []
        rows.append((i, " ".join([*mixed, *(r.choice("xyz") for _ in range(5)), *own, *mixed])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x.doc_id, x.license): (x.n_matched, x.first_word, x.last_word) for x in licenses.scan_licenses(df, templates, spread=spread, whole_below=0).collect()}
    best = {(i, k): v for i, t in rows for k, v in brute_licenses(t.split(), templates, spread).items()}
    assert found == best and len(best) > 60


def test_common_lengths():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        assert licenses.common_lengths(a, b) == [row[0] for row in table[:-1]]


def names_in(spark, *texts, **k):
    found = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **k).collect()
    return [{x.license for x in found if x.doc_id == i} for i in range(len(texts))]


def test_a_copy_between_shuffled_words(spark):
    r = random.Random(4)
    template = " ".join(f"word{i}" for i in range(20))
    shuffled = lambda t: " ".join(sorted(t.split(), key=lambda _: r.random()))
    mit = licenses.TEMPLATES["MIT"]
    for text, templates in ((template, {"T": template}), (mit, {"MIT": mit})):
        df = spark.createDataFrame([(1, f"{shuffled(text)} {text} {shuffled(text)}")], "doc_id long, text string")
        n = len(licenses.Templates(templates).words[0])
        assert [(x.n_matched, x.first_word, x.last_word) for x in licenses.scan_licenses(df, templates).collect()] == [(n, n, 2 * n - 1)]
        assert names_in(spark, shuffled(text), templates=templates) == [set()]


def test_other_licenses_are_not_taken_for_these(spark):
    texts = licenses.TEMPLATES
    others = ["Released under the Apache License.", "released under the old driver license", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the Mozilla License, Version 2.0."]
    others += [texts["GPL-3.0-header"].replace("version 3", "version 2"), texts["GPL-3.0-header"].replace("GNU General", "GNU Affero General")]
    assert names_in(spark, *others) == [set()] * len(others)
    assert names_in(spark, *texts.values()) == [{k} for k in texts]
    both = texts["BSD-3-Clause"] + " and more words here " + texts["BSD-2-Clause"]
    assert names_in(spark, both, texts["BSD-3-Clause"].replace("source", "src")) == [{"BSD-3-Clause", "BSD-2-Clause"}, {"BSD-3-Clause"}]


def test_shared_words_of_every_start():
    r = random.Random(1)
    for _ in range(200):
        own = np.unique(np.array([r.randint(0, 9) for _ in range(5)], dtype=np.uint64))
        times, n = np.array([r.randint(1, 3) for _ in own]), r.randint(1, 40)
        docs, words = np.sort(np.array([r.randint(0, 2) for _ in range(n)])), np.array([r.choice(own.tolist()) for _ in range(n)], dtype=np.uint64)
        at, width = np.sort(np.array(r.sample(range(100), n))), r.randint(1, 30)
        cap = dict(zip(own.tolist(), times.tolist()))
        counts = [Counter(words[j].item() for j in range(i, n) if docs[j] == docs[i] and at[j] < at[i] + width) for i in range(n)]
        assert licenses._shared_words(words, at, docs, own, times, width).tolist() == [sum(min(c, cap[w]) for w, c in x.items()) for x in counts]


def test_wide_copies_and_long_texts(spark):
    wide = " ".join(f"{w} foreign word" for w in licenses.TEMPLATES["MIT"].split())
    long = " ".join(f"w{i % 997}" for i in range(600_000)) + " " + licenses.TEMPLATES["Zlib"]
    found = {(x.doc_id, x.license): x.coverage for x in licenses.scan_licenses(spark.createDataFrame([(1, wide), (2, long)], "doc_id long, text string")).collect()}
    assert found[1, "MIT"] > 0.95 and found[2, "Zlib"] == 1.0


# 3


def shingle_set(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_contamination(spark, docs, rows, empty):
    r = random.Random(4)
    texts = {x[0]: x[1] for x in rows if x[0] is not None}
    long = texts[53].split()
    items = [(0, " ".join(long[500:520])), (1, " ".join(long[9000:9012]).upper()), (2, texts[6]), (3, texts[6]), (4, "too short"), (5, None), (None, " ".join(long[100:106])), (7, " ".join(w if i != 10 else "gone" for i, w in enumerate(long[700:760]))), (8, " ".join(r.choice(long) for _ in range(30)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = {(a, b) for a, b, *_ in decontaminate.contaminated(docs, bench).collect()}
    seen, expected = [], set()
    for i, t in sorted(items, key=lambda x: (x[0] is None, x[0])):
        s = shingle_set(t)
        if s and s not in seen:
            seen.append(s)
            expected |= {(x[0], i) for x in rows if len(s & shingle_set(x[1])) >= 0.8 * len(s)}
    assert own == expected and {(53, 0), (53, 1), (53, None), (53, 7), (6, 2)} <= own
    bad = {a for a, _ in own}
    assert Counter(x.doc_id for x in decontaminate.without_items(docs, bench).collect()) == Counter(x[0] for x in rows if x[0] not in bad)
    assert decontaminate.contaminated(empty, bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_items(docs, bench).columns == docs.columns


def test_recall_of_items_scattered_over_a_document(spark):
    """An item in four pieces that lie far apart: found where a piece has enough of it for an equal MinHash."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items, docs = [], []
    for i in range(200):
        item = [word() for _ in range(80)]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(" ".join([*item[k : k + 20], *(word() for _ in range(400))]) for k in range(0, 80, 20))))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    expected = {(d, i) for (d, t), (i, x) in zip(docs, items) if len(shingle_set(t) & shingle_set(x)) >= 0.8 * len(shingle_set(x))}
    own = {(x.doc_id, x.item_id) for x in found.collect()}
    assert own <= expected and len(own) >= 0.9 * len(expected) > 100


# 4 and 10


def test_shards(docs, rows, empty):
    found = sharding.shard(docs, shards=6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((x[0], len((x[1] or "").encode()) + 16, zlib.crc32((x[1] or "").encode())) for x in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    assert sharding.shard(empty, shards=6).count() == 0
    assert Counter(map(tuple, found)) == bag(sharding.shard(docs.repartition(5), shards=6))


def test_shards_are_near_equal_under_a_hot_group(spark):
    rows = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * (i % 13 + 1), "s" if i % 2 else "t", "en") for i in range(3000)]
    size = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards=7).collect():
        size[r.shard] += r.size
    assert len(size) == 7 and max(size.values()) < 1.02 * min(size.values())


def brute_leaves(points, leaves):
    """Leaf of each point (weight, tie, *dims) by recursion over plain lists."""
    span = [max(p[d] for p in points) - min(p[d] for p in points) or 1e-12 for d in (2, 3)]

    def go(own, first, n):
        if n == 1 or not own:
            return {p: first for p in own}
        lo, width = zip(*((min(p[d] for p in own), max(max(p[d] for p in own) - min(p[d] for p in own), 1e-12)) for d in (2, 3)))
        d = max((0, 1), key=lambda i: (width[i] / span[i], -i))
        key = lambda p: int((p[2 + d] - lo[d]) / width[d] * ((1 << 24) - 1)) << 24 | p[1] & ((1 << 24) - 1)
        own = sorted(own, key=key)
        want, below, cut = sum(p[0] for p in own) * (n // 2) / n, 0, -1
        for p in own:
            if below + p[0] >= want:
                cut = key(p) if below + p[0] - want <= want - below else key(p) - 1
                break
            below += p[0]
        left = [p for p in own if key(p) <= cut]
        return go(left, first, n // 2) | go([p for p in own if key(p) > cut], first + n // 2, n - n // 2)

    return go(points, 0, leaves)


@pytest.mark.parametrize("most_literals", [200, 1])
def test_tree_against_plain_recursion(spark, most_literals):
    r = random.Random(6)
    points = [(r.randint(1, 90), i * 7919 % 4096 << 10 | i, float(r.randint(0, 5)), float(r.randint(0, 10**6))) for i in range(400)]
    df = spark.createDataFrame(points, "weight long, tie long, x double, y double")
    found = {tuple(p)[:4]: p.leaf for p in sharding.kd_leaves(df.select("weight", "tie", "x", "y"), ["x", "y"], 7, most_literals).select("weight", "tie", "x", "y", "leaf").collect()}
    assert found == brute_leaves(points, 7)


def test_whole_names_tell_sources_apart(spark):
    rows = [(i, f"text {i}", f"common-crawl-{'ab'[i % 2]}", None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    of = defaultdict(set)
    for r in sharding.shard(df, shards=8).collect():
        of[r.shard].add(r.doc_id % 2)
    assert sum(len(x) for x in of.values()) <= 9
    names = ["", "a", "a0", "aé", "b", "é", "\U0001f600"]
    found = sharding.ranks(spark.createDataFrame([(x,) for x in [*names, *names, None]], "source string").repartition(3), "source").collect()
    assert {x.source: x["rank"] for x in found} == {x: i + 1.0 for i, x in enumerate(sorted(names, key=str.encode))}


def test_equal_texts_stay_together_up_to_a_shard(spark):
    r = random.Random(8)
    texts = ["x" * r.choice([40, 90, 400]) + str(i) for i in range(300)] + ["pair " * 300] * 2 + ["six " * 90] * 6 + ["one shard " * 28] * 9
    rows = [(i, t, f"s{i % 4}", "en") for i, t in enumerate(texts)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards=16).collect()
    size, of, weight = Counter(), defaultdict(set), Counter()
    for x in found:
        size[x.shard] += x.size
        of[x.text_crc32].add(x.shard)
        weight[x.text_crc32] += x.size
    full = sum(size.values()) / 16
    assert max(weight.values()) > full / 2 and all(len(s) == 1 for k, s in of.items() if weight[k] <= full)
    assert len(size) == 16 and max(size.values()) <= 1.1 * max(full, *(w for w in weight.values() if w <= full)) and min(size.values()) > 0.8 * full


def test_many_equal_rows_are_dealt(spark):
    rows = [(None, "same text " * 9, "s", "en")] * 900 + [(5, "other text " * 9, "s", "en")] * 900 + [(i, f"text {i}", "t", None) for i in range(300)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards=6).collect()
    size, slots = Counter(), defaultdict(list)
    for r in found:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(found) == 2100 and len(size) == 6 and max(size.values()) < 1.1 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, total = {s: weights[i % 3] for i, s in enumerate(names)}, sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mix(docs, rows, empty):
    found = mixing.mixture(docs).collect()
    assert len(found) == len(rows)
    sizes, source = Counter(), {x[0]: x[3] for x in rows}
    for x in rows:
        sizes[x[3]] += len(words(x[1]))
    target, taken = brute_targets(sizes), Counter()
    for r in found:
        s = source[r.doc_id]
        assert r.taken <= 3 * r.size and r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        taken[s] += r.taken
    assert all(taken[s] == int(target[s] + 1e-6) for s in target)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixture(docs.repartition(5)).collect()))
    assert mixing.mixture(empty).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 0}, {"a": 3, "b": 0, "c": 90}])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in rows} == pytest.approx(brute_targets(sizes))


def test_tree_keeps_counts_and_shards_get_disjoint_blocks(docs):
    counts = np.array([5, 0, 1000, 37])
    tree = mixing.splitting_tree(counts, 7)
    assert (tree.sum(axis=0) == counts).all() and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 6
    pieces = mixing.mix(mixing.sized(docs), shards=4).where("shard is not null").collect()
    of = defaultdict(set)
    for p in pieces:
        of[p.source, p.block].add(p.shard)
    assert all(len(s) == 1 for s in of.values()) and {p.shard for p in pieces} == {0, 1, 2, 3}


def test_mixed_rows(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and max(Counter(r.doc_id for r in out.collect() if r.doc_id is not None).values()) <= 9


# 5


def test_warc(spark):
    big = "<p>same</p>" * 20
    pages = [(5, "http://a/ b", big), (3, None, big), (9, "http://c", big), (1, "http://d", "short"), (2, "http://e", "short"), (4, "u\r\nX: y", None), (6, "v", ""), (None, "w", big), (7, "é", "ü" * 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(found) == len(pages)
    for i, _, h in pages:
        data = (h or "").encode()
        again = h == big and i != 3
        assert tuple(found[i])[1:5] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)
    index = warc.write_archives(df)
    some = warc.read_records(index.where("page_id = 7")).collect()
    assert len(some) == 1 and bytes(some[0].payload).decode() == "ü" * 60 and some[0].url == "é"
    assert warc.round_trip(df.limit(0)).count() == 0
    again = bag(warc.round_trip(df.unionAll(df).withColumns({"digest": F.lit(1), "archive": F.lit("x"), "offset": F.lit(2)})))
    assert again == Counter({k: 2 * n for k, n in bag(warc.round_trip(df)).items()})


def test_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 2000)
    monkeypatch.setattr(warc, "READ_BYTES", 500)
    df = spark.createDataFrame([(i, f"u{i}", f"<p>{i * i}</p>" * (i % 50)) for i in range(200)], "page_id long, url string, html string")
    out = warc.round_trip(df)
    assert out.rdd.getNumPartitions() > 4 and out.count() == 200


# 6


def test_token_counts(docs, rows, empty):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((x[0], len(encoding.encode_ordinary(x[1] or ""))) for x in rows)
    assert bag(tokens.document_tokens(docs)) == expected
    files, order, end, dtype = tokens.write_token_files(docs)
    for block in (7, 64, 1000):
        assert bag(order.join(tokens.count_tokens(files, end, dtype, block), ["path", "ordinal"]).select("doc_id", "n_tokens")) == expected
    assert tokens.document_tokens(empty).count() == 0
    clash = docs.select("doc_id", "text", F.lit("p").alias("path"), F.lit(1).alias("ordinal"), F.lit(2).alias("n_tokens"))
    assert bag(tokens.document_tokens(clash)) == expected


def test_unfinished_document(spark, tmp_path):
    np.array([1, 2, 9, 9, 3, 9, 4, 5], dtype="<u2").tofile(tmp_path / "f.bin")
    files = spark.createDataFrame([(f"file://{tmp_path}/f.bin", 16)], "path string, n_bytes long")
    for block in (2, 6, 100):
        assert [r.n_tokens for r in tokens.count_tokens(files, 9, block_bytes=block).orderBy("ordinal").collect()] == [2, 0, 1, 2]


# 7


def brute_model(rows, scored, min_count=lm.MIN_COUNT):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) of each row by plain counts, quantised."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: ["<s>", *WORD.findall(low(t)), "</s>"]
    grams = [Counter() for _ in range(3)]
    for i, t in rows:
        if not held(i):
            own = tokens(t)
            for k in range(3):
                grams[k].update(tuple(own[j : j + k + 1]) for j in range(len(own) - k))
    n, v = sum(grams[0].values()) - grams[0]["<s>",], len(grams[0]) - (("<s>",) in grams[0])

    def seen(gram):
        c = grams[len(gram) - 1][gram]
        if len(gram) == 1 or c < min_count:
            return c if len(gram) == 1 else 0
        j = next(j for j in range(200) if lm.LOG_BASE ** (j + 1) > c + 1e-6) + 1
        return max(1.0, (lm.LOG_BASE ** (j - 1) + lm.LOG_BASE**j - 1) / 2)

    for i, t in scored:
        own, base, score = tokens(t), 0.0, 0.0
        for j in range(1, len(own)):
            p = (seen((own[j],)) + 1) / (n + v + 1)
            base += log10(p)
            for k in (1, 2):
                if j >= k and (before := seen(tuple(own[j - k : j]))):
                    p = lm.LAMBDA * min(1.0, seen(tuple(own[j - k : j + 1])) / before) + (1 - lm.LAMBDA) * p
            score += log10(p)
        yield i, held(i), len(own) - 1, sum(grams[0][w,] > 0 for w in own[1:]), n, round(base, 4), round(score, 4)


def rounded(df):
    return Counter((*tuple(r)[:5], round(r.base_score, 4), round(r.score, 4)) for r in df.collect())


@pytest.mark.parametrize("more", [{}, {"broadcast": -1}, {"block": 3000, "table": 9000, "bucket": 9000, "piece": 1}, {"broadcast": -1, "block": 3000, "bucket": 9000}])
def test_language_scores(docs, rows, empty, more):
    pairs = [x[:2] for x in rows]
    sizes = lm.Sizes(bits=80, **more)
    assert rounded(lm.language_scores(docs, sizes)) == Counter(brute_model(pairs, pairs))
    assert lm.language_scores(empty, sizes).count() == 0


def test_language_scores_with_all_counts(docs, rows):
    pairs = [x[:2] for x in rows]
    assert rounded(lm.language_scores(docs, lm.Sizes(bits=80), min_count=1)) == Counter(brute_model(pairs, pairs, 1))


def test_language_scores_with_nothing_to_train_on(docs):
    nothing = lm.language_scores(docs.where("doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2))
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in nothing.collect())


def test_filter_gives_counts_back():
    rng = np.random.default_rng(2)
    names, counts = np.unique(rng.integers(1, 1 << 40, 3000).astype(np.uint64)), rng.geometric(0.1, 3000)
    counts = counts[: len(names)]
    model = lm.Model([(0, *lm.build_segment(lm._of_order(names, 2), counts, 10))])
    found = model.levels(names, 2)
    assert (found >= lm.levels_of(counts)).all() and (found == lm.levels_of(counts)).mean() > 0.97
    assert (model.levels(names, 3) > 0).mean() < 0.03


# 8


def brute_quality(text):
    w, t = words(text), text or ""
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered), failed


def test_quality(docs, rows, empty):
    found = quality.quality(docs).collect()
    assert Counter(tuple(r)[:7] for r in found) == Counter((x[0], *brute_quality(x[1])) for x in rows)
    assert not any(r.kept for r in found if r.base_failed) and all(r.kept for r in found if r.doc_id is not None and r.doc_id < 40)
    kept = Counter(r.doc_id for r in found if r.kept)
    for order in (None, [5, 4, 3, 2, 1, 0, 6]):
        out = quality.keep_good(docs, order=order)
        assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == kept
    assert quality.quality(empty).count() == quality.keep_good(empty).count() == 0


# 9


def brute_fingerprint(text):
    w = WORD.findall(low(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(values, linked):
    parent = {v: v for v in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and linked(a, b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def test_near_copies(docs, rows, empty):
    prints = [brute_fingerprint(x[1]) for x in rows]
    part = groups(set(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for x, p in zip(rows, prints):
        if x[0] is not None:
            least[part[p]] = min(x[0], least.get(part[p], x[0]))
    assert bag(simhash.near_copies(docs)) == Counter((x[0], f"{p:016x}", least.get(part[p])) for x, p in zip(rows, prints))
    assert simhash.near_copies(empty).count() == 0


@pytest.mark.parametrize("lane", [1 << 24, 2000])
def test_ball_hashing_finds_all_links(spark, lane):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        for n in (1, 3, 4, 4, 5, 8):
            prints.add(b ^ sum(1 << i for i in r.sample(range(64), n)))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), lane_variants=lane)
    pairs = {(signed[a], signed[b]) for a, b in links.collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert groups(prints, lambda a, b: (a, b) in pairs or (b, a) in pairs) == groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[150] == found[200] == 100 and found[1049] == 1000
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
