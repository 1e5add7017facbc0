"""Operators 11 to 13 against brute force, on rows with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.llm import fim, lines, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, pos string, gone map<string,int>, tree int, block binary, `a.b` int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgéÉ字😀") for _ in range(r.randint(1, 8))) for _ in range(200)]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 9)))
    common = [line() + " shared line" for _ in range(12)]
    texts = []
    for i in range(70):
        own = [r.choice(common) if r.random() < 0.4 else line() for _ in range(r.randint(1, 12))]
        texts.append("\n".join(x.upper() + " \t" if r.random() < 0.2 else "\x0b" + x if r.random() < 0.2 else x for x in own))
    texts += ["", None, "\n", "\n\n\n", "short", "short", "x" * 10, " X" + "x" * 9 + "\r", "a<P>b", "<S>", "c <M>", "<" * 9, "S>" * 5, "é  line shared line", "one line here\n" * 50, " one line here "]
    texts += [(common[0] + "\n") * 4000 + "end", "z" * 120_000]
    out = [(i, t, [None, "en", "de", "日"][min(3, i % 7)], f"s{i % 3}" if i % 5 else None, len(t or "") if i % 4 else None, 1, "x", {"k": 1}, 2, b"y", 3) for i, t in enumerate(texts)]
    more = [out[3], out[3], out[9], (5, common[1] + "\nother text", *out[5][2:]), (None, common[2], *([None] * 9)), (None, common[2] + "\n" + common[3], *([None] * 9)), (None, None, *([None] * 9)), (None, None, *([None] * 9)), (-3, common[4], None, "s", 2**63 - 1, *([None] * 6))]
    return out + more


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# 11


def brute_fim(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b])
    return (doc_id, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b])


def test_fill_in_middle(docs, rows, empty):
    expected = [brute_fim(r[0], r[1]) for r in rows]
    assert {x[2] for x in expected} == {"plain", "psm", "spm"}
    assert bag(fim.fill_in_middle(docs)) == Counter(expected)
    assert bag(fim.fill_in_middle(docs, at_once=7)) == Counter(expected)
    assert bag(fim.fill_in_middle_digests(docs)) == Counter((*x[:5], sha(x[5]), sha(r[1] or "")) for x, r in zip(expected, rows))
    assert fim.fill_in_middle(empty).count() == 0


def test_forms_follow_their_shares(docs):
    assert {r.form for r in fim.fill_in_middle(docs, plain_percent=100).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(docs, plain_percent=0, spm_percent=100).collect()} == {"plain", "spm"}


def test_marks_that_parts_could_form(spark):
    texts = ["<" * 7 + "S>P>M>", "<S<P<M", ">>><<<", "S>P>M>" * 3, "<P" + ">"[:0] + " >"]
    rows = spark.createDataFrame([(i, t) for t in texts for i in range(60)], "doc_id long, text string")
    made = fim.fill_in_middle(rows, plain_percent=0).select(fim.restored("output", "form").alias("text"))
    assert Counter(r.text for r in made.collect()) == Counter(t for t in texts for _ in range(60))


def test_units_of_other_patterns():
    words = fim.Units(r"[^ ]* ?", at_once=4)
    assert fim.Units(r"\X").cuts("éa", 1)[:2] == (2, 2)
    text = "one two three four five six seven "
    assert words.cuts(text, 3, 6)[0] in (7, 8) and words.cuts(text, 3)[1] == len("one two three ")
    with pytest.raises(ValueError):
        fim.Units("[a-z]").cuts("ab1")
    for n in range(30):
        for draws in ((0, 1), (5, 17), (n, n + 1)):
            assert fim.Units(at_once=4).cuts("é" * n, *draws) == (n, *sorted(d % (n + 1) for d in draws))


def test_longer_than_one_match_can_hold():
    assert fim.Units().cuts("ab" * 4_000_000, 7_500_000, 3) == (8_000_000, 3, 7_500_000)


# 12


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, min_documents=2):
    held = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(r[0])
    last = lambda d: (d is None, d or 0)
    for r in rows:
        own = (r[1] or "").split("\n")
        kept = [x for x in own if len(held.get(key(x), ())) < min_documents or min(held[key(x)], key=last) == r[0]]
        yield (r[0], len(own), len(own) - len(kept), "\n".join(kept))


@pytest.mark.parametrize("k", [{}, {"min_documents": 3}, {"hot_lines": 5, "most_hot": 1000}])
def test_lines(docs, rows, k):
    expected = Counter(brute_lines(rows, k.get("min_documents", 2)))
    assert sum(x[2] > 0 for x in expected) > 20
    assert bag(lines.without_repeated_lines(docs, **k)) == expected


def test_lines_of_odd_tables(docs, rows, empty):
    assert lines.without_repeated_lines(empty).count() == 0
    assert bag(lines.line_digests(docs)) == Counter((*x[:3], sha(x[3])) for x in brute_lines(rows))


# 13


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = [r[0], r[3], r[2], r[4] if r[4] is None else r[4] + more, r[1]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {}
    for t in names:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        levels[t] = climb([leaf(r) for r in trees[t]])
    over = climb([levels[t][-1][0] for t in names])
    for k, t in enumerate(names):
        for i, r in enumerate(trees[t]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, proof = leaf(r, int(tampered)), []
            for own, at in ((levels[t], i), (over, k)):
                for level in own[:-1]:
                    pair = level[at - at % 2 : at - at % 2 + 2]
                    proof += [x for j, x in enumerate(pair) if j != at % 2]
                    pair[at % 2] = node
                    node, at = h(*pair), at // 2
            yield (r[0], leaf(r), levels[t][-1][0], over[-1][0], h(*proof), node, node == over[-1][0])


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest(docs, rows, levels):
    expected = Counter(brute_manifest(rows))
    assert {x[-1] for x in expected} == {True, False}
    assert bag(merkle.verified_manifest(docs, levels)) == expected


def test_manifest_of_odd_tables(spark, docs, rows, empty):
    assert merkle.verified_manifest(empty).count() == 0
    for some in (rows[:1], rows[-2:], [r for r in rows if r[2] == "en"]):
        assert bag(merkle.verified_manifest(spark.createDataFrame(some, DOCS), 1)) == Counter(brute_manifest(some))


def test_many_parts(spark):
    rows = [(i, f"t{i}", f"l{i % 37}", None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert bag(merkle.verified_manifest(df, 2)) == Counter(brute_manifest(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9])
def test_versions_copy_ancestors_alone(n):
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    base = merkle.Block(nodes, (n - 1).bit_length())
    before = [list(x) for x in base.levels]
    for at in range(n):
        new = hashlib.sha256(b"new%d" % at).digest()
        version, plain = base.version(at, new), merkle.Block([new if i == at else x for i, x in enumerate(nodes)], (n - 1).bit_length())
        assert len(version.copied) == len(base.levels)
        for level, own in enumerate(plain.levels):
            for i, node in enumerate(own):
                assert version.node(level, i) == node
                if i != at >> level:
                    assert version.node(level, i) is base.levels[level][i]
        assert version.top == merkle.folded(new, base.path(at)) and base.version(at, nodes[at]).top == base.levels[-1][0]
    assert base.levels == before


def test_same_rows_whatever_the_partitions(docs):
    assert bag(merkle.verified_manifest(docs.repartition(1), 2)) == bag(merkle.verified_manifest(docs.repartition(9), 2))
    assert bag(lines.line_digests(docs.repartition(1))) == bag(lines.line_digests(docs.repartition(9).withColumn("h1", F.lit(1))))
