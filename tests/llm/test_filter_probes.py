"""op7: a filter that is too large for a broadcast is probed in its buckets, at a cost that blocks do not multiply."""

import numpy as np
import pyarrow as pa
import pyarrow.compute

from postmill.llm import common, lm

BITS = 2


def block_of(number, texts):
    own = common.Texts(pa.array(texts))
    ids = pa.array([[100 * number + k for k in range(len(texts))]], pa.list_(pa.int64()))
    return pa.table({"ids": ids, "ends": pa.array([own.offsets[1:].tobytes()], pa.binary()), "text": pa.array([own.bytes.tobytes()], pa.binary())})


def words(rng, n, kinds):
    return " ".join(f"w{x}" for x in rng.integers(0, kinds, n))


def bucket_of(grams, bucket):
    sent = pa.concat_tables([g.dealt(k, False) for k, g in enumerate(grams)])
    return sent.filter(pa.compute.equal(sent.column("bucket"), bucket))


def test_a_bucket_is_probed_once_for_all_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    grams = [lm.Grams(block_of(k, [words(rng, 60, 12) for _ in range(4)]), BITS) for k in range(25)]
    assert any(g.held.any() for g in grams)
    table, levels, calls = bucket_of(grams, 1), lm.Model.levels, []
    monkeypatch.setattr(lm.Model, "levels", lambda self, names, order: calls.append(order) or levels(self, names, order))
    probed = lm._gather(1, table, BITS, 80, 2, True)
    assert sorted(calls) == list(range(2, lm.ORDER + 1))
    segment = next(r for r in lm._gather(1, table, BITS, 80, 2, False).to_pylist() if r["kind"] == "segment")
    model = lm.Model([(1, segment["one"], int.from_bytes(segment["two"], "little"))])
    found = {(r["block"], r["kind"]): lm._decoded(r["one"]).tolist() for r in probed.to_pylist() if r["block"] is not None}
    for block, own in enumerate(grams):
        for order in range(2, lm.ORDER + 1):
            names = own.names[order - 1][own.buckets(order) == 1]
            assert found.get((block, f"levels{order}"), []) == levels(model, names, order).tolist()
    assert max(max(x) for (_, kind), x in found.items() if kind != "words") > 2


def test_names_take_no_more_bytes_with_many_buckets():
    grams = lm.Grams(block_of(0, [words(np.random.default_rng(4), 60_000, 50_000)]), 6)
    sent = grams.dealt(0, False).filter(pa.compute.field("n") == 3).column("keys").to_pylist()
    assert len(sent) == 64 and sum(map(len, sent)) < 5 * len(grams.names[2])


def test_coded_values():
    for values in ([0], [1, 0, 255], [256, 3], [(1 << 64) - 1, 0, 1 << 40]):
        assert lm._decoded(lm._coded(np.array(values, dtype=np.uint64))).tolist() == values


def test_bound_of_the_filter():
    for texts in (["a a a a a", "", "a", None], ["a b"] * 7, [words(np.random.default_rng(5), 300, 400)], [""] * 9):
        own = lm.Grams(block_of(0, texts), BITS)
        notes = [lm._gather(b, bucket_of([own], b), BITS, 8, 1, False).to_pylist() for b in range(1 << BITS)]
        size = sum(len(r["one"]) for rows in notes for r in rows if r["kind"] == "segment")
        assert 0 < size <= lm.most_bytes(sum(len(t or "") for t in texts), len(texts), 8) + 8 * (1 << BITS)
