"""op1, op7: what a block sends is found by the names that it has, not by all buckets."""

import numpy as np
import pyarrow as pa

from postmill.llm import common, lm


def test_work_of_a_block_does_not_depend_on_the_number_of_buckets():
    """Runs of the names that a block has: no array is as long as there are buckets."""
    rising = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64)) >> np.uint64(2)
    values, start, end = common.equal_runs(rising >> np.uint64(20))
    assert values.tolist() == sorted(set((rising >> np.uint64(20)).tolist())) and [x for a, b in zip(start, end) for x in rising[a:b].tolist()] == rising.tolist()
    texts = common.Texts(pa.array(["a b c a b", None, "b c"]))
    few, many = (lm.Grams(table_of(texts), bits).dealt(0, True) for bits in (2, 24))
    assert many.num_rows <= 40 and few.num_rows <= 4 * 3 and sum(few["n"].to_pylist()) > 0


def table_of(texts):
    ends = np.asarray(texts.offsets[1:], np.int64)
    return pa.table({"ids": pa.array([[1, 2, 4]], pa.list_(pa.int64())), "ends": pa.array([ends.tobytes()], pa.binary()), "text": pa.array([texts.bytes.tobytes()], pa.binary())})
