"""op3: items with equal shingles are one, however many blocks the items fill."""

from postmill.llm import decontaminate


def test_copies_of_an_item_over_several_blocks(spark):
    base = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(6)]
    items = [(i, base[i % 6].upper() if i % 2 else base[i % 6] + " !") for i in range(40, 100)] + [(None, base[0]), (7, None), (8, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    docs = spark.createDataFrame([(k, "before " + t + " after") for k, t in enumerate(base)] + [(50, "nothing of it is here at all")], "doc_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, block_bytes=100))
    assert len(blocks) > 1 and sorted(i for b in blocks for i in b.ids) == sorted(min(i for i, t in items if i and t and t.lower().startswith(x)) for x in base)
    one = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    default = decontaminate.item_blocks.__defaults__
    decontaminate.item_blocks.__defaults__ = (100,)
    try:
        many = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    finally:
        decontaminate.item_blocks.__defaults__ = default
    assert many == one and [x[0] for x in one] == list(range(6))
