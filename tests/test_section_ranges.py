"""The interval join of sections and chunks against a nested loop."""

import random

from tenderloom.operators import hierarchy


def test_against_nested_loop(spark):
    rng = random.Random(1)
    entries = [(d, f"u{d}_{i}", 1 + i % 2, s, s + rng.choice([-1, 0, 1, 2, 7, 40, 200])) for d in range(6) for i in range(20) for s in [rng.randrange(150)]]
    entries += [(0, "none", 1, None, 5), (0, "open", 1, 5, None), (1, "all", 1, 0, 10_000_000), (2, "below", 1, -3, 2)]
    chunks = [(d, o, f"c{d}_{o}") for d in range(7) for o in range(150) if rng.random() < 0.8] + [(0, 4, "again"), (1, None, "nowhere"), (2, -2, "below")]
    e = spark.createDataFrame(entries, "doc_id long, uid string, level int, start_order int, end_order int").repartition(3)
    c = spark.createDataFrame(chunks, "doc_id long, chunk_order int, uid string").repartition(3)
    expected = [(*x, o, u) for x in entries for d, o, u in chunks if d == x[0] and None not in (x[3], x[4], o) and x[3] <= o <= x[4]]
    found = hierarchy.chunks_of_sections(e, c)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    # few blocks for any range, and one row for each pair before and after the join
    assert e.filter("uid = 'all'").select(hierarchy._aligned_blocks(e["start_order"].cast("long"), e["end_order"].cast("long")).alias("b")).first()["b"].__len__() <= 48
    assert hierarchy.chunks_of_sections(e.filter("false"), c).count() == 0
