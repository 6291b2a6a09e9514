"""How query blocks reach the row blocks of the bit-sliced search."""

import numpy as np
import pytest

from docloom.llm import bitsliced


@pytest.mark.parametrize("shelves", [2, 128])
def test_copies_of_query_blocks_are_bounded_and_never_broadcast(spark, monkeypatch, shelves):
    for name, value in (("BLOCK_ROWS", 16), ("QUERY_ROWS", 4), ("SHELVES", shelves)):
        monkeypatch.setattr(bitsliced, name, value)
    q = np.random.default_rng(3).integers(-900, 900, (300, 4))
    rows = spark.createDataFrame([(i, (q[i] / 256).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    found = bitsliced.top_products(rows, rows.filter("vec_id % 10 = 0"), 3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for i in range(0, 300, 10):
        near = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:3]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(near, 1)]
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("low, high, kind", [(-128, 127, np.int8), (0, 128, np.int16), (-129, 0, np.int16), (-(1 << 26), 1 << 26, np.int32)])
def test_compact_integers(low, high, kind):
    q = np.array([[low, high]], np.int64)
    assert bitsliced._compact(q).dtype == kind and (bitsliced._compact(q) == q).all()
