"""What the toxicity model takes on the driver."""

import numpy as np

from docloom.llm import toxicity


def test_the_driver_makes_no_postings(spark, small, monkeypatch):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    made, build = [], toxicity.Index._build
    monkeypatch.setattr(toxicity.Index, "_build", lambda self, *parts: made.append(parts) or build(self, *parts))
    shared = toxicity.train(docs, labels)["shared"]
    assert not made
    arrived = shared.value["index"]
    terms, weights, starts, _ = made[0]
    assert len(made) == 1 and starts[-1] == len(terms) == len(weights) and terms.dtype == np.int32
    a, b = starts[0], starts[1]
    (cosine, i), *_ = arrived.search(terms[a:b], weights[a:b], 1)
    assert abs(cosine - 1) < 1e-9 and np.array_equal(weights[starts[i] : starts[i + 1]], weights[a:b])
