"""What the driver holds while a toxicity model is made."""

import random
import tracemalloc

import numpy as np

from docloom.llm import toxicity


def test_the_driver_holds_no_vectors(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(words, 900)) + (" horrid" if i % 2 else "")) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    toxicity.train(docs.limit(20), labels)  # what is imported and remembered once
    tracemalloc.start()
    try:
        shared = toxicity.train(docs, labels)["shared"]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    postings = len(shared.value["index"].own_terms)
    assert postings > 250_000 and most < 16 * postings


def test_packed_examples_come_back():
    for terms, counts in (([], []), ([0], [1]), ([3, 9, 2_000_000], [70_000, 1, 2])):
        own, n = toxicity.opened(toxicity.packed(np.array(terms, np.int64), np.array(counts, np.int32)))
        assert own.tolist() == terms and n.tolist() == counts
