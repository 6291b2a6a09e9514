"""Many lines on one segment, and documents of very many lines."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.llm import lines


def near(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= lines.EDITS


def test_lines_under_one_segment(spark):
    rng = random.Random(5)
    texts = sorted({"the same beginning " + "".join(rng.choice("abc12é") for _ in range(rng.randint(10, 12))) for _ in range(150)})
    texts += [t[:-3] + "zz" for t in texts[:20]] + [t + "!" for t in texts[20:40]]
    texts = sorted({t for t in texts if len(t) >= lines.LEAST})
    table = lines.exploded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    by = {r["h"]: r["line"] for r in table.collect()}
    got = {frozenset((by[r["a"]], by[r["b"]])) for r in lines.links(table).collect()}
    assert got == {frozenset((x, y)) for i, x in enumerate(texts) for y in texts[:i] if abs(len(x) - len(y)) <= 2 and near(x, y)}


@pytest.mark.parametrize("n", [40_000])
def test_very_many_lines(spark, n):
    text = "\n".join(f"a line of some length number {i % 1000 * 7919}" for i in range(n))
    start = time.time()
    got = lines.deduplicated(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert time.time() - start < 90
    kept = got[0]["text"].split("\n")
    assert 0 < len(kept) <= 1000 and len(set(kept)) == len(kept) and kept[0] == text.split("\n")[0] and [r["text"] for r in got[1:]] == [None, ""]
