"""Near copies by word shingles against brute-force Jaccard."""

import random

import pytest

from docloom.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(rows):
    """The least id of every group of rows, all pairs compared."""
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def near_copies():
    """Texts with copies at about the threshold, and a passage that many share."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, out = [word() for _ in range(30)], []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(5, 120))] + passage * rng.randint(0, 1)
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy[rng.randint(0, 4) :]))
    return out


@pytest.mark.parametrize("sample", [10, 10_000])
def test_near_copies_against_brute_force(spark, monkeypatch, sample):
    import corpus_pipeline

    monkeypatch.setattr(shingles, "SAMPLE_ROWS", sample)
    rows = [(i, t) for i, t in enumerate([*near_copies(), None, "", " \n", "one two", "One  two", "one three"])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == brute_kept(rows)


def test_near_copies_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y z"), (2, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    kept = sorted(str(r["doc_id"]) for r in shingles.representatives(docs).select("doc_id").collect())
    assert kept == ["1", "2", "None"] and shingles.representatives(docs.limit(0)).count() == 0
