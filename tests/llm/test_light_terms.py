"""Terms that hardly weigh anything have no postings, and neighbours stay exact."""

import random

import numpy as np

from docloom.llm import toxicity


def test_light_terms_have_no_postings():
    rng = random.Random(21)
    factor = np.array([10.0 ** rng.uniform(-4, 0) for _ in range(300)])
    vectors = [dict(toxicity.weigh({rng.randrange(300): rng.randint(1, 9) for _ in range(rng.randint(1, 80))}, factor)) for _ in range(700)]
    index = toxicity.Index(vectors, 300)
    assert len(index.slots) < 0.8 * len(index.own_terms)
    asked = [toxicity.weigh({rng.randrange(300): rng.randint(1, 9) for _ in range(size)}, factor) for size in [1, 3, 40, 120] * 20]
    asked += [toxicity.weigh({t: 1}, factor) for t in np.argsort(factor)[:5].tolist()]
    for k in (1, 15, 100):
        found = index.search_many([(np.array([t for t, _ in sorted(q)]), np.array([w for _, w in sorted(q)])) for q in asked], k)
        for q, got in zip(asked, found):
            want = sorted((-s, i) for i, v in enumerate(vectors) if (s := sum(w * v.get(t, 0) for t, w in q)) > 0)[:k]
            assert np.allclose([s for s, _ in got], [-s for s, _ in want], rtol=1e-9, atol=1e-12) and len(got) == len(want)


def test_words_are_those_of_the_expression():
    every = " ".join(map(chr, range(0x110000))) + "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for text in (every, "Iİß ΑΣ ½x_y1z² élan µ ª", "plain ASCII, it's 12 one.ONE", "", None):
        assert toxicity.words_of(text) == toxicity.LETTERS.findall((text or "").lower())


def test_places_in_a_vocabulary_of_any_order():
    terms = toxicity.Terms(np.array([7, -3, 5], np.int64))
    assert terms.place(np.array([5, 6, 7, -3, 99, -99])).tolist() == [2, -1, 0, 1, -1, -1]
