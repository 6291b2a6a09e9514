"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and stems (the first ``STEM`` letters of longer words), known
by 64-bit hashes. Every term of every indexed example takes part, on both sides, and
vectors have length 1 over all of them. A term weighs its log frequency in the
text, times its inverse document frequency over all documents, times how far
it tells the classes of the examples apart: g / (g + ``HALF_GAIN``), g being
its likelihood-ratio statistic, whichever class it points to. Without that
last factor the neighbours follow the topic and not the label. A term that no
example holds tells nothing apart (g = 0), and so weighs nothing.

Examples are held in an inverted index whose postings are cut into blocks of
examples; frequent terms have the largest weight of each block, and light ones
(``LIGHT``) only each example's norm over them. What the rare terms add up to,
the maxima of the frequent and the norms of the light bound every block; the
blocks of the largest bounds are opened first, then all whose bound reaches the
k-th best cosine found. Exact cosines over all terms are worked out for every
example whose bound reaches it, so the neighbours are exact. Their votes, weighted by
cosine and by the classes' share of labels, are calibrated by a logistic curve
on labelled texts outside the index.

Only labelled samples bounded by ``SAMPLE_ROWS`` are fitted on; document
frequencies are counted over all documents, and all texts are scored whole.

Defined cases: a text without any term of the index (null and empty ones too)
has no neighbour and gets the calibrated share of such texts; ties between
neighbours go to the example that comes first in the index; labelled rows
that repeat are fitted on as often as they occur, and an id marked both ways
counts as marked 1; other columns are never read, whatever their names; an
empty table gives an empty result. Without labels of both classes there is no
model: every score is 0 and no text is called toxic.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import crc_fold, labelled_sample, write_shared
from docloom.llm.quality import fit_logistic

#: Labelled rows a class, neighbours, examples of a block.
SAMPLE_ROWS, NEIGHBOURS, BLOCK = 6000, 15, 64
#: Likelihood-ratio statistic at which a term weighs half of what it can.
HALF_GAIN = 11.0
#: A term in this share of the examples is frequent; blocks opened at first.
FREQUENT, FIRST_BLOCKS = 1 / 16, 1
#: A term is light whose mean weight in the examples is below this share of all terms' mean.
LIGHT = 0.25
#: Texts whose neighbours are looked for together, and examples whose exact cosines are worked out together.
TEXTS, CANDIDATES = 128, 256
#: Chunks of letters (words) whose terms a task remembers, and letters of a word's stem.
KNOWN_CHUNKS, STEM = 300_000, 4
LETTERS = re.compile(r"[^\W\d_]+")
#: Latin-1 with all but letters as spaces.
LATIN = bytes(c if LETTERS.match(chr(c)) else 32 for c in range(256))
#: What single precision may be off by in a cosine.
SLACK = 3e-6
NEAR = "array<struct<doc_id: long, cosine: double, label: int>>"


@cache
def _letters() -> np.ndarray:
    """All of Unicode with all but letters as spaces."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for run in LETTERS.finditer("".join(map(chr, range(len(table))))):
        table[run.start() : run.end()] = np.arange(run.start(), run.end())
    return table


def words_of(text: str | None) -> list[str]:
    """The runs of ``LETTERS`` in the whole text, in lower case."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return _letters().take(letters).tobytes().decode("utf-32-le").split()


class Terms:
    """Texts as terms, by their place in a vocabulary of term hashes
    (or by hash, without one). What words stand for is remembered within
    bounds and goes with the object."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary = vocabulary
        self.sorter = None if vocabulary is None else np.argsort(vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.pairs = np.empty((KNOWN_CHUNKS, 2), np.int64)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The places of term hashes in the vocabulary; -1 stands for none."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = self.sorter[np.minimum(np.searchsorted(self.vocabulary, hashes, sorter=self.sorter), len(self.vocabulary) - 1)]
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def _learn(self, words: list[str]) -> None:
        """Note each word's own term and its stem's; -1 stands for none."""
        import xxhash

        h = xxhash.xxh64_intdigest
        stems = [w[:STEM] for w in words if len(w) > STEM]
        new = list(set(stems).difference(self.stems))
        hashes = np.array([h(w + "$") for w in words] + [h(s) for s in new], dtype=np.uint64).view(np.int64)
        if self.vocabulary is not None:
            hashes = self.place(hashes)
        self.stems.update(zip(new, hashes[len(words) :].tolist()))
        start, end = len(self.places), len(self.places) + len(words)
        self.places.update(zip(words, range(start, end)))
        if end > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.empty((end, 2), np.int64)])
        self.pairs[start:end, 0], self.pairs[start:end, 1] = hashes[: len(words)], -1
        self.pairs[start + np.flatnonzero([len(w) > STEM for w in words]), 1] = [self.stems[s] for s in stems]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the whole text in order, and how often each occurs."""
        words = Counter(words_of(text))
        rows = list(map(self.places.get, words))
        if None in rows:
            new = [w for w, row in zip(words, rows) if row is None]
            if len(self.places) + len(new) > KNOWN_CHUNKS:
                self._forget()
                new = list(words)
            self._learn(new)
            rows = list(map(self.places.get, words))
        pairs = self.pairs.take(np.array(rows, np.int64), axis=0).ravel()
        counts = np.repeat(np.fromiter(words.values(), np.int64, len(words)), 2)
        held = pairs != -1
        pairs, counts = pairs[held], counts[held]
        if not len(pairs):
            return pairs, counts
        order = np.argsort(pairs)
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        return pairs[first], np.add.reduceat(counts, first)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, none of them empty, one after another."""
    ends = np.cumsum(lengths)
    steps = np.ones(ends[-1] if len(ends) else 0, np.int64)
    steps[:1] = starts[:1]
    steps[ends[:-1]] += starts[1:] - starts[:-1] - lengths[:-1]
    return np.cumsum(steps, out=steps)


class Index:
    """Examples as block-max postings; ``nearest`` is exact."""

    def __init__(self, vectors: list[dict[int, float]], terms: int):
        starts = np.cumsum([0, *(len(v) for v in vectors)])
        self._build(np.array([t for v in vectors for t in sorted(v)], np.int32), np.array([v[t] for v in vectors for t in sorted(v)]), starts, terms)

    @classmethod
    def of(cls, own_terms: np.ndarray, own_weights: np.ndarray, own_starts: np.ndarray, terms: int) -> Index:
        """The index of vectors one after another: example i has the places
        from ``own_starts[i]`` on, its terms in order."""
        own = cls.__new__(cls)
        own._build(own_terms.astype(np.int32, copy=False), own_weights, own_starts, terms)
        return own

    def __reduce__(self):
        """Only the vectors travel; the postings are made where they arrive."""
        return Index.of, (self.own_terms, self.own_weights, self.own_starts, len(self.starts) - 1)

    def _build(self, own_terms: np.ndarray, own_weights: np.ndarray, own_starts: np.ndarray, terms: int) -> None:
        n = len(own_starts) - 1
        self.blocks = -(-n // BLOCK)
        # Forward: the terms of each example, for its exact cosine.
        self.own_terms, self.own_weights, self.own_starts = own_terms, own_weights, own_starts
        # Light terms have no postings, only each example's norm over them.
        held = np.bincount(own_terms, minlength=terms)
        self.light = np.bincount(own_terms, own_weights, minlength=terms) < LIGHT * held * (own_weights.mean() if len(own_weights) else 0)
        slots, heavy = np.repeat(np.arange(n, dtype=np.int32), np.diff(own_starts)), ~self.light[own_terms]
        self.far = np.sqrt(np.bincount(slots[~heavy], own_weights[~heavy] ** 2, minlength=self.blocks * BLOCK)).reshape(-1, BLOCK)
        self.farthest = self.far.max(axis=1, initial=0)
        order = np.flatnonzero(heavy)
        order = order[np.argsort(own_terms[order], kind="stable")]
        self.slots, self.weights = slots[order], own_weights[order].astype(np.float32)
        self.starts = np.append(0, np.cumsum(np.where(self.light, 0, held)))
        frequent = np.flatnonzero(np.diff(self.starts) > FREQUENT * n)
        self.row = np.full(terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        # A frequent term's postings are kept with their gaps: one weight a slot.
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        for r, t in enumerate(frequent):
            a, b = self.starts[t], self.starts[t + 1]
            self.dense[r, self.slots[a:b]] = self.weights[a:b]
        self.most = self.dense.reshape(len(frequent), self.blocks, BLOCK).max(axis=2, initial=0)
        self.asked = np.zeros(terms)

    def nearest(self, vector: tuple[tuple[int, float], ...], k: int) -> list[tuple[float, int]]:
        """``(cosine, example)`` of the k largest positive cosines."""
        vector = sorted(vector)
        return self.search(np.array([t for t, _ in vector], np.int64), np.array([w for _, w in vector]), k)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The same for a vector given as terms in order and their weights."""
        return self.search_many([(terms, weights)], k)[0]

    def search_many(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """The same for some vectors. Those whose bounds leave most blocks are
        opened in one matrix product."""
        out: list[list[tuple[float, int]]] = [[] for _ in vectors]
        whole = []
        for i, (terms, weights) in enumerate(vectors):
            if not len(terms) or not self.blocks:
                continue
            row, light = self.row[terms], weights[self.light[terms]]
            starts = self.starts[terms]
            lengths = self.starts[terms + 1] - starts
            rare, often = np.flatnonzero((row < 0) & (lengths > 0)), np.flatnonzero(row >= 0)
            lengths = lengths[rare]
            at = _ranges(starts[rare], lengths)
            sums = np.bincount(self.slots.take(at), self.weights.take(at) * np.repeat(weights[rare], lengths), minlength=self.blocks * BLOCK).astype(np.float32).reshape(-1, BLOCK)
            rows, loads, gap = row[often], weights[often].astype(np.float32), float(np.sqrt(light @ light))
            # Sums are in single precision and leave out light terms; the bounds allow for both.
            bound = sums.max(axis=1) + loads @ self.most[rows] + gap * self.farthest + SLACK
            order = np.argsort(-bound, kind="stable")
            first, rest = order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]
            found = self._opened(sums, first, rows, loads)
            least = max(SLACK, np.partition(found.ravel(), -k)[-k] - SLACK) if found.size >= k else SLACK
            rest = rest[bound[rest] >= least]
            if 4 * len(rest) > self.blocks:
                whole.append((i, sums, rows, loads, gap, least))
                continue
            if len(rest):
                found, first = np.concatenate([found, self._opened(sums, rest, rows, loads)]), np.concatenate([first, rest])
            out[i] = self._best(terms, weights, found, first, gap, k, least)
        if whole:
            asked = np.zeros((len(whole), len(self.dense)), np.float32)
            for j, (_, _, rows, loads, _, _) in enumerate(whole):
                asked[j, rows] = loads
            for (i, sums, _, _, gap, least), added in zip(whole, asked @ self.dense):
                sums += added.reshape(-1, BLOCK)
                out[i] = self._best(*vectors[i], sums, np.arange(self.blocks), gap, k, least)
        return out

    def _best(self, terms: np.ndarray, weights: np.ndarray, found: np.ndarray, blocks: np.ndarray, gap: float, k: int, least: float) -> list[tuple[float, int]]:
        """The k best of the examples of ``blocks``, ``found`` being about their
        cosines without light terms, which add up to ``gap`` times ``far`` at
        most; ``least``, less what that is off by, is reached by all of the k."""
        if found.size > k:
            least = max(least, np.partition(found.ravel(), -k)[-k] - SLACK)
        near = found + gap * self.far[blocks] if gap else found
        at = np.flatnonzero(near.ravel() >= least - SLACK)
        places = blocks[at // BLOCK] * BLOCK + at % BLOCK
        places = places[places < len(self.own_starts) - 1]
        near = self._cosines(terms, weights, places)
        near, places = near[near > 0], places[near > 0]
        best = np.lexsort((places, -near))[:k]
        return list(zip(near[best].tolist(), places[best].tolist()))

    def _cosines(self, terms: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Cosines of some examples in double precision."""
        self.asked[terms] = weights
        found = []
        for some in np.array_split(places, 1 + len(places) // CANDIDATES):
            starts, ends = self.own_starts[some], self.own_starts[some + 1]
            parts = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist())] + [slice(0)]
            shared = self.asked.take(np.concatenate([self.own_terms[p] for p in parts])) * np.concatenate([self.own_weights[p] for p in parts])
            lengths = ends - starts
            found.append(np.where(lengths > 0, np.add.reduceat(np.append(shared, 0.0), np.cumsum(lengths) - lengths), 0.0))
        self.asked[terms] = 0.0
        return np.concatenate(found)

    def _opened(self, sums: np.ndarray, blocks: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The cosines of the examples of some blocks without light terms, in single precision."""
        return sums[blocks] + np.tensordot(weights, self.dense.reshape(len(self.dense), -1, BLOCK)[rows[:, None], blocks[None, :]], 1)


class Vectors:
    """What an ``Index`` is made of: the examples as ``packed`` and the factors
    of all terms. It is one where it arrives, so that the driver, which never
    searches, holds neither vectors nor postings."""

    def __init__(self, examples: list[bytes], factor: np.ndarray):
        self.parts = examples, factor

    def __reduce__(self):
        return Vectors.index, self.parts

    @staticmethod
    def index(examples: list[bytes], factor: np.ndarray) -> Index:
        starts = np.cumsum([0, *(len(counts) for _, counts in map(opened, examples))])
        terms, weights = np.empty(starts[-1], np.int32), np.empty(starts[-1])
        for example, a, b in zip(examples, starts, starts[1:]):
            own, counts = opened(example)
            terms[a:b], weights[a:b] = own, weighed(counts, factor[own])
        return Index.of(terms, weights, starts, len(factor))


def packed(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """Terms (places in a vocabulary, in order) and their counts in few bytes."""
    return zlib.compress(np.concatenate([np.diff(terms, prepend=0), counts]).astype(np.int32).tobytes(), 1)


def opened(own: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Terms and counts as ``packed`` wrote them."""
    both = np.frombuffer(zlib.decompress(own), np.int32).reshape(2, -1)
    return np.cumsum(both[0], dtype=np.int64), both[1]


def weigh(counts: dict[int, int], factor: np.ndarray) -> tuple[tuple[int, float], ...]:
    """Unit vector of term counts under the factors of all terms."""
    terms = sorted(counts)
    return tuple(zip(terms, weighed(np.array([counts[t] for t in terms]), factor[terms]).tolist()))


def weighed(counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Unit vector of term counts under the terms' factors (all zero, if these are)."""
    raw = (1 + np.log(counts)) * factor
    return raw / (np.sqrt((raw * raw).sum()) or 1.0)


def votes(m: dict, counted: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[tuple[float, float], list[tuple[float, int]]]]:
    """For each text, given as its terms and their counts, the log odds of the
    weighted votes and its size, and its neighbours."""
    for at in range(0, len(counted), TEXTS):
        some = counted[at : at + TEXTS]
        found = m["index"].search_many([(t, weighed(n, m["factor"][t])) for t, n in some], NEIGHBOURS)
        for (_, counts), near in zip(some, found):
            mass = 0.05 * np.array([1 - m["base"], m["base"]])
            for cosine, i in near:
                mass[m["labels"][i]] += cosine**2 * m["weight"][m["labels"][i]]
            yield (float(np.log(mass[1] / mass[0])), float(np.log(1 + counts.sum()))), near


def gain(a: np.ndarray, b: np.ndarray, big_a: int, big_b: int) -> np.ndarray:
    """Likelihood-ratio statistic of terms in ``a`` of ``big_a`` and ``b`` of ``big_b`` texts."""
    rate = (a + b) / (big_a + big_b)
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0.0)
    return np.maximum(0.0, 2 * (part(a, big_a * rate) + part(b, big_b * rate) + part(big_a - a, big_a * (1 - rate)) + part(big_b - b, big_b * (1 - rate))))


def counted(docs: DataFrame, vocabulary: np.ndarray, columns: list[str] | None = None) -> DataFrame:
    """``(row struct, terms, counts)`` of every row as a shared table, so that
    texts are cut into terms once. The struct holds ``columns`` (all, if none
    are named); terms are kept as their differences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("terms binary, counts binary")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = Terms(shared.value)
        for texts in batches:
            both = [terms.counts(t) for t in texts]
            yield pd.DataFrame({"terms": [np.diff(t, prepend=0).astype(np.int32).tobytes() for t, _ in both], "counts": [n.astype(np.int32).tobytes() for _, n in both]})

    rows = docs.select(F.struct(*(columns or ["*"])).alias("row"), cut(F.col("text").cast("string")).alias("own"))
    return write_shared(rows.select("row", "own.terms", "own.counts"), "counted", "zstd")


def unpacked(terms: pd.Series, counts: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts as ``counted`` wrote them."""
    return [(np.cumsum(np.frombuffer(t, np.int32), dtype=np.int64), np.frombuffer(n, np.int32)) for t, n in zip(terms, counts)]


def frequencies(table: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many rows of ``counted`` each of ``size`` terms is, and how many rows there are."""
    def summed(batches):
        n, seen = 0, np.zeros(size, np.int64)
        for pdf in batches:
            n += len(pdf)
            for terms, _ in unpacked(pdf["terms"], pdf["counts"]):
                seen[terms] += 1
        held = np.flatnonzero(seen)
        yield pd.DataFrame({"term": np.append(held, -1), "n": np.append(seen[held], n)}).astype({"term": "int32"})

    found = table.select("terms", "counts").mapInPandas(summed, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    terms, n = found["term"].to_numpy(), found["n"].to_numpy()
    out[terms[terms >= 0]] = n[terms >= 0]
    return out, int(n[terms < 0].sum())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_ROWS, columns: list[str] | None = None) -> dict | None:
    """Vocabulary, term factors, indexed examples and calibration, and ``docs`` as ``counted``.

    Half of the sample, dealt by a hash of the id, makes the examples and the
    other half the calibration; where a half lacks a class, both are all of it.
    """
    sample = write_shared(labelled_sample(docs, labels, label, per_class).withColumn("inside", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2)) == 0), "labelled")
    totals = {(r["inside"], r["label"]): r["n"] for r in sample.groupBy("inside", "label").agg(F.count("*").alias("n")).collect()}
    if len({y for _, y in totals}) < 2:
        return None
    halves = len(totals) == 4
    examples, rest = (sample.filter("inside"), sample.filter("not inside")) if halves else (sample, sample)
    usable = labels.filter(F.col(label).isin(0, 1) & ~crc_fold())
    share = {r["y"]: r["n"] for r in usable.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}

    def made(batches):
        terms = Terms()
        for pdf in batches:
            both = [terms.counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "terms": [t.tobytes() for t, _ in both], "counts": [n.astype(np.int32).tobytes() for _, n in both]})

    def classed(batches):
        for pdf in batches:
            hashes = np.frombuffer(b"".join(pdf["terms"]), np.int64)
            terms, at = np.unique(hashes, return_inverse=True)
            y = np.repeat(pdf["label"].to_numpy(), [len(t) // 8 for t in pdf["terms"]])
            yield pd.DataFrame({"term": terms, "a": np.bincount(at[y == 1], minlength=len(terms)), "b": np.bincount(at[y == 0], minlength=len(terms))})

    # Examples stay in a shared table; the driver gets their terms and, in the end, the packed counts.
    found = write_shared(examples.mapInPandas(made, "doc_id long, label int, terms binary, counts binary"), "examples", "zstd")
    in_class = found.select("label", "terms").mapInPandas(classed, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    # The commonest terms come first: what is looked up most lies close together.
    in_class = in_class.iloc[np.lexsort((in_class["term"], -in_class["a"] - in_class["b"]))]
    vocabulary, a, b = (in_class[c].to_numpy(np.int64) for c in ("term", "a", "b"))
    del in_class
    table = counted(docs, vocabulary, columns)
    df, total = frequencies(table, len(vocabulary))
    big = {v: sum(n for (inside, c), n in totals.items() if c == v and (inside or not halves)) for v in (0, 1)}
    g = gain(a, b, big[1], big[0])
    factor = (1 + np.log((1 + total) / (1 + df))) * g / (g + HALF_GAIN)
    known = docs.sparkSession.sparkContext.broadcast((vocabulary, factor))

    def placed(batches):
        terms, factors = Terms(known.value[0]), known.value[1]
        for pdf in batches:
            both = [(terms.place(np.frombuffer(t, np.int64)), np.frombuffer(n, np.int32)) for t, n in zip(pdf["terms"], pdf["counts"])]
            both = [(t[order], n[order]) for t, n in both for order in [np.argsort(t)]]
            heaviest = [int(t[np.argmax((1 + np.log(n)) * factors[t])]) if len(t) else -1 for t, n in both]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "heaviest": heaviest, "own": [packed(*x) for x in both]})

    # Examples with the same heaviest term lie in the same blocks.
    examples = found.mapInPandas(placed, "doc_id long, label int, heaviest int, own binary").orderBy("heaviest", "doc_id", "label", "own").drop("heaviest").toArrow()
    model = {
        "vocabulary": vocabulary,
        "factor": factor,
        "ids": examples["doc_id"].to_numpy(),
        "labels": examples["label"].to_numpy().astype(np.int64),
        "index": Vectors(examples["own"].to_pylist(), factor),
        "weight": {v: share[v] / big[v] for v in (0, 1)},
        "base": share[1] / (share[0] + share[1]),
    }
    del examples
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model

    def voted(batches):
        terms = Terms(shared.value["vocabulary"])
        for pdf in batches:
            x = np.array([x for x, _ in votes(shared.value, [terms.counts(t) for t in pdf["text"]])]).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "odds": x[:, 0], "size": x[:, 1]})

    held = rest.mapInPandas(voted, "doc_id long, label int, odds double, size double").orderBy("doc_id", "label", "odds", "size").toPandas()
    y = held["label"].to_numpy(float)
    by_class = np.array([share[int(v)] / max(1, (y == v).sum()) for v in y])
    return {"shared": shared, "curve": fit_logistic(held[["odds", "size"]].to_numpy(), y, by_class / by_class.mean()), "counted": table}


def scores(table: DataFrame, shared: Broadcast, curve: list[float]) -> DataFrame:
    """``(row struct, score, neighbours)`` of every row of ``counted``."""
    @F.pandas_udf(f"score double, neighbours {NEAR}")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ids, labels = shared.value["ids"], shared.value["labels"]
        a, b, c = curve
        for terms, counts in batches:
            out, near = [], []
            for x, found in votes(shared.value, unpacked(terms, counts)):
                out.append(float(1 / (1 + np.exp(-np.clip(a * x[0] + b * x[1] + c, -30, 30)))))
                near.append([{"doc_id": int(ids[i]), "cosine": s, "label": int(labels[i])} for s, i in found])
            yield pd.DataFrame({"score": out, "neighbours": near})

    return table.withColumn("s", scored("terms", "counts")).select("row", "s.score", "s.neighbours")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = 0.5, model: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """``(row struct, score, neighbours, predicted)`` of every row; the struct
    holds ``columns`` (all, if none are named), the neighbours are the labelled
    examples that gave the votes."""
    fitted = model or train(docs, labels, label, columns=columns)
    if fitted is None:
        done = docs.select(F.struct(*(columns or ["*"])).alias("row"), F.lit(0.0).alias("score"), F.expr(f"cast(null as {NEAR})").alias("neighbours"))
    else:
        table = counted(docs, fitted["shared"].value["vocabulary"], columns) if model else fitted["counted"]
        done = scores(table, fitted["shared"], fitted["curve"])
    return done.withColumn("predicted", (F.col("score") >= cut).cast("int"))
