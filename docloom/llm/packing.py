"""Pack documents into sequences of at most ``capacity`` tokens.

Only documents longer than a sequence are cut, into full pieces and a rest.
Pieces of one length are interchangeable, so the packing is planned on the
histogram of lengths (at most ``capacity`` rows, whatever the corpus):

1. Dominance reduction after Martello and Toth fixes sets that no other choice
   can beat: a piece nothing fits beside; a piece with an exact complement; a
   piece beside which only one more fits, with the largest that does; a piece
   beside which at most two fit, with one partner as large as any such two.
2. What remains is packed best-fit in order of falling length.

The plan says, per length, which rank goes to which sequence and offset. Ranks
within a length are counted in hash buckets of bounded size and shifted by the
buckets before, so no length, however common, is ranked in one task.

Defined cases: null text is empty and packs as the end id alone; repeated rows
are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import write_shared

#: Mean rows of one (length, bucket) group never exceed this.
GROUP_ROWS = 512
#: Bytes that a task's cache of chunks, or of words, holds before it starts
#: anew, and what an entry takes beside its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 48_000_000, 200
#: Characters of texts whose unknown chunks are worked out together, and words
#: of one sequence for the tokenizer.
BATCH_CHARS, RUN_WORDS = 1_000_000, 200
#: Texts with these go to the tokenizer whole: white space and case on which
#: Python and the tokenizer may differ, and strings of special tokens.
NOT_PLAIN = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "Σ", "İ", "<|")

#: Ids travel beside a mark for null: pandas would make doubles of both.
PIECES = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long"


#: Fixed value: what the tokenizer takes for one word; a word's ids depend on
#: nothing around it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Recent:
    """A cache of bounded size: at ``CACHE_BYTES`` it begins anew, and what is
    asked for again is taken over from before."""

    def __init__(self) -> None:
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0

    def put(self, found: dict[str, bytes]) -> None:
        self.now.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)

    def new(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that are not known; the others are in ``now``."""
        if self.size > CACHE_BYTES:
            self.now, self.before, self.size = {}, self.now, 0
        missing = keys.difference(self.now)
        again = missing.intersection(self.before)
        self.put({k: self.before[k] for k in again})
        return list(missing.difference(again))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class _Encoder:
    """A tokenizer with the ids of the chunks and words that a task saw lately."""

    def __init__(self, path: str):
        import regex

        self.tokenizer, self.split = _tokenizer(path), regex.compile(SPLIT)
        self.chunks, self.words = _Recent(), _Recent()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def ids(self, text: str) -> array:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)

    def spelled(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words. Many go in one text, as every word's last token
        has a mark; where that doesn't hold, each goes alone."""
        found: dict[str, bytes] = {}
        runs = [words[at : at + RUN_WORDS] for at in range(0, len(words), RUN_WORDS)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(run) or ends[-1] != len(ids):
                found.update((w, self.ids(w).tobytes()) for w in run)
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(run, (4 * ends).tolist()):
                found[word] = data[at:end]
                at = end
        return found

    def learn(self, chunks: list[str]) -> None:
        """Work out the ids of new chunks from their words."""
        parts = {c: [c] if c.isascii() and c.isalpha() else self.split.findall(c) for c in chunks}
        self.words.put(self.spelled(self.words.new({w for ws in parts.values() for w in ws})))
        known = self.words.now
        self.chunks.put({c: known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for c, ws in parts.items()})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts; what is new in any is worked out at once."""
        split = [None if any(x in t for x in NOT_PLAIN) or not unicodedata.is_normalized("NFC", t) else t.lower().split() for t in texts]
        seen: set[str] = set()
        for chunks in filter(None, split):
            seen.update(chunks)
        self.learn(self.chunks.new(seen))
        known = self.chunks.now.__getitem__
        return [self.ids(t).tobytes() if chunks is None else b"".join(map(known, chunks)) for t, chunks in zip(texts, split)]


def encode(texts: list[str | None], path: str, encoder: _Encoder | None = None) -> Iterator[bytes]:
    """Token ids of each text as little-endian 32-bit words.

    The tokenizer lower-cases, drops white space and never looks across it, so
    a text's ids are those of its chunks, and these of their words.
    """
    own = encoder or _Encoder(path)
    some, size = [], 0
    for text in texts:
        some.append(text or "")
        size += len(text or "")
        if size > BATCH_CHARS:
            yield from own.encode(some)
            some, size = [], 0
    yield from own.encode(some)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, no_id, piece, start, length, ids_crc32``."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        own = _Encoder(tokenizer_path)  # its caches end with the task
        for pdf in batches:
            rows = []
            for doc_id, no_id, ids in zip(pdf["doc_id"], pdf["no_id"], encode(pdf["text"].tolist(), tokenizer_path, own)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, no_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32"])

    own = F.col("doc_id").cast("long")
    few = docs.select(F.coalesce(own, F.lit(0).cast("long")).alias("doc_id"), own.isNull().alias("no_id"), F.col("text").cast("string").alias("text"))
    return few.mapInPandas(cut, PIECES)


def reduce_and_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths in a sequence, number of such sequences)`` for a histogram."""
    left = Counter({s: n for s, n in counts.items() if n})
    plan: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left)

    def take(items: tuple[int, ...], n: int) -> None:
        plan.append((items, n))
        for s in items:
            left[s] -= n
        for s in set(items):
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))

    def smallest(without: int, k: int) -> int:
        """Sum of the k smallest pieces beside one piece of length ``without``."""
        total = 0
        for s in sizes:
            n = min(k, left[s] - (s == without))
            total, k = total + n * s, k - n
            if not k:
                return total
        return total + k * (capacity + 1)

    for big in sorted(left, reverse=True):
        while left.get(big):
            room = capacity - big
            if smallest(big, 1) > room:
                take((big,), left[big])
                continue
            at = bisect.bisect_right(sizes, room) - 1
            if sizes[at] == big and left[big] == 1:
                at -= 1
            mate = sizes[at]
            many = left[big] // 2 if mate == big else min(left[big], left[mate])
            if mate == room or smallest(big, 2) > room:
                take((big, mate), many)
                continue
            if smallest(big, 3) > room and _best_pair(sizes, left, big, room) <= mate:
                # Taking pieces away only strengthens both conditions, so all go at once.
                take((big, mate), many)
                continue
            break
    return plan + _best_fit(left, capacity)


def _best_pair(sizes: list[int], left: Counter, big: int, room: int) -> int:
    """Largest sum of two pieces that fit in ``room`` beside ``big``."""
    best, hi = 0, bisect.bisect_right(sizes, room) - 1
    lo = 0
    while lo <= hi:
        total = sizes[lo] + sizes[hi]
        if total > room:
            hi -= 1
        elif lo == hi and left[sizes[lo]] - (sizes[lo] == big) < 2:
            break
        else:
            best = max(best, total)
            lo += 1
    return best


def _best_fit(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length; equal open sequences are kept as one run."""
    rooms: list[int] = []
    runs: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, items: tuple[int, ...], n: int) -> None:
        if room not in runs:
            bisect.insort(rooms, room)
            runs[room] = []
        runs[room].append((items, n))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            room = rooms[at] if at < len(rooms) else capacity
            items, m = runs[room].pop() if at < len(rooms) else ((), n)
            if at < len(rooms) and not runs[room]:
                del runs[room], rooms[at]
            fit = min(room // s, n)
            used = min(m, n // fit)
            if items and used < m:
                put(room, items, m - used)
            put(room - fit * s, items + (s,) * fit, used)
            n -= fit * used
    return [run for room in rooms for run in runs[room]]


def _intervals(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length rows ``(first rank, copies a sequence, first sequence, offset)``."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    first = 0
    for items, n in plan:
        offset = 0
        for s, c in sorted(Counter(items).items(), reverse=True):
            out.setdefault(s, []).append((ranks[s], c, first, offset))
            ranks[s] += c * n
            offset += c * s
        first += n
    return {s: np.array(rows, dtype=np.int64) for s, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    cut = write_shared(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _intervals(reduce_and_fit(histogram, capacity))
    buckets = max(1, -(-max(histogram.values(), default=0) // GROUP_ROWS))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "no_id", "piece", "ids_crc32"), F.lit(buckets)))
    shift = (
        keyed.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
        .drop("n")
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "no_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("at", F.row_number().over(within) - 1)
        .join(shift, ["length", "bucket"])
        .select("doc_id", "no_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank"))
    )

    def place(batches):
        for pdf in batches:
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            rank, length = pdf["rank"].to_numpy(), pdf["length"].to_numpy()
            for s in np.unique(length):
                rows, mine = places[int(s)], length == s
                r = rank[mine]
                x = rows[np.searchsorted(rows[:, 0], r, side="right") - 1]
                seq[mine] = x[:, 2] + (r - x[:, 0]) // x[:, 1]
                off[mine] = x[:, 3] + (r - x[:, 0]) % x[:, 1] * s
            yield pdf.drop(columns="rank").assign(sequence_id=seq, offset=off)

    placed = ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
    return placed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
