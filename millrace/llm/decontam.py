"""Benchmark decontamination: a BM25 index of test items, block-max WAND, and verification of question and answer.

Test items are indexed; every passage of every training document is a query. A passage is reported for an item if at least
`overlap` of the 5-word shingles of the item's question, and of its answer, occur in it. An item's threshold is the least
BM25 score such a passage can have: a passage that lacks m words of the item lacks at least m shingles, so the
score can't fall below that of the item itself less its m heaviest words. Retrieval by that threshold is therefore without
loss. Scores are divided by the threshold, so that 1 is the threshold of every item.

Block maxima are held by term for the blocks of items that have the term. Their sums, taken for all passages of a batch at once, tell
which passages can hold an item above the threshold; for those WAND runs over the postings, with pivots and skips of blocks.

Words are Unicode-lower-cased, punctuation parts them. The question is all of an item but its last sentence, the answer
that sentence, each of at least 5 words if the item has 10; a shorter item is both. Passages are windows of twice a step
that is at least as long as the longest item, a step apart, so an item lies whole in one. Null or empty texts and items
have no words and match nothing. Items of equal text are all reported; repeated documents repeat their rows. The index
is sent to the executors in shards of bounded text, one pass over the documents for each; the number of items, document
frequencies, lengths and the passages' step are those of the whole benchmark, so results don't depend on the shards.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, OVERLAP, BLOCK, STEP, PASSAGES = 5, 0.8, 8, 64, 256
K1, B = 1.2, 0.75
SHARD_BYTES = 4 << 20

_PARTED = bytes(b if chr(b).isalnum() or b >= 0x80 else 32 for b in range(256))
_SENTENCE = re.compile(r"(?<=[.?!\n])\s+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PARTED).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    words = [w for p in parts for w in p]
    if len(words) < 2 * SHINGLE:
        return words, words
    cut = min(max(len(words) - len(parts[-1]), SHINGLE), len(words) - SHINGLE)
    return words[:cut], words[cut:]


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """All windows of five words, repeats included; a shorter sequence is one shingle."""
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


@dataclass
class Statistics:
    """What scores need of the whole benchmark: items with words, their mean and greatest length, and how many items have a word."""

    n: int
    mean: float
    longest: int
    df: dict[bytes, int]

    @classmethod
    def of(cls, bags: list[dict[bytes, int]]) -> Statistics:
        sizes, df = [sum(b.values()) for b in bags], Counter(w for b in bags for w in b)
        return cls(len(bags), sum(sizes) / max(1, len(sizes)), max(sizes, default=0), df)


class Index:
    """Postings by term with impacts, block maxima, and the shingles to verify by. Terms' runs lie one after another in arrays."""

    def __init__(self, items: list[tuple[int, str]], overlap: float = OVERLAP, whole: Statistics | None = None):
        self.overlap = overlap
        found = [(i, *split_item(t)) for i, t in sorted(items) if words_of(t)]
        self.items = [i for i, _, _ in found]
        self.parts = [(shingles(q), shingles(a)) for _, q, a in found]
        bags = [self._bag(q, a) for _, q, a in found]
        whole = whole or Statistics.of(bags)
        self.step = max(STEP, whole.longest)
        self.terms = {w: t for t, w in enumerate(sorted({w for b in bags for w in b}))}
        term, item, value = [], [], []
        for i, bag in enumerate(bags):
            impact, size = {}, sum(bag.values())
            for w, tf in bag.items():
                idf = math.log(1 + (whole.n - whole.df[w] + 0.5) / (whole.df[w] + 0.5))
                impact[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / whole.mean))
            lost = sum(math.floor((1 - overlap) * len(p) + 1e-9) for p in self.parts[i])
            least = sum(sorted(impact.values())[: max(1, len(impact) - lost)])
            term += [self.terms[w] for w in impact]
            item += [i] * len(impact)
            value += [x / least * (1 + 1e-9) for x in impact.values()]
        order = np.argsort(np.array(term, np.int64), kind="stable")
        self.term, self.item, self.value = np.array(term, np.int64)[order], np.array(item, np.int64)[order], np.array(value)[order]
        self.starts = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        self.n_blocks = max(1, -(-len(found) // BLOCK))
        key = self.term * self.n_blocks + self.item // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block = key[first] % self.n_blocks
        self.block_max = np.maximum.reduceat(self.value, first) * 1.000001 if len(first) else np.zeros(0)
        self.block_starts = np.searchsorted(key[first], np.arange(len(self.terms) + 1) * self.n_blocks)
        self.term_max = np.maximum.reduceat(self.value, self.starts[:-1]) * 1.000001 if len(self.terms) else np.zeros(0)

    @staticmethod
    def _bag(question: list[bytes], answer: list[bytes]) -> dict[bytes, int]:
        bag: dict[bytes, int] = {}
        for w in question if question is answer else question + answer:
            bag[w] = bag.get(w, 0) + 1
        return bag

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items that score at least 1 for a set of terms, by block-max WAND."""
        lists = []
        for t in terms:
            own, blocks = slice(self.starts[t], self.starts[t + 1]), slice(self.block_starts[t], self.block_starts[t + 1])
            most = dict(zip(self.block[blocks].tolist(), self.block_max[blocks].tolist()))
            lists.append([0, self.item[own].tolist(), self.value[own].tolist(), float(self.term_max[t]), most])
        out = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            total, pivot = 0.0, None
            for n, x in enumerate(lists):
                total += x[3]
                if total >= 1:
                    pivot = x[1][x[0]]
                    break
            if pivot is None:
                break
            while n + 1 < len(lists) and lists[n + 1][1][lists[n + 1][0]] == pivot:
                n += 1
            block = pivot // BLOCK
            if sum(x[4].get(block, 0.0) for x in lists[: n + 1]) < 1:
                # No item of this block before the next list's can score enough.
                to = min([(block + 1) * BLOCK, *(x[1][x[0]] for x in lists[n + 1 : n + 2])])
            elif lists[0][1][lists[0][0]] == pivot:
                score = sum(x[2][x[0]] for x in lists[: n + 1])
                if score >= 1:
                    out.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for x in lists[: n + 1]:
                x[0] = bisect_left(x[1], to, x[0])
            lists = [x for x in lists if x[0] < len(x[1])]
        return out

    def verified(self, item: int, words: list[bytes]) -> tuple[float, float] | None:
        """Shares of the question's and the answer's shingles in a passage, if both reach the overlap."""
        have = set(shingles(words))
        shares = []
        for part in self.parts[item]:
            # A part shorter than a shingle occurs if its words do, one after another.
            own = have if len(part[0]) == SHINGLE else {tuple(words[i : i + len(part[0])]) for i in range(len(words))}
            shares.append(sum(s in own for s in part) / len(part))
        return (shares[0], shares[1]) if min(shares) >= self.overlap - 1e-9 else None

    def passages(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
        """(text, first word, items at or above the threshold) for every passage that has some."""
        if not self.items:
            return
        counts = np.array([len(w) for w in texts], np.int64)
        known = np.fromiter((self.terms.get(w, -1) for t in texts for w in t), np.int64, int(counts.sum()))
        owner = common.owners(counts)
        place = np.arange(len(known)) - np.repeat(np.cumsum(counts) - counts, counts)
        # Passage k of a text holds its steps k and k + 1.
        steps = -(-counts // self.step)
        base = np.cumsum(steps) - steps
        own = np.flatnonzero(known >= 0)
        at, term = base[owner[own]] + place[own] // self.step, known[own]
        again = at > base[owner[own]]
        keys = np.unique(np.concatenate([at, at[again] - 1]) * len(self.terms) + np.concatenate([term, term[again]]))
        at, term = keys // len(self.terms), keys % len(self.terms)
        enough = np.bincount(at, self.term_max[term], int(steps.sum())) >= 1
        at, term = at[enough[at]], term[enough[at]]
        may = np.flatnonzero(enough)
        starts = np.append(np.searchsorted(at, may), len(at))
        of = np.repeat(np.arange(len(texts)), steps)
        for a in range(0, len(may), PASSAGES):
            cut = starts[a : a + PASSAGES + 1]
            own, n = term[cut[0] : cut[-1]], len(cut) - 1
            sizes = self.block_starts[own + 1] - self.block_starts[own]
            entry = np.repeat(self.block_starts[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            cell = np.repeat(np.repeat(np.arange(n), np.diff(cut)), sizes) * self.n_blocks + self.block[entry]
            bound = np.bincount(cell, self.block_max[entry], n * self.n_blocks).reshape(n, -1)
            for p in np.flatnonzero((bound >= 1).any(1)).tolist():
                if hits := self.search(term[cut[p] : cut[p + 1]].tolist()):
                    number = int(may[a + p])
                    yield int(of[number]), int(number - base[of[number]]) * self.step, hits


SCHEMA = "doc_id long, item_id long, score double, question double, answer double, first_word long, n_passages long"


def matches(index: Index, texts: list[list[bytes]]) -> Iterator[tuple[int, int, float, float, float, int, int]]:
    """(text, item, score, question, answer, first word, passages) of verified items: the best passage of each."""
    best: dict[tuple[int, int], tuple] = {}
    for text, first, hits in index.passages(texts):
        words = texts[text][first : first + 2 * index.step]
        for item, score in hits:
            if shares := index.verified(item, words):
                old = best.get((text, item))
                row = max((min(shares), score, -first, *shares), old[:5] if old else (-1.0,))
                best[text, item] = (*row, (old[5] if old else 0) + 1)
    for (text, item), (_, score, first, question, answer, n) in best.items():
        yield text, item, score, question, answer, -first, n


def shards(benchmark: DataFrame, size: int = SHARD_BYTES) -> Iterator[Index]:
    """The index in parts of about `size` bytes of items each, so that what is sent to executors at once is bounded."""
    rows = benchmark.where("item_id IS NOT NULL AND length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 1
    n = max(1, math.ceil(total / size))

    def batch(b: pa.RecordBatch) -> dict:
        own = [words_of(t) for t in b.column(1).to_pylist()]
        return {"shard": b.column(0), "size": [len(w) for w in own], "words": pa.array([sorted(set(w)) for w in own], pa.list_(pa.binary()))}

    spread = rows.select(F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("shard"), "item_id", "text")
    items = common.mapped(spread.select("shard", "text"), batch, "shard int, size long, words array<binary>").where("size > 0")
    if n > 1:
        items = common.staged(items, "items")
    found = items.agg(F.count(F.lit(1)), F.avg("size"), F.max("size")).first()
    words = items.select("shard", F.explode("words").alias("word"))
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if n > 1:
        df = common.staged(df, "frequencies")
    for s in range(n):
        own = df.join(words.where(F.col("shard") == s), "word", "left_semi") if n > 1 else df
        whole = Statistics(found[0], found[1] or 0.0, found[2] or 0, {bytes(r["word"]): r["n"] for r in own.toLocalIterator()})
        yield Index([(r["item_id"], r["text"]) for r in spread.where(F.col("shard") == s).toLocalIterator()], whole=whole)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each (document, item) whose question and answer a passage of the document holds."""
    found = None
    for index in shards(benchmark):

        def batch(b: pa.RecordBatch, index: Index = index) -> dict:
            ids, texts = b.column(0).to_pylist(), [words_of(t) for t in b.column(1).to_pylist()]
            rows = [(ids[t], index.items[i], *rest) for t, i, *rest in matches(index, texts)]
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.int64())
            return {n: pa.array(c, k) for n, c, k in zip((x.split()[0] for x in SCHEMA.split(", ")), cols, kinds)}

        part = common.mapped(common.narrowed(docs, "doc_id", "text"), batch, SCHEMA)
        found = part if found is None else found.unionAll(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: the documents without a leak, with all their columns. Rows are judged by their own text."""
    at, rows = docs.columns.index("text"), docs
    common.prepare(docs.sparkSession)
    for index in shards(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    texts = [words_of(t) for t in b.column(at).to_pylist()]
                    gone = {m[0] for m in matches(index, texts)}
                    yield b.filter(pa.array([i not in gone for i in range(b.num_rows)]))

        rows = rows.mapInArrow(run, docs.schema)
    return rows
