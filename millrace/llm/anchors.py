"""Substring dedup over words by fixed-block anchors.

The index holds the non-overlapping blocks of (width + 1) // 2 words of every document: any window of `width` words holds
one whole. Every rolling window of a block's length probes it. Where a probe meets a block of another document, both sides
are extended: the windows of `width` words around the meeting are compared by 96-bit keys, and those whose words also start
in a document of smaller id are covered. The union of covered windows is the union of the maximal exact repeats of
at least `width` words. Probes, blocks and windows travel packed (see exchange); no pair of documents is ever formed, so a
passage in a third of all documents costs what any other text does.

Null or empty text: no words. Documents of fewer than `width` words are kept whole. Rows of equal id don't cover each
other; null ids neither cover nor are covered. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common
from .exchange import ANSWER, CHUNK_BYTES, PACKED, PACKED_ARROW, Entries, Rows, chunked, empty, mixed, pack, places, rolled

WIDTH = 13
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class Words:
    """A chunk's words, and the windows that lie within one document of known id and of at least `width` words."""

    def __init__(self, rows: Rows, width: int):
        self.rows, self.width = rows, width
        codes, self.counts, distinct = common.word_codes(rows.texts)
        self.values = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes]
        self.owner = common.owners(self.counts)
        ends = np.cumsum(self.counts)
        self.first, self.last = (ends - self.counts)[self.owner], ends[self.owner]
        self.fit = rows.known[self.owner] & (self.counts[self.owner] >= width)

    def windows(self, width: int) -> np.ndarray:
        """Starts of the windows of `width` words."""
        return np.flatnonzero(self.fit & (np.arange(len(self.values)) + width <= self.last))

    def keys(self, at: np.ndarray, width: int, base: int) -> np.ndarray:
        return rolled(self.values, width, base)[at] if len(at) else np.zeros(0, np.uint64)


def _probes(rows: Rows, width: int) -> tuple[Words, np.ndarray, np.ndarray]:
    block = (width + 1) // 2
    words = Words(rows, width)
    at = words.windows(block)
    return words, at, words.keys(at, block, BASES[0])


def sent(rows: Rows, width: int, n: int) -> pa.Table:
    """Probes of a chunk, marked where they are blocks of the index."""
    words, at, keys = _probes(rows, width)
    return pack(rows, words.owner[at], keys, n, (at - words.first[at]) % ((width + 1) // 2) == 0)


def met(bucket: int, entries: Entries) -> pa.Table:
    """Probes that meet a block of a smaller document, and blocks that a larger document's probe meets."""
    order, starts, run = entries.groups()
    docs, marks = entries.docs[order], entries.marks[order]
    top = np.iinfo(np.int64).max
    low = np.minimum.reduceat(np.where(marks, docs, top), starts)[run]
    high = np.maximum.reduceat(docs, starts)[run]
    hit = np.zeros(len(docs), bool)
    hit[order] = (low < docs) | (marks & (high > docs))
    return entries.answer(bucket, hit)


def _extended(rows: Rows, answers: pa.Table, width: int, n: int) -> tuple[Words, np.ndarray]:
    """Starts of the windows that hold a meeting."""
    words, at, keys = _probes(rows, width)
    hits = at[places(answers, keys, n)]
    block = (width + 1) // 2
    near = np.zeros(len(words.values) + width, np.int32)
    np.add.at(near, np.maximum(hits - (width - block), 0), 1)
    np.add.at(near, hits + 1, -1)
    full = words.windows(width)
    return words, full[np.cumsum(near)[full] > 0]


def extended(rows: Rows, answers: pa.Table, width: int, n: int) -> pa.Table:
    words, at = _extended(rows, answers, width, n)
    return pack(rows, words.owner[at], words.keys(at, width, BASES[1]), n, None, words.keys(at, width, BASES[2]))


def repeated(entries: Entries) -> np.ndarray:
    """For every entry: whether a smaller document has its key."""
    order, starts, run = entries.groups()
    docs = entries.docs[order]
    hit = np.zeros(len(docs), bool)
    hit[order] = np.minimum.reduceat(docs, starts)[run] < docs
    return hit


RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", SPAN), ("kept", pa.string())])


def runs_of(mask: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def removed(rows: Rows, met_answers: pa.Table, answers: pa.Table, width: int, n: int) -> pa.Table:
    words, at = _extended(rows, met_answers, width, n)
    hits = at[places(answers, words.keys(at, width, BASES[1]), n)]
    gone = common.covered(len(words.values), hits, width)
    ends = np.cumsum(words.counts)
    out: dict[str, list] = {f.name: [] for f in RESULT_ARROW}
    for i, (a, b) in enumerate(zip((ends - words.counts).tolist(), ends.tolist())):
        own = gone[a:b]
        kept = rows.texts[i].split()
        if own.any():
            kept = [w for w, g in zip(kept, own.tolist()) if not g]
        row = (int(rows.ids[i]) if rows.known[i] else None, b - a, int(own.sum()), runs_of(own), b" ".join(kept).decode("utf-8", "replace"))
        for name, value in zip(out, row):
            out[name].append(value)
    return pa.Table.from_pydict(out, RESULT_ARROW)


def deduplicated(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word numbers, end exclusive), kept (the words left, joined by a space)."""
    rows, n = chunked(docs, chunk_bytes)
    first = (
        rows.groupBy("chunk").applyInArrow(lambda t: sent(Rows.of(t), width, n) if t.num_rows else empty(PACKED_ARROW), PACKED)
        .groupBy("bucket").applyInArrow(lambda k, t: met(k[0].as_py(), Entries.of(t)), ANSWER)
    )

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        return extended(Rows.of(left), right, width, n) if left.num_rows else empty(PACKED_ARROW)

    def judge(key: tuple, t: pa.Table) -> pa.Table:
        entries = Entries.of(t)
        return entries.answer(key[0].as_py(), repeated(entries))

    second = rows.groupBy("chunk").cogroup(first.repartition(n, "chunk").groupBy("chunk")).applyInArrow(extend, PACKED).groupBy("bucket").applyInArrow(judge, ANSWER)
    # Both steps' answers are needed to number the windows again; their common exchanges are made once.
    both = first.selectExpr("*", "0 AS step").unionAll(second.selectExpr("*", "1 AS step"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty(RESULT_ARROW)
        step = right["step"].to_numpy() if right.num_rows else np.zeros(0, int)
        return removed(Rows.of(left), right.filter(pa.array(step == 0)), right.filter(pa.array(step == 1)), width, n)

    return rows.groupBy("chunk").cogroup(both.repartition(n, "chunk").groupBy("chunk")).applyInArrow(finish, RESULT)
