"""Exchanging keys between chunks of documents without moving a row for each key.

Documents are dealt by a hash of their id and text to chunks of bounded text, so rows without an id, or of one id, are spread too. A chunk sends the keys of its places (windows, blocks,
anchors) to buckets, one packed row for each (chunk, bucket): 4 or 12 bytes a key, the owners' ids as compressed deltas.
A bucket holds all places of its keys and so can tell which keys other documents hold; it answers each chunk with the
numbers of the entries concerned. Chunks and buckets grow in number with the text, not in size, and equal keys of one
document cost no more than their places, so a hot key doesn't gather rows: it gathers 4 bytes a place.

All uses of the chunked table in a plan share one exchange.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 6 << 20
PACKED = "bucket int, chunk int, ids binary, runs binary, marks binary, keys binary"
ANSWER = "chunk int, bucket int, entries binary"


def chunked(docs: DataFrame, size: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, text, chunk, dealt to chunks of about `size` bytes of text; and their number."""
    total = docs.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 1
    n = max(1, math.ceil(total / size))
    common.prepare(docs.sparkSession)
    rows = common.narrowed(docs, "doc_id", "text").withColumn("chunk", F.pmod(F.hash("doc_id", F.xxhash64("text")), F.lit(n)).cast("int"))
    return rows.repartition(n, "chunk"), n


@dataclass
class Rows:
    """A chunk's documents in order of (doc_id, text); null ids come last and hold no keys."""

    chunk: int
    ids: np.ndarray
    known: np.ndarray
    texts: list[bytes]

    @classmethod
    def of(cls, table: pa.Table) -> Rows:
        ids, texts = table["doc_id"].to_pylist(), common.raw(table["text"].combine_chunks())
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        known = np.array([ids[i] is not None for i in order], bool)
        return cls(table["chunk"][0].as_py(), np.array([ids[i] or 0 for i in order], np.int64), known, [texts[i] for i in order])


def empty(schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([], schema)


PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("ids", pa.binary()), ("runs", pa.binary()), ("marks", pa.binary()), ("keys", pa.binary())])
ANSWER_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("entries", pa.binary())])


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their key's bucket, and where each bucket starts."""
    at = buckets_of(keys, n)
    return np.argsort(at, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])


def pack(rows: Rows, owner: np.ndarray, keys: np.ndarray, n: int, marks: np.ndarray | None = None, more: np.ndarray | None = None) -> pa.Table:
    """One row for each bucket that has keys. owner: index of the key's document, ascending; more: 64 further bits."""
    order, starts = dealt(keys, n)
    cols: dict[str, list] = {f.name: [] for f in PACKED_ARROW}
    for b in np.flatnonzero(np.diff(starts)).tolist():
        own = order[starts[b] : starts[b + 1]]
        data = (keys[own] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        if more is not None:
            data += more[own].astype("<u8").tobytes()
        docs, runs = np.unique(owner[own], return_counts=True)
        ids = zlib.compress(np.diff(rows.ids[docs], prepend=0).astype("<i8").tobytes(), 1)
        flags = np.packbits(marks[own]).tobytes() if marks is not None else b""
        for name, value in zip(cols, (b, rows.chunk, ids, zlib.compress(runs.astype("<u4").tobytes(), 1), flags, data)):
            cols[name].append(value)
    return pa.Table.from_pydict(cols, PACKED_ARROW)


@dataclass
class Entries:
    """All entries of a bucket: document, key, mark, and the place of each chunk's run of them."""

    docs: np.ndarray
    keys: np.ndarray
    marks: np.ndarray
    more: np.ndarray
    chunks: list[int]
    starts: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Entries:
        docs, keys, marks, more = [], [], [], []
        for r in table.select(["ids", "runs", "marks", "keys"]).to_pylist():
            ids = np.cumsum(np.frombuffer(zlib.decompress(r["ids"]), "<i8"))
            runs = np.frombuffer(zlib.decompress(r["runs"]), "<u4")
            n = int(runs.sum())
            docs.append(np.repeat(ids, runs))
            keys.append(np.frombuffer(r["keys"], "<u4", n))
            more.append(np.frombuffer(r["keys"], "<u8", offset=4 * n) if len(r["keys"]) > 4 * n else np.zeros(n, np.uint64))
            flags = r["marks"]
            marks.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool) if flags else np.ones(n, bool))
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        return cls(*map(np.concatenate, (docs, keys, marks, more)), table["chunk"].to_pylist(), starts)

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the entries by key, where each key's run starts, and the run of each place in that order."""
        order = np.lexsort((self.keys, self.more)) if self.more.any() else np.argsort(self.keys, kind="stable")
        k, m = self.keys[order], self.more[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
        return order, np.flatnonzero(new), np.cumsum(new) - 1

    def answer(self, bucket: int, hit: np.ndarray) -> pa.Table:
        """The numbers of the entries hit, for each chunk that has some."""
        cols: dict[str, list] = {f.name: [] for f in ANSWER_ARROW}
        for i, chunk in enumerate(self.chunks):
            own = np.flatnonzero(hit[self.starts[i] : self.starts[i + 1]])
            if len(own):
                for name, value in zip(cols, (chunk, bucket, zlib.compress(np.diff(own, prepend=0).astype("<u4").tobytes(), 1))):
                    cols[name].append(value)
        return pa.Table.from_pydict(cols, ANSWER_ARROW)


def places(answers: pa.Table, keys: np.ndarray, n: int) -> np.ndarray:
    """Mask over a chunk's places of those that the buckets' answers name; keys as they were packed."""
    hit = np.zeros(len(keys), bool)
    if answers.num_rows:
        order, starts = dealt(keys, n)
        for b, data in zip(answers["bucket"].to_pylist(), answers["entries"].to_pylist()):
            hit[order[starts[b] + np.cumsum(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))]] = True
    return hit


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolled(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of each window of `width` values, by doubling; one entry for each place where a window fits."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    block, size, total, held, left = values, 1, None, 0, width
    while True:
        if left & 1:
            total = block if total is None else block[: len(total) - size] * power(held) + total[size:]
            held += size
        left >>= 1
        if not left:
            return mixed(total[:n])
        block = block[:-size] * power(size) + block[size:]
        size *= 2
