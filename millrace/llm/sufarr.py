"""Substring dedup over bytes by suffix arrays.

A byte goes if a string of WIDTH bytes over it also starts in a document of smaller id. To bring equal strings together
without sorting all suffixes of the corpus, every string of WIDTH bytes is known by an anchor: the leftmost K-gram of least
hash within it, which depends on the string alone. Anchors of one document only are dropped. Around each other anchor lies
a segment, all bytes of the strings that it stands for. Equal segments of an anchor collapse to the one of smallest
id; the others are covered by it. What remains, segments that share an anchor but differ, meets in a bucket. There each is cut
to how far any other of its anchor agrees with it to the left and to the right (no string beyond can be repeated), what is
then equal collapses again, and a suffix array (see lyndon) over the rest puts equal strings side by side and so tells for
every string the smallest document.
All that travels is packed (see exchange): 4 bytes for an anchor, 12 for a shared one, the segment for those that differ.

Null or empty text: nothing to remove. Documents shorter than WIDTH stay whole. Rows of equal id don't cover each other;
null ids neither cover nor are covered. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import copy
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common
from .anchors import runs_of
from .exchange import ANSWER, PACKED, PACKED_ARROW, Entries, Rows, chunked, dealt, empty, pack, places, rolled
from .lyndon import suffix_array

WIDTH, K, CHUNK_BYTES, PIECE = 50, 20, 3 << 20, 1 << 19
SIDE = 32  # bytes beside an anchor that are compared; a segment has at most SPREAD there
SPREAD = WIDTH - K  # an anchor lies at most so many bytes into its string
PLACE_BITS = 20  # of a place within a piece of PIECE bytes and the string that crosses its end
BASE = 0x9E3779B97F4A7C15


def sliding(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every window, by doubling."""
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def anchors_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one text of at least WIDTH bytes: place and hash, and the first and last of the strings it stands for.

    A string's anchor is its leftmost K-gram of least hash, so strings with one anchor are neighbours."""
    grams = rolled(text.astype(np.uint64), K, BASE)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding((grams & ~low) | np.arange(len(grams), dtype=np.uint64), SPREAD + 1)
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], grams[at[first]], first, np.append(first[1:], len(at)) - 1


class Anchors:
    """A chunk's anchors, in order of place, and the segment of each: all bytes of the strings that it stands for."""

    def __init__(self, rows: Rows):
        self.rows = rows
        sizes = np.array([len(t) for t in rows.texts], np.int64)
        self.data = b"".join(rows.texts)
        ends = np.cumsum(sizes)
        none = np.zeros(0, np.int64)
        found = [(none, none.astype(np.uint64), none, none, none)]
        for i in np.flatnonzero(rows.known & (sizes >= WIDTH)).tolist():
            text, base = np.frombuffer(rows.texts[i], np.uint8), ends[i] - sizes[i]
            for a in range(0, len(text) - WIDTH + 1, PIECE):
                at, keys, first, last = anchors_of(text[a : a + PIECE + WIDTH - 1])
                found.append((at + base + a, keys, first + base + a, last + base + a + WIDTH, np.full(len(at), i)))
        self.at, self.keys, self.start, self.end, self.owner = map(np.concatenate, zip(*found))
        self.ends, self.sizes = ends, sizes

    def only(self, which: np.ndarray) -> None:
        for name in ("at", "keys", "owner", "start", "end"):
            setattr(self, name, getattr(self, name)[which])

    def digests(self) -> np.ndarray:
        data, digest = self.data, xxhash.xxh3_64_intdigest
        rows = zip(self.start.tolist(), self.end.tolist(), self.at.tolist())
        return np.fromiter((digest(data[a:b], p - a) for a, b, p in rows), np.uint64, len(self.at))


def sent(table: pa.Table, n: int) -> pa.Table:
    """All anchors of a chunk."""
    rows = Rows.of(table)
    a = Anchors(rows)
    return pack(rows, a.owner, a.keys, n)


def shared(key: tuple, table: pa.Table) -> pa.Table:
    """Anchors that several documents have."""
    entries = Entries.of(table)
    order, starts, run = entries.groups()
    docs = entries.docs[order]
    hit = np.zeros(len(docs), bool)
    hit[order] = (np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts))[run]
    return entries.answer(key[0].as_py(), hit)


def _shared(table: pa.Table, answers: pa.Table, n: int) -> tuple[Rows, Anchors]:
    rows = Rows.of(table)
    a = Anchors(rows)
    a.only(places(answers, a.keys, n))
    return rows, a


def compared(left: pa.Table, right: pa.Table, n: int) -> pa.Table:
    """The shared anchors of a chunk with the digests of their segments."""
    if not left.num_rows:
        return empty(PACKED_ARROW)
    rows, a = _shared(left, right, n)
    return pack(rows, a.owner, a.keys, n, None, a.digests())


def collapsed(key: tuple, table: pa.Table) -> pa.Table:
    """Step 1: entries whose whole segment a smaller document has. Step 2: the smallest of each of several segments."""
    entries = Entries.of(table)
    order = np.lexsort((entries.docs, entries.more, entries.keys))
    k, m, docs = entries.keys[order], entries.more[order], entries.docs[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], m[1:] != m[:-1]])
    low = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
    several = np.add.reduceat(new.astype(int), np.flatnonzero(new_key))[np.cumsum(new_key) - 1] > 1
    out = []
    for step, which in ((1, docs > low), (2, several & (docs == low))):
        hit = np.zeros(len(docs), bool)
        hit[order] = which
        found = entries.answer(key[0].as_py(), hit)
        out.append(found.append_column("step", pa.array([step] * found.num_rows, pa.int32())))
    return pa.concat_tables(out)


SEGMENTS = "bucket int, chunk int, docs binary, keys binary, sizes binary, places binary, data binary"
SEGMENTS_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *((c, pa.binary()) for c in ("docs", "keys", "sizes", "places", "data"))])
BATCH = 1 << 19  # bytes of segments that a suffix array covers, or those of one anchor


def _step(answers: pa.Table, step: int) -> pa.Table:
    return answers.filter(pa.array(answers["step"].to_numpy() == step)) if answers.num_rows else answers


def _differing(table: pa.Table, answers: pa.Table, n: int) -> tuple[Rows, Anchors, np.ndarray, np.ndarray]:
    """The shared anchors, those whose segment is covered whole, and those whose segment differs from others."""
    rows, a = _shared(table, _step(answers, 0), n)
    return rows, a, places(_step(answers, 1), a.keys, n), np.flatnonzero(places(_step(answers, 2), a.keys, n))


def _once(a: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """One of all equal segments of an anchor and a document, and for each segment the number of its like."""
    same = np.stack([a.keys, a.digests(), a.owner.astype(np.uint64)])
    _, first, number = np.unique(same, axis=1, return_index=True, return_inverse=True)
    return first, number.ravel()


def detailed(left: pa.Table, right: pa.Table, n: int) -> pa.Table:
    """The segments that differ, one row for each bucket."""
    if not left.num_rows:
        return empty(SEGMENTS_ARROW)
    rows, a, _, own = _differing(left, right, n)
    a.only(own)
    a.only(_once(a)[0])
    order, starts = dealt(a.keys, n)
    cols: dict[str, list] = {f.name: [] for f in SEGMENTS_ARROW}
    for b in np.flatnonzero(np.diff(starts)).tolist():
        at = order[starts[b] : starts[b + 1]]
        data = b"".join(a.data[x:y] for x, y in zip(a.start[at].tolist(), a.end[at].tolist()))
        keys = (a.keys[at] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        packed = (rows.ids[a.owner[at]].astype("<i8").tobytes(), keys, (a.end - a.start)[at].astype("<u2").tobytes(), (a.at - a.start)[at].astype("u1").tobytes(), data)
        for name, value in zip(cols, (b, rows.chunk, *(zlib.compress(x, 1) for x in packed))):
            cols[name].append(value)
    return pa.Table.from_pydict(cols, SEGMENTS_ARROW)


def repeated(segments: list[bytes], docs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of the strings that a segment of a smaller document holds too, from the segments' suffix array."""
    sizes = np.array([len(s) for s in segments], np.int64)
    joined = b"\x00".join(segments) + b"\x00" * width
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.frombuffer(joined, np.uint8)[: int(sizes.sum()) + len(sizes)].astype(np.int64) + 1
    text[starts + sizes] = 0  # parts the segments, below any byte
    order = np.frombuffer(suffix_array(text.tolist()), np.int64)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    order = order[order + width <= (starts + sizes)[owner[order]]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), 8)
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in [*range(0, width - 8, 8), width - 8]:
        part = np.ascontiguousarray(words[order + k]).view(np.uint64).ravel()
        new[1:] |= part[1:] != part[:-1]
    low = np.minimum.reduceat(docs[owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[low < docs[owner[order]]]
    return owner[hit], hit - starts[owner[hit]]


MASKS = "chunk int, bucket int, masks binary"
MASKS_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("masks", pa.binary())])


@dataclass
class Segments:
    """A bucket's segments: where each lies in `data`, its anchor's place there, its anchor's key and its document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    keys: np.ndarray
    docs: np.ndarray

    @classmethod
    def of(cls, rows: list[dict]) -> Segments:
        part = lambda c, kind: np.concatenate([np.frombuffer(zlib.decompress(r[c]), kind) for r in rows])
        size, data = part("sizes", "<u2").astype(np.int64), part("data", "u1")
        end = np.cumsum(size)
        return cls(data, end - size, end, end - size + part("places", "u1"), part("keys", "<u4"), part("docs", "<i8"))

    def agreed(self, step: int) -> np.ndarray:
        """For each segment, how many bytes beside its anchor the most similar other segment of the anchor shares: to the
        right (step 1) or to the left (-1). The most similar one is a neighbour in sorted order."""
        reach = (self.end - self.at - K) if step > 0 else (self.at - self.start)
        first = self.at + K if step > 0 else self.at - 1
        place = np.arange(SIDE)
        beside = self.data[np.clip(first[:, None] + step * place, 0, len(self.data) - 1)]
        beside[place >= reach[:, None]] = 0
        words = beside.view(">u8")
        order = np.lexsort((reach, *words.T[::-1], self.keys))  # what ends sorts before what goes on
        beside, reach = beside[order], reach[order]
        differ = beside[1:] != beside[:-1]
        common_ = np.where(differ.any(1), differ.argmax(1), SIDE)
        common_ = np.minimum(common_, np.minimum(reach[1:], reach[:-1]))
        common_[self.keys[order][1:] != self.keys[order][:-1]] = 0
        best = np.zeros(len(order), np.int64)
        best[order[1:]] = common_
        best[order[:-1]] = np.maximum(best[order[:-1]], common_)
        return best


def trimmed(s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each segment's repeatable bytes start and end, and which segments have a string of them."""
    left, right = s.agreed(-1), s.agreed(1)
    return s.at - left, s.at + K + right, np.flatnonzero(left + K + right >= WIDTH)


def alike(s: Segments, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each of the segments `own`, the one of smallest document that equals it between start and end."""
    raw = s.data.tobytes()
    order = own[np.lexsort((own, s.docs[own]))]
    first: dict[tuple, int] = {}
    ranges = zip(s.keys[order].tolist(), (s.at - start)[order].tolist(), start[order].tolist(), end[order].tolist(), order.tolist())
    of = np.full(len(s.at), -1, np.int64)
    of[order] = [first.setdefault((k, p, raw[a:b]), i) for k, p, a, b, i in ranges]
    return of[own]


def masks_of(s: Segments) -> np.ndarray:
    """For each segment, a bit for each of its strings that a smaller document has."""
    masks = np.zeros(len(s.at), np.uint32)
    start, end, own = trimmed(s)
    if not len(own):
        return masks
    first = alike(s, start, end, own)
    # The suffix arrays: over what differs, a few anchors at a time, as equal strings have equal anchors.
    once = np.unique(first)
    once = once[np.argsort(s.keys[once], kind="stable")]
    raw, size = s.data.tobytes(), (end - start)[once]
    cuts = np.append(np.flatnonzero(np.diff(s.keys[once].astype(np.int64), prepend=-1)), len(once))
    total = np.concatenate([[0], np.cumsum(size + 1)])
    several = np.diff(cuts) > 1
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(total[cuts], total[cuts[a]] + BATCH, "right")) - 1)
        part = np.concatenate([once[cuts[i] : cuts[i + 1]] for i in range(a, b) if several[i]] or [once[:0]])
        if len(part):
            hit, place = repeated([raw[x:y] for x, y in zip(start[part].tolist(), end[part].tolist())], s.docs[part])
            shift = (start - s.start)[part[hit]] + place
            np.bitwise_or.at(masks, part[hit], np.uint32(1) << shift.astype(np.uint32))
        a = b
    # All strings of what a smaller document's segment equals; segments of one document share their bits, counted from
    # where they are cut.
    before = (start - s.start).astype(np.uint64)
    whole = (np.uint64(1) << (end - start - WIDTH + 1)[own].astype(np.uint64)) - np.uint64(1)
    shared = masks[first].astype(np.uint64) >> before[first]
    masks[own] = (np.where(s.docs[own] > s.docs[first], whole, shared) << before[own]).astype(np.uint32)
    return masks


def sorted_out(key: tuple, table: pa.Table) -> pa.Table:
    """For each segment of a bucket, a bit for each of its strings that a smaller document has."""
    rows = table.to_pylist()
    masks = masks_of(Segments.of(rows))
    ends = np.cumsum([len(zlib.decompress(r["places"])) for r in rows])
    parts = [zlib.compress(masks[a:b].astype("<u4").tobytes(), 1) for a, b in zip(np.concatenate([[0], ends]), ends)]
    return pa.Table.from_pydict({"chunk": table["chunk"].to_pylist(), "bucket": [key[0].as_py()] * len(parts), "masks": parts}, MASKS_ARROW)


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", SPAN), ("kept", pa.binary())])


def removed(left: pa.Table, right: pa.Table, n: int) -> pa.Table:
    if not left.num_rows:
        return empty(RESULT_ARROW)
    rows, a, whole, own = _differing(left, right, n)
    edge = np.zeros(len(a.data) + 1, np.int32)
    np.add.at(edge, a.start[whole], 1)
    np.add.at(edge, a.end[whole], -1)
    differ = copy.copy(a)
    differ.only(own)
    once, number = _once(differ)
    masks = np.zeros(len(once), np.uint32)
    order, starts = dealt(differ.keys[once], n)
    replies = _step(right, 3)
    for b, data in zip(replies["bucket"].to_pylist(), replies["entries"].to_pylist()):
        masks[order[starts[b] : starts[b + 1]]] = np.frombuffer(zlib.decompress(data), "<u4")
    masks = masks[number]
    for bit in range(SPREAD + 1):
        at = a.start[own[(masks >> np.uint32(bit)) & 1 == 1]] + bit
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WIDTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    out: dict[str, list] = {f.name: [] for f in RESULT_ARROW}
    for i, (x, y) in enumerate(zip((a.ends - a.sizes).tolist(), a.ends.tolist())):
        spans = runs_of(gone[x:y])
        cuts = [0, *(p for s in spans for p in (s["start"], s["end"])), y - x]
        kept = b"".join(rows.texts[i][p:q] for p, q in zip(cuts[::2], cuts[1::2]))
        row = (int(rows.ids[i]) if rows.known[i] else None, y - x, y - x - len(kept), spans, kept)
        for name, value in zip(out, row):
            out[name].append(value)
    return pa.Table.from_pydict(out, RESULT_ARROW)


def deduplicated(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (bytes, end exclusive), kept (the bytes left)."""
    rows, n = chunked(docs, chunk_bytes)
    by_chunk = rows.groupBy("chunk")

    # Untyped functions of one, two or three arguments are what applyInArrow tells apart.
    def joined(answers: DataFrame, f, schema: str) -> DataFrame:
        return by_chunk.cogroup(answers.repartition(n, "chunk").groupBy("chunk")).applyInArrow(lambda left, right: f(left, right, n), schema)

    def by_bucket(packed: DataFrame, f, schema: str) -> DataFrame:
        return packed.groupBy("bucket").applyInArrow(lambda key, t: f(key, t), schema)

    first = by_bucket(by_chunk.applyInArrow(lambda t: sent(t, n), PACKED), shared, ANSWER)
    second = by_bucket(joined(first.selectExpr("*", "0 AS step"), compared, PACKED), collapsed, ANSWER + ", step int")
    # Later steps number the anchors by the answers to earlier ones; their common exchanges are made once.
    both = first.selectExpr("*", "0 AS step").unionAll(second)
    third = by_bucket(joined(both, detailed, SEGMENTS), sorted_out, MASKS)
    return joined(both.unionAll(third.selectExpr("chunk", "bucket", "masks", "3")), removed, RESULT)
