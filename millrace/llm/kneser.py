"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

The trusted documents (labelled good, not toxic) fall into two folds by a hash of their id: the model is fitted on every one of the even
fold, whole, and thresholds are taken from every one of the other. A caller may bound the first fold by max_docs (and MAX_BYTES of text); the
query doesn't. Counts, continuation counts, counts of counts and
context sums are grouped and joined as tables sharded by n-gram and by context.

log10 p(w | u, v) is a sum of corrections, one for each n-gram and context that the model has: what a context leaves to the lower order,
and what an n-gram has beyond that. So the model is one table from n-grams to values, and a document's log probability the sum of
counts times values over its n-grams: a sharded join of counts. A document's n-grams are counted where it is; a Bloom filter of the
model's n-grams drops those that it lacks; the HOT most frequent of them, which would gather in few tasks, are sent to all tasks
and summed on the spot; the others are joined with the table by key, one of PASSES parts of the n-grams (by the sum of their words' hashes) after another. What is kept of the model are the
trigrams with whole numbers; n-grams' values are made of them when they are asked for. Shuffle files are deleted after each step. Values are whole multiples of 2^-32, so sums don't depend
on their order. Perplexity is compared with the exact quantile, for each language, of the trusted documents that the model hasn't seen.

Null or empty text: no words, perplexity null, not kept. Null language: a language of its own. A language without trusted
documents outside the sample takes the threshold of all languages; without any, everything with words is kept. Ties with
the threshold are kept. Repeated rows are judged alike; extra columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .exchange import mixed
from .simhash import LOWER

MAX_DOCS, MAX_BYTES, QUANTILE = 4_000, 32 << 20, 0.995
#: N-grams sent to all tasks; bits of the filter for each n-gram, and its greatest size; what 1 is as a value.
HOT, FILTER_BITS, FILTER_MOST, SCALE = 1 << 21, 16, 1 << 28, 1 << 32
#: Words sent to all tasks while fitting; parts of the keys that documents and the table are joined by, one after another.
HOT_WORDS, PASSES = 1 << 18, 8
#: Trigrams of the model in one row.
PACK = 1 << 16
#: Bits of the filter that meet in one task, as a power of two.
STRETCH_BITS = 20
#: Where the places of a key in the filter start among its bits.
SHIFTS = (0, 18, 36)
SEED = 42
#: Hashes that stand for the start and the end of a text.
START, END = xxhash.xxh64_intdigest(b"\x00s", SEED), xxhash.xxh64_intdigest(b"\x00e", SEED)
GRAMS = "u long, v long, w long, n long"


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def before(x: np.ndarray, is_start: np.ndarray, start: int) -> np.ndarray:
    """What stands before each place of the texts, start at their first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[is_start] = start
    return out


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u, v, w for every word and the end of each text, as codes; and the hash of each code."""
    words, counts, distinct = common.word_codes([t.translate(LOWER) for t in texts])
    w = np.insert(words, np.cumsum(counts), len(distinct))
    first = np.zeros(len(w), bool)
    first[np.cumsum(counts + 1) - counts - 1] = True
    v = before(w, first, len(distinct) + 1)
    return before(v, first, len(distinct) + 1), v, w, np.append(hashes(distinct), np.array([END, START], np.uint64))


def grams(docs: DataFrame) -> DataFrame:
    """Trigrams with counts, partly summed: one row for each distinct trigram of a batch."""

    def batch(b: pa.RecordBatch) -> dict:
        u, v, w, hashed = sequences(common.raw(b.column(0)))
        many, hashed = len(hashed), hashed.view(np.int64)
        pairs, pair = np.unique(u * many + v, return_inverse=True)
        found, n = np.unique(pair * many + w, return_counts=True)
        first = pairs[found // many]
        return {"u": hashed[first // many], "v": hashed[first % many], "w": hashed[found % many], "n": n}

    return common.mapped(docs.select("text"), batch, GRAMS)


def discounts(table: DataFrame) -> tuple[tuple[float, float, float], tuple[int, int, int]]:
    """Modified Kneser-Ney discounts D1, D2, D3+ from the counts of counts; and how many entries each is taken off."""
    of = {r["n"]: r["k"] for r in table.groupBy(F.least("n", F.lit(5)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (of.get(i, 0) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.1), k - 0.05) for k, x in enumerate(d, 1)), (n1, n2, n3 + n4 + of.get(5, 0))


def discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, F.lit(d[0])).when(n == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def fitted(docs: DataFrame) -> Model:
    """The model's tables. Lower orders count the distinct words before (continuations).

    Whatever is grouped by v, (u, v) or (v, w) is so within partitions by v: trigrams are shuffled once for all of it. What is kept are whole
    numbers, which compress; discounts are taken off where entries are made of them."""
    by_v, by_vw, by_uv = (Window.partitionBy(*c) for c in (["v"], ["v", "w"], ["u", "v"]))

    def by_size(prefix: str, count: Column, own: Column, over) -> dict[str, Column]:
        """How many of a context's entries occur once, twice and more often."""
        return {f"{prefix}{i}": F.sum(F.when(own & c, 1).otherwise(0)).over(over) for i, c in enumerate((count == 1, count == 2, count > 2), 1)}

    n, n2 = F.col("n"), F.col("n2")
    rows = grams(docs).repartition("v").groupBy("u", "v", "w").agg(F.sum("n").alias("n"))
    rows = rows.withColumns({"c3": F.sum("n").over(by_uv), "is_uv": F.col("w") == F.min("w").over(by_uv), **by_size("t", n, F.lit(True), by_uv)})
    rows = rows.withColumns({"n2": F.count(F.lit(1)).over(by_vw), "is_vw": F.col("u") == F.min("u").over(by_vw), "times_vw": F.sum("n").over(by_vw)})
    rows = rows.withColumns({
        "c2": F.count(F.lit(1)).over(by_v), "is_v": F.col("is_vw") & (F.col("w") == F.min("w").over(by_v)), "times_v": F.sum("n").over(by_v), **by_size("s", n2, F.col("is_vw"), by_v),
    })
    three = common.staged(rows, "trigrams")
    two = three.where("is_vw")
    one = common.staged(two.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("times_vw").alias("times")), "words")
    total = one.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    (d1, off), (d2, _), (d3, _) = discounts(one), discounts(two.select(n2.alias("n"))), discounts(three)
    n, k = total["n"] or 1, total["k"] or 0
    gone = sum(d * c for d, c in zip(d1, off)) or 1.0
    unseen = gone / n / (k + 1)
    words = one.select("w", "times", ((F.col("n") - discount(F.col("n"), d1)) / n + unseen).alias("p1"))
    counts = [df.groupBy(F.col(c).alias("n")).agg(F.count(F.lit(1)).alias("k")) for df, c in ((three, "n"), (two, "times_vw"), (words, "times"))]
    counts = common.staged(counts[0].unionAll(counts[1]).unionAll(counts[2]).groupBy("n").agg(F.sum("k").alias("k")), "counts")
    return Model(with_words(three, words), words, counts, unseen, d2, d3)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers, not negative, byte by byte of their weight, as many bytes as the largest needs."""
    x = x.astype(np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return b"".join((x >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(width))


def from_planes(data: bytes, n: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The n numbers, or those at some places."""
    out = np.zeros(n, np.int64)[at]
    for i, plane in enumerate(np.frombuffer(data, np.uint8).reshape(-1, n) if n else ()):
        out |= plane[at].astype(np.int64) << (8 * i)
    return out


GRAM, COUNTS, FLAGS = ("u", "v", "w"), ("n", "c3", "t1", "t2", "t3", "n2", "times_vw", "c2", "s1", "s2", "s3", "times_v"), ("is_vw", "is_uv", "is_v")
ROWS = ", ".join([f"{c} long" for c in (*GRAM, *COUNTS)] + [f"{c} boolean" for c in FLAGS])
PACKED = "known boolean, size long, hashes binary, p1s binary, " + ", ".join(f"{c} binary" for c in (*GRAM, *COUNTS, *FLAGS, "p1"))


def pack(held: list[pa.RecordBatch], known: bool) -> pa.RecordBatch:
    """Trigrams in one row: words by their place among the distinct ones, numbers by planes, flags by bits. known: whether p1 is."""
    col = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (*GRAM, *COUNTS, *FLAGS, "p1")}
    hashes, at = np.unique(np.concatenate([col[c] for c in GRAM]), return_inverse=True)
    p1s, p1 = np.unique(col["p1"], return_inverse=True)
    out = {"known": known, "size": len(col["u"]), "hashes": hashes.tobytes(), "p1s": p1s.tobytes()}
    out |= dict(zip(GRAM, map(planes, np.split(at, 3)))) | {c: planes(col[c]) for c in COUNTS}
    out |= {c: np.packbits(col[c]).tobytes() for c in FLAGS} | {"p1": planes(p1)}
    return pa.RecordBatch.from_pydict({c: pa.array([x]) for c, x in out.items()})


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to about PACK trigrams a row, see pack."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= PACK:
            yield pack(held, True)
            held = []
    if sum(x.num_rows for x in held):
        yield pack(held, True)


class Pack:
    """A row of packed trigrams. Numbers are read at the places they are asked for."""

    def __init__(self, row: dict):
        self.row, self.size = row, row["size"]
        hashed = np.frombuffer(row["hashes"], np.uint64)
        self.words = [hashed[from_planes(row[c], self.size)] for c in GRAM]

    def flagged(self, column: str) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(self.row[column], np.uint8), count=self.size))

    def at(self, column: str, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return from_planes(self.row[column], self.size, at)

    def p1(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.frombuffer(self.row["p1s"], np.float64)[self.at("p1", at)]

    def rows(self) -> pa.RecordBatch:
        """The trigrams without p1."""
        flag = lambda c: np.unpackbits(np.frombuffer(self.row[c], np.uint8), count=self.size).astype(bool)
        out = {c: x.view(np.int64) for c, x in zip(GRAM, self.words)} | {c: self.at(c) for c in COUNTS} | {c: flag(c) for c in FLAGS}
        return pa.RecordBatch.from_pydict(out)


class Frequent:
    """Values of keys that are hashes: found by their highest bits, which say where in the order of keys to look, and not by halving, which
    leaves the processor's caches at each step."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values, self.starts = keys[order], values[order], None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"starts": None}  # made where it is used

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that are here, and of the values of each."""
        bits = max(1, len(self.keys).bit_length())
        if self.starts is None:
            counts = np.bincount((self.keys >> np.uint64(64 - bits)).view(np.int64), minlength=1 << bits)
            self.starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int32)], dtype=np.int32)
        stretch = (keys >> np.uint64(64 - bits)).view(np.int64)
        place, end = self.starts[stretch], self.starts[stretch + 1]
        left = np.flatnonzero(place < end)
        place, end, wanted = place[left], end[left], keys[left]
        found, places = [left[:0]], [place[:0]]
        while len(left):
            hit = self.keys[place] == wanted
            found.append(left[hit])
            places.append(place[hit])
            place += 1
            go = ~hit & (place < end)
            left, place, end, wanted = left[go], place[go], end[go], wanted[go]
        return np.concatenate(found), np.concatenate(places)


def with_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with the p1 of their w, staged in packs (see packed); rows themselves are dropped. The HOT_WORDS most frequent words are sent to all tasks; rows
    of others, which are packed beside, are shuffled to be joined."""
    spark = rows.sparkSession
    top = Top.of(words.groupBy(F.col("times").alias("n")).agg(F.count(F.lit(1)).alias("k")), HOT_WORDS)
    is_top = top.column(F.col("w"), F.col("times"))
    held = words.where(is_top).select("w", "p1").toArrow()
    shared = spark.sparkContext.broadcast(Frequent(held["w"].to_numpy().view(np.uint64), held["p1"].to_numpy()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
        for b in batches:
            at, places = shared.value.find(b.column("w").to_numpy().view(np.uint64))
            hit, p1 = np.zeros(b.num_rows, bool), np.zeros(b.num_rows)
            hit[at], p1[at] = True, shared.value.values[places]
            b = b.append_column("p1", pa.array(p1))
            for known, own in ((True, hit), (False, ~hit)):
                if own.any():
                    held[known].append(b.filter(pa.array(own)))
                if sum(x.num_rows for x in held[known]) >= PACK:
                    yield pack(held[known], known)
                    held[known] = []
        yield from (pack(own, known) for known, own in held.items() if own)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            yield Pack(r).rows()

    with wide_batches(spark):
        path = f"{common.shared_dir(spark)}/millrace-model-{uuid.uuid4().hex}"
        rows.mapInArrow(split, PACKED).write.partitionBy("known").option("compression", "zstd").parquet(path)
        parts = spark.read.schema(PACKED).parquet(path).select(*(c.split()[0] for c in PACKED.split(", ")))
        common.dropped(rows)
        shared.destroy()
        others = parts.where("NOT known").mapInArrow(apart, ROWS).join(words.where(~is_top).select("w", "p1"), "w")
        others = common.staged(others.select(*GRAM, *COUNTS, *FLAGS, "p1").mapInArrow(packed, PACKED), "model")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/known=false")
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return parts.where("known").unionAll(others)


def staged_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Tables of one schema, written to the shared folder one after another and read back as one."""
    path = None
    for df in parts:
        path = path or f"{common.shared_dir(df.sparkSession)}/millrace-{label}-{uuid.uuid4().hex}"
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fetched(df: DataFrame, label: str) -> pa.Table:
    """A small table, by way of the shared folder: the shuffle files behind it are swept when it has been written."""
    held = common.staged(df, label)
    out = held.toArrow()
    common.dropped(held)
    return out


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within are deleted as soon as it has run, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def key(*parts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + x)
    return total


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ENTRY = "key long, value long"
#: Places of those of a batch's n-grams that are wanted, and their keys; from the sum of each one's words, how often those at some places occur, and the keys of those.
Choice = Callable[[np.ndarray, Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]], tuple[np.ndarray, np.ndarray]]


def every(total: np.ndarray, times: Callable, keys: Callable) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(total))
    return at, keys(at)


def entries(model: Model, choice: Choice, then: Batches | None = None, schema: str = ENTRY) -> DataFrame:
    """key, value: what n-grams and contexts of the model add to log10 p over an unseen word's, of those that choice takes.
    An n-gram is the context of what follows it, so a key may have two rows; both have the same times, how often it occurs in the text.
    With then, which goes on with the batches in the same Python worker and gives the schema, n-grams' keys only."""
    rows, words, unseen, d2, d3 = model.rows, model.words, model.unseen, model.d2, model.d3

    def out(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, values = map(np.concatenate, zip(*parts))
        return pa.RecordBatch.from_pydict({"key": keys.view(np.int64)} | ({} if then else {"value": scaled(values)}))

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, times, p1 = (b.column(i).to_numpy() for i in range(3))
            w = w.view(np.uint64)
            at, keys = choice(w, lambda i: times[i], lambda i: key(w[i]))  # noqa: B023
            yield out([(keys, np.log10(p1[at]) - np.log10(unseen))])

    def of_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less = lambda n, d: np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))
        for r in (r for b in batches for r in b.to_pylist()):
            pack = Pack(r)
            u, v, w = pack.words

            def left(i: np.ndarray, prefix: str, whole: str, d: tuple) -> np.ndarray:
                once, twice, more = (pack.at(f"{prefix}{k}", i) for k in (1, 2, 3))  # noqa: B023
                return (once * d[0] + twice * d[1] + more * d[2]) / pack.at(whole, i)  # noqa: B023

            left2 = lambda i: left(i, "s", "c2", d2)  # noqa: E731, B023
            left3 = lambda i: left(i, "t", "c3", d3)  # noqa: E731, B023

            def p2(i: np.ndarray, left2: np.ndarray) -> np.ndarray:
                n2 = pack.at("n2", i)  # noqa: B023
                return (n2 - less(n2, d2)) / pack.at("c2", i) + left2 * pack.p1(i)  # noqa: B023

            def of_three(i: np.ndarray) -> np.ndarray:
                n, left, lower = pack.at("n", i), left3(i), p2(i, left2(i))  # noqa: B023
                p3 = (n - less(n, d3)) / pack.at("c3", i) + left * lower  # noqa: B023
                return np.log10(p3) - np.log10(left) - np.log10(lower)

            def of_two(i: np.ndarray) -> np.ndarray:
                left = left2(i)  # noqa: B023
                return np.log10(p2(i, left)) - np.log10(left) - np.log10(pack.p1(i))  # noqa: B023

            vw = pack.flagged("is_vw")
            kinds = [((u, v, w), "n", of_three, np.arange(pack.size)), ((v[vw], w[vw]), "times_vw", of_two, vw)]
            if not then:
                uv, v1 = pack.flagged("is_uv"), pack.flagged("is_v")
                kinds.append(((u[uv], v[uv]), "c3", lambda i: np.log10(left3(i)), uv))  # noqa: B023
                kinds.append(((v[v1],), "times_v", lambda i: np.log10(left2(i)), v1))  # noqa: B023
            parts = []
            for gram, times, value, own in kinds:
                at, keys = choice(reduce(np.add, gram), lambda i: pack.at(times, own[i]), lambda i: key(*(x[i] for x in gram)))  # noqa: B023
                parts.append((keys, keys if then else value(own[at])))
            yield out(parts)

    run = lambda f: f if then is None else lambda batches: then(f(batches))
    return words.select("w", "times", "p1").mapInArrow(run(of_words), schema).unionAll(rows.mapInArrow(run(of_trigrams), schema))


def scaled(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE).astype(np.int64)


class Filter:
    """A Bloom filter with three places a key."""

    def __init__(self, keys: np.ndarray, n: int | None = None):
        """n: for how many keys there is to be room."""
        size = 1 << min(FILTER_MOST.bit_length() - 1, max(10, int((len(keys) if n is None else n) * FILTER_BITS).bit_length()))
        self.mask, self.bits = np.uint64(size - 1), np.zeros(size >> 3, np.uint8)
        for at in self._places(keys, self.mask):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        return cls.made(keys.sparkSession, keys.mapInArrow, keys.count())

    @classmethod
    def made(cls, spark: SparkSession, mapped: Callable[[Batches, str], DataFrame], n: int) -> Filter:
        """The filter of the n keys that a table's first column holds, made in the tasks: each sends the places of its keys, those of a stretch
        of the filter meet, and the driver gets the bits, never the keys. mapped: mapInArrow over the table."""
        out = cls(np.zeros(0, np.uint64), n)
        mask = out.mask  # the tasks need no bits

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                at = np.sort(np.concatenate(list(cls._places(b.column(0).to_numpy().view(np.uint64), mask))))
                at = at[np.diff(at, prepend=~at[:1]) != 0]
                stretch = (at >> np.uint64(STRETCH_BITS)).astype(np.int64)
                new = np.flatnonzero(np.diff(stretch, prepend=-1))
                # Steps from place to place.
                steps = [np.diff(x, prepend=np.uint64(0)) for x in np.split(at & np.uint64((1 << STRETCH_BITS) - 1), new[1:])]
                yield pa.RecordBatch.from_pydict({"stretch": stretch[new], "n": np.diff(np.append(new, len(at))), "at": pa.array(map(planes, steps), pa.binary())})

        def joined(table: pa.Table) -> pa.Table:
            own = np.zeros(1 << STRETCH_BITS >> 3, np.uint8)
            for x, n in zip(table["at"].to_pylist(), table["n"].to_pylist()):
                at = np.cumsum(from_planes(x, n))
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            return pa.table({"stretch": table["stretch"][:1], "bits": pa.array([own.tobytes()], pa.binary())})

        with wide_batches(spark):
            found = fetched(mapped(places, "stretch long, n long, at binary").groupBy("stretch").applyInArrow(joined, "stretch long, bits binary"), "filter")
        for stretch, bits in zip(found["stretch"].to_pylist(), found["bits"].to_pylist()):
            a = stretch << STRETCH_BITS >> 3
            part = out.bits[a : a + (1 << STRETCH_BITS >> 3)]
            part[:] = np.frombuffer(bits, np.uint8, len(part))
        return out

    @staticmethod
    def _places(keys: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
        for shift in SHIFTS:
            yield (keys >> np.uint64(shift)) & mask

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be among those held."""
        found = np.arange(len(keys))
        for shift in SHIFTS:
            at = (keys[found] >> np.uint64(shift)) & self.mask
            found = found[(self.bits[(at >> np.uint64(3)).view(np.int64)] >> (at.astype(np.uint8) & 7)) & 1 == 1]
        return found


@contextmanager
def wide_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of many narrow rows, still bounded by bytes, for what is planned within."""
    common.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(1 << 18))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    try:
        yield
    finally:
        common.prepare(spark)


@dataclass
class Model:
    """rows: packs (see packed) of trigrams (u, v, w), how often they occur (n), how often their contexts do (c3 for u, v; c2, of distinct trigrams, for v) and how
    many entries of these occur once, twice and more often (t1 to t3, s1 to s3); n2, the distinct words before (v, w); p1 of w; times_vw and
    times_v, how often (v, w) and v occur; flags that mark one row of each (v, w), (u, v) and v. words: w, times, p1. counts: k n-grams occur n times. unseen: the probability of a
    word never seen. d2, d3: discounts."""

    rows: DataFrame
    words: DataFrame
    counts: DataFrame
    unseen: float
    d2: tuple[float, float, float]
    d3: tuple[float, float, float]


@dataclass
class Top:
    """The most frequent keys: those that occur `least` times, and of those that occur `some` times the ones below `edge`."""

    least: int
    some: int
    edge: int

    @classmethod
    def of(cls, counts: DataFrame, room: int) -> Top:
        """From (n, k), k keys that occur n times: whole classes from the most frequent down while there is room; of the next one the share
        that fits, by the key, which is a hash."""
        least = 1 << 62
        for r in counts.orderBy(F.desc("n")).toLocalIterator():
            if r["k"] > room:
                share = room / r["k"] if room > 1000 else 0.0
                return cls(least, r["n"] if share else -1, int(-(1 << 63) + share * 0.98 * (1 << 64)))
            room, least = room - r["k"], r["n"]
        return cls(least, -1, 0)

    def column(self, key: Column, times: Column) -> Column:
        return (times >= self.least) | ((times == self.some) & (key < F.lit(self.edge)))

    def has(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        return (times >= self.least) | ((times == self.some) & (keys.view(np.int64) < self.edge))


class Lookup:
    """The model's table: a filter of its keys and the most frequent entries for all tasks, the others as tables to be joined, one for each
    of PASSES parts of the keys, made when it is needed.
    What is sent is made for each surprise, and freed when the documents have been scored by it. It is bounded, by HOT and FILTER_MOST; where the filter is full, more is asked of the table, which answers alike."""

    def __init__(self, spark: SparkSession, model: Model, hot: int | None = None):
        self.spark, self.model, self.shared = spark, model, None
        self.top = Top.of(model.counts, HOT if hot is None else hot)
        self.unseen = round(float(np.log10(model.unseen)) * SCALE)

    def sent(self) -> Broadcast:
        """What all tasks get, made when it is needed."""
        if self.shared:
            return self.shared
        spark, model, top = self.spark, self.model, self.top
        start = np.array([START], np.uint64)
        first = np.concatenate([key(start), key(start, start)])
        low = top.least if top.some < 0 else top.some

        def frequent(total: np.ndarray, times: Callable, keys: Callable) -> tuple[np.ndarray, np.ndarray]:
            n = times(np.arange(len(total)))
            at = np.flatnonzero((n >= low) | (total == start[0]) | (total == (start + start)[0]))
            k = keys(at)
            hit = top.has(k, n[at]) | (k == first[0]) | (k == first[1])
            return at[hit], k[hit]

        with wide_batches(spark):
            held = entries(model, frequent)
            held = fetched(held.groupBy("key").agg(F.sum("value").alias("value")), "top")
        own, values = held["key"].to_numpy().view(np.uint64), held["value"].to_numpy()
        # What the first word's contexts leave, the same in each document.
        self.first = int(values[np.isin(own, first)].sum())
        n = model.counts.agg(F.sum("k")).first()[0] or 0
        self.shared = spark.sparkContext.broadcast((Filter.made(spark, lambda f, schema: entries(model, every, f, schema), n), Frequent(own, values)))
        return self.shared

    def unsent(self) -> None:
        """Frees its files, on the driver too."""
        self.shared.destroy()
        self.shared = None

    def rest(self, part: int, parts: int) -> DataFrame:
        """The entries whose words add up to the part, modulo parts: seen before anything is hashed."""
        top = self.top

        def infrequent(total: np.ndarray, times: Callable, keys: Callable) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(total % np.uint64(parts) == part)
            n = times(at)
            at, n = at[n < top.least], n[n < top.least]
            k = keys(at)
            out = ~top.has(k, n)
            return at[out], k[out]

        return entries(self.model, infrequent)


def valued(keys: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Values of the frequent keys, 0 for others; and the places of those that the joined table may have."""
    maybe, frequent = model
    at, places = frequent.find(keys)
    out, left = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    out[at], left[at] = frequent.values[places], False
    left = np.flatnonzero(left)
    return out, left[maybe.may_have(keys[left])]


ASKED = {"size": pa.int64(), "owners": pa.binary(), "codes": pa.binary(), "hashes": pa.binary(), "flags": pa.binary()}
PARTLY = "row long, doc_id long, lang string, n_words long, total long, size long, owners binary, codes binary, hashes binary, flags binary"


def longer(before: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The keys of n-grams with one more word."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + x)


def asked(flat: np.ndarray, hashed: np.ndarray, owner: np.ndarray, start: np.ndarray, ends: list[np.ndarray]) -> dict:
    """What a batch asks of the joined table, packed: ends has the places where such words, bigrams and trigrams end. Their words are
    kept rather than their keys, as neighbours share them."""
    marks = np.zeros((1 + len(ends), len(flat)), bool)
    for mark, at in zip(marks, (start, *ends)):
        mark[at] = True
    need, two = marks[1] | marks[2] | marks[3], marks[2] | marks[3]
    inside = ~marks[0]  # a word of the text stands before
    need[:-1] |= two[1:] & inside[1:]
    need[:-2] |= marks[3, 2:] & inside[2:] & inside[1:-1]
    at = np.flatnonzero(need)
    used = np.zeros(len(hashed), bool)
    used[flat[at]] = True
    code = (np.cumsum(used) - 1)[flat[at]]
    return {
        "size": len(at), "owners": planes(np.diff(owner[at], prepend=0)), "codes": planes(code), "hashes": hashed[used].tobytes(),
        "flags": np.packbits(marks[:, at]).tobytes(),
    }


def asked_keys(row: dict, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one pack: each key asked of a part (see Lookup.rest), and the number of its row."""
    n = row["size"]
    flags = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=4 * n).astype(bool).reshape(4, n)
    rows = row["row"] + np.cumsum(from_planes(row["owners"], n))
    w = np.frombuffer(row["hashes"], np.uint64)[from_planes(row["codes"], n)]
    v = before(w, flags[0], START)
    u = before(v, flags[0], START)
    keys, owners = [], []
    for gram, flag in zip(((w,), (v, w), (u, v, w)), flags[1:]):
        at = np.flatnonzero(flag & (reduce(np.add, gram) % np.uint64(parts) == part))
        keys.append(key(*(x[at] for x in gram)))
        owners.append(rows[at])
    return np.concatenate(keys), np.concatenate(owners)


def surprise(docs: DataFrame, model: Lookup) -> DataFrame:
    """doc_id, lang, n_words, log10_prob."""
    shared, unseen, first = model.sent(), model.unseen, model.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            words, counts, distinct = common.word_codes([t.translate(LOWER) for t in common.raw(b.column(2))])
            ends, sizes = np.cumsum(counts), counts + 1
            flat = np.insert(words, ends, len(distinct))
            w = np.append(hashes(distinct), np.uint64(END))
            owner, start = common.owners(sizes), np.cumsum(sizes) - sizes
            once, rest1 = valued(key(w), shared.value)
            hashed, k1, w = w, key(w)[flat], w[flat]
            s1 = key(np.array([START], np.uint64))
            k2 = longer(np.concatenate([s1, k1[:-1]]), w)
            k2[start] = longer(np.repeat(s1, len(start)), w[start])
            s2 = longer(s1, np.array([START], np.uint64))
            k3 = longer(np.concatenate([s2, k2[:-1]]), w)
            k3[start] = longer(np.repeat(s2, len(start)), w[start])
            (v2, rest2), (v3, rest3) = valued(k2, shared.value), valued(k3, shared.value)
            total = common.sums(once[flat] + v2 + v3, sizes) + sizes * unseen + first
            may = np.zeros(len(distinct) + 1, bool)
            may[rest1] = True
            found = asked(flat, hashed, owner, start, [np.flatnonzero(may[flat]), rest2, rest3])
            # The first row of a batch carries what all ask.
            packs = {c: pa.array([found[c] if i == 0 and found["size"] else None for i in range(len(counts))], kind) for c, kind in ASKED.items()}
            yield pa.RecordBatch.from_pydict({"row": row + np.arange(len(counts)), "doc_id": b.column(0), "lang": b.column(1), "n_words": counts, "total": total, **packs})
            row += len(counts)

    parts = PASSES

    def requests(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        """row, key and how often, of one part of the keys."""
        for r in (r for b in batches for r in b.to_pylist()):
            keys, rows = asked_keys(r, part, parts)
            order = np.lexsort((keys, rows))
            keys, rows = keys[order], rows[order]
            new = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            yield pa.RecordBatch.from_pydict({"row": rows[new], "key": keys[new].view(np.int64), "times": np.diff(np.append(new, len(keys)))})

    def answered(part: int) -> DataFrame:
        wanted = partly.where("size > 0").select("row", *ASKED).mapInArrow(lambda x: requests(x, part), "row long, key long, times long")
        # Hashed, not sorted: a key has two entries at most, so no task's share of the table is large.
        return wanted.join(model.rest(part, parts).hint("shuffle_hash"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"))

    common.prepare(docs.sparkSession)
    # Written once: the numbers of rows hold from then on.
    partly = common.staged(common.narrowed(docs, "doc_id", "lang", "text").mapInArrow(run, PARTLY), "partly")
    model.unsent()
    # A part of the keys at a time, so that only that part of what is asked and of the table lies in shuffle files.
    with wide_batches(docs.sparkSession):
        more = staged_parts(map(answered, range(parts)), "more").groupBy("row").agg(F.sum("more").alias("more"))
    total = F.col("total") + F.coalesce(F.col("more"), F.lit(0))
    return partly.drop(*ASKED).join(more, "row", "left").select("doc_id", "lang", "n_words", (total.cast("double") / SCALE).alias("log10_prob"))


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the documents labelled good and not toxic, each once."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id")


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents with these ids. A filter of the ids, sent to all tasks, keeps the text of others out of the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter.of(ids.select(F.xxhash64("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = shared.value.may_have(b.column(2).to_numpy().view(np.uint64))
                yield b.select([0, 1]).take(pa.array(at))

    common.prepare(docs.sparkSession)
    rows = common.narrowed(docs, "doc_id", "text").where("doc_id IS NOT NULL").withColumn("at", F.xxhash64("doc_id"))
    return rows.mapInArrow(run, "doc_id long, text string").join(ids, "doc_id", "left_semi")


def bounded(docs: DataFrame, half: DataFrame, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """At most max_docs of the ids, those of least hash; and their documents, whole, up to MAX_BYTES of text."""
    sample = common.staged(half.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs), "sample")
    fit = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi")  # at most max_docs ids
    sizes = fit.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"))  # at most max_docs rows
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = common.staged(sizes.withColumn("so_far", F.sum("size").over(so_far)).where(F.coalesce("so_far", F.lit(0)) <= MAX_BYTES).select("doc_id"), "inside")
    return sample, fit.join(F.broadcast(inside), "doc_id", "left_semi")


def as_bits(b: pa.RecordBatch) -> dict:
    """Doubles that aren't negative are in the order of their bits."""
    return {"lang": b.column(0), "whole": b.column(1), "bits": b.column(2).to_numpy().view(np.int64)}


def as_doubles(b: pa.RecordBatch) -> dict:
    return {"lang": b.column(0), "whole": b.column(1), "threshold": b.column(2).to_numpy().view(np.float64)}


def thresholds(rest: DataFrame, quantile: float) -> DataFrame:
    """lang, whole, threshold: the least perplexity that at least the quantile of a language's rows don't exceed; once (whole) of all
    rows. Exact: 16 bits of it are found at a time, from counts by those bits, so no task gathers a language's rows."""
    rows = rest.where("perplexity IS NOT NULL").select("lang", F.explode(F.array(F.lit(False), F.lit(True))).alias("whole"), "perplexity")
    rows = common.mapped(rows.withColumn("lang", F.when(~F.col("whole"), F.col("lang"))), as_bits, "lang string, whole boolean, bits long")
    rows = common.staged(rows, "thresholds")
    now = rows.groupBy("lang", "whole").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(quantile))).alias("rank"))
    now = now.withColumn("top", F.lit(0).cast("long"))
    for shift in (48, 32, 16, 0):
        a, b = rows.alias("a"), now.alias("b")
        inside = F.shiftrightunsigned("a.bits", shift + 16) == F.col("b.top") if shift < 48 else F.lit(True)
        on = F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.whole") == F.col("b.whole")) & inside
        counts = a.join(b, on).groupBy("a.lang", "a.whole", "b.rank", F.shiftrightunsigned("a.bits", shift).alias("top")).agg(F.count(F.lit(1)).alias("k"))
        upto = Window.partitionBy("lang", "whole").orderBy("top").rowsBetween(Window.unboundedPreceding, 0)  # at most 2^16 rows
        counts = counts.withColumn("upto", F.sum("k").over(upto)).where("upto >= rank AND upto - k < rank")
        now = common.staged(counts.select("lang", "whole", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), "top"), "thresholds")
    return common.mapped(now.select("lang", "whole", "top"), as_doubles, "lang string, whole boolean, threshold double")


def judged(docs: DataFrame, labels: DataFrame, max_docs: int | None = MAX_DOCS, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, log10_prob, perplexity, threshold, kept: one row for each document. With max_docs None the model is
    fitted on the whole fold."""
    with swept(docs.sparkSession):
        rows, at = _scored(docs, trusted(labels.withColumn("doc_id", F.col("doc_id").cast("long"))), max_docs, quantile)
    # What the caller may run more than once isn't swept.
    by_lang = at.where("NOT whole").select(F.col("lang").alias("of"), "threshold")
    overall = at.where("whole").agg(F.max("threshold").alias("overall"))
    out = rows.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").join(F.broadcast(overall))  # one row
    threshold = F.coalesce("threshold", "overall", F.lit(float("inf")))
    kept = F.coalesce(F.col("perplexity") <= threshold, F.lit(False))
    return out.select("doc_id", "lang", "n_words", "log10_prob", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def _scored(docs: DataFrame, good: DataFrame, max_docs: int | None, quantile: float) -> tuple[DataFrame, DataFrame]:
    """The documents with their perplexity, and the thresholds; both staged."""
    half = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    if max_docs is None:
        sample = common.staged(half, "sample")
        fit = among(docs, sample)
    else:
        sample, fit = bounded(docs, half, max_docs)
    model = Lookup(docs.sparkSession, fitted(fit))
    perplexity = F.when(F.col("n_words") > 0, F.pow(F.lit(10.0), F.least(F.lit(300.0), -F.col("log10_prob") / (F.col("n_words") + 1))))
    rows = common.staged(surprise(docs, model).withColumn("perplexity", perplexity), "perplexity")
    common.dropped(model.model.rows)
    rest = rows.join(good.join(sample, "doc_id", "left_anti"), "doc_id", "left_semi")
    at = common.staged(thresholds(rest, quantile), "thresholds")
    return rows, at
