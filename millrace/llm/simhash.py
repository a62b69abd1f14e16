"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into `blocks` blocks. Two fingerprints that differ in at most `distance` bits agree in at least
blocks - distance blocks, so they share one of the keys made of that many blocks; the join on keys is exact for every
input. Equal fingerprints are collapsed before the join, so a group of copies enters it once, and each link is kept under
the first key that its two ends share only.

Rows made by explode aren't counted in Spark's estimate of a table's size, so joins of such rows are never broadcast: they are
merge joins whatever the estimate says, and the driver holds none of them.

Null or empty text has fingerprint zero and is linked like any other. Repeated rows are copies. A null doc_id keeps its
row and takes part, but can't be the smallest id. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, SEED, DISTANCE, BLOCKS, SALTS = 4, 42, 4, 7, 32
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the XXH64 of the text's word shingles (repeats included)."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1 :])]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, the fingerprint's bits as a signed long, and mark, a hash that tells texts apart."""

    def batch(b: pa.RecordBatch) -> dict:
        bits = np.array([fingerprint(t, width) for t in common.raw(b.column(1))], np.uint64)
        return {"doc_id": b.column(0), "bits": bits.view(np.int64), "mark": b.column(2)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("mark"))
    return common.mapped(rows, batch, "doc_id long, bits long, mark long")


def block_edges(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block(bits: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (u < v) of distinct fingerprints that differ in at most `distance` bits, each once."""
    edges = block_edges(blocks)
    chosen = list(combinations(range(blocks), blocks - distance))
    keys = F.array(*(F.xxhash64(*(_block(F.col("bits"), *edges[i]) for i in c), F.lit(n)) for n, c in enumerate(chosen)))
    keyed = prints.select("bits", F.posexplode(keys).alias("n", "key"))
    a, b = keyed.selectExpr("bits AS u", "n AS un", "key AS k"), keyed.selectExpr("bits AS v", "n AS vn", "key AS j")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    # The first shared key is made of the first blocks on which both agree.
    same = [(_block(differ, *e) == 0).cast("int") for e in edges]
    need, first, so_far = blocks - distance, F.lit(True), F.lit(0)
    wanted = F.array(*(F.lit(sum(1 << i for i in c)) for c in chosen))
    taken = F.lit(0)
    for i, s in enumerate(same):
        taken = taken + F.when(so_far < need, s * F.lit(1 << i)).otherwise(0)
        so_far = so_far + s
    first = taken == F.get(wanted, F.col("un"))
    on = (F.col("k") == F.col("j")) & (F.col("un") == F.col("vn")) & (F.col("u") < F.col("v")) & (F.bit_count(differ) <= distance) & first
    return a.hint("merge").join(b.hint("merge"), on).select("u", "v")


def classed(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """bits, class, low: the class of every fingerprint, and the smallest id that has the fingerprint."""
    lowest = prints.groupBy("bits").agg(F.min("doc_id").alias("low"))
    parts = components(edges)
    return lowest.join(parts, lowest.bits == parts.node, "left").select("bits", "low", F.coalesce("component", "bits").alias("class"))


def with_class(rows: DataFrame, per_class: DataFrame) -> DataFrame:
    """rows (bits, class, ...) joined with one row a class. A class may hold any share of the fingerprints, so it is dealt to
    SALTS tasks; what is known of a class is repeated for each."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("bits"), F.lit(SALTS)).cast("int"))
    other = per_class.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.hint("merge").join(other.hint("merge"), ["class", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, width: int = SHINGLE) -> DataFrame:
    """doc_id, bits, mark, component_id (smallest doc_id that links reach), class and n_links (links of its fingerprint)."""
    prints = common.staged(fingerprints(docs, width), "prints")
    edges = common.staged(links(prints.select("bits").distinct(), distance, blocks), "links")
    classes = classed(prints, edges)
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = with_class(classes, classes.groupBy("class").agg(F.min("low").alias("component_id")))
    named = named.join(degree, F.col("bits") == F.col("node"), "left")
    named = named.select(F.col("bits").alias("b"), "class", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(named, prints.bits == named.b).select("doc_id", "bits", "mark", "class", "component_id", "n_links")


def hex16(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Pipeline stage: one row of each group of near-duplicates, that of smallest id (then of smallest hash of its text, then
    of smallest hash of the whole row), with all its columns. Rows are told apart by id and text, so where ids repeat, a text
    stays unless it is itself a duplicate. Rows with a null id aren't comparable and stay.

    The rows themselves are shuffled once, to meet the list of those that stay."""
    found = near_duplicates(docs, distance, blocks).where("doc_id IS NOT NULL")
    firsts = found.groupBy("class").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    own, at, rank = (common.fresh(docs, n) for n in ("first_key", "first_at", "first_rank"))
    firsts = firsts.select(F.xxhash64("first.doc_id", "first.mark").alias(own))
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn(at, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    same = Window.partitionBy(at).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    known = rows.join(firsts, F.col(at) == F.col(own), "left_semi").withColumn(rank, F.row_number().over(same)).where(F.col(rank) == 1)
    return known.select(*(F.col(f"`{c}`") for c in docs.columns)).unionAll(docs.where(F.col("doc_id").isNull()))
