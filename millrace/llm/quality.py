"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document. The ledger keeps the measurements and one bit for each rule that
fails; policies are versioned sets of bits applied afterwards, and ablations are bitwise aggregations of the ledger, so
neither reads a text again.

Null or empty text: no words, all counts 0, so `few_words` fails. Null ids pass through. Repeated rows give repeated rows.
An empty table gives an empty ledger. Extra columns are not carried into the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 8
SYMBOLS, UPPER, INNER = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(0x80, 0xC0))
LETTERS = UPPER + UPPER.lower()
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: Rule by bit: the condition under which a document fails it, given a way to read a measurement.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < 20,
    "repeated_windows": lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"),
    "symbols": lambda m: 10 * m("n_symbols") > m("n_words"),
    "repeated_lines": lambda m: (m("n_lines") >= 4) & (100 * m("n_dup_lines") > 30 * m("n_lines")),
    "word_length": lambda m: (m("word_chars") > 25 * m("n_words")) | (m("word_chars") < 2 * m("n_words")),
    "upper_case": lambda m: (m("n_words") >= 20) & (100 * m("n_upper") > 40 * m("n_letters")),
    "marks": lambda m: (m("n_words") >= 20) & (10 * m("n_marks") > 3 * m("n_words")),
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "upper_case", "marks"),
}


def repeated_windows(words: list[bytes], counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Mask of the words that lie in a window of `width` (a power of two) words found twice or more in their text.

    Windows get exact ids by doubling: ids of width 2k are the distinct pairs of ids of width k. Memory is linear."""
    n = len(words)
    if n < width:
        return np.zeros(n, bool)
    ids, doc, k = common.coded(words)[0], common.owners(counts), 1
    while k < width:
        pair = ids[: len(ids) - k] * (int(ids.max()) + 1) + ids[k:]
        ids, k = pd.factorize(pair)[0].astype(np.int64), 2 * k
    at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    if not len(at):
        return np.zeros(n, bool)
    key, _ = pd.factorize(ids[at] * len(counts) + doc[at])
    return common.covered(n, at[np.bincount(key)[key] > 1], width)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    words, counts = common.flat_words(texts)
    out = {m: np.zeros(len(texts), np.int64) for m in MEASURES}
    out["n_words"] = counts
    out["n_repeat_words"] = common.sums(repeated_windows(words, counts), counts)
    for i, t in enumerate(texts):
        bare = t.translate(None, b" \t\n\v\f\r")
        out["word_chars"][i] = len(bare.translate(None, INNER))
        out["n_symbols"][i] = len(bare) - len(bare.translate(None, SYMBOLS))
        out["n_upper"][i] = len(bare) - len(bare.translate(None, UPPER))
        out["n_letters"][i] = len(bare) - len(bare.translate(None, LETTERS))
        out["n_marks"][i] = t.count(b"!!") + t.count(b"??") + t.count("…".encode()) + t.count(b"...")
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def _batch(b: pa.RecordBatch) -> dict:
    return {"doc_id": b.column(0)} | measure(common.raw(b.column(1)))


def bits(measurement: Callable[[str], Column] = F.col) -> Column:
    """The failure bits, one for each rule, from the measurements."""
    total = F.lit(0).cast("long")
    for name, fails in RULES.items():
        total = total + F.when(fails(measurement), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
    return total


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits, one row for each document; one scan, no shuffle."""
    return common.mapped(common.narrowed(docs, "doc_id", "text"), _batch, SCHEMA).withColumn("fail_bits", bits())


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder and read back: policies, verdicts and ablations read it, never a text."""
    return common.staged(ledger(docs), "ledger")


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, that only it rejects, and that would be kept without it. An empty ledger
    gives no rows.

    The ledger is first counted by bit pattern, at most 2^rules rows, so the work per rule doesn't depend on the corpus."""
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy])))
    return (
        patterns.select("p", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.expr("p & r.bit != 0"), F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.expr("p = r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.expr("p & ~r.bit = 0"), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def judged(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The digest of a ledger: base columns, verdict of the policy, bits and measurements."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    return rows.select(
        "doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & passes(policy)).alias("kept"),
        F.lit(policy).alias("policy"), "fail_bits", *MEASURES[5:],
    )


def kept_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """Pipeline stage: the documents a policy keeps, with all their columns; rows aren't matched by id, so null or
    repeated ids do no harm."""
    at, own = docs.columns.index("text"), common.fresh(docs, "ledger")
    kinds = pa.struct([(m, pa.int64()) for m in MEASURES])

    def run(batches):
        for b in batches:
            if b.num_rows:
                got = measure(common.raw(b.column(at)))
                found = pa.StructArray.from_arrays([pa.array(got[m], pa.int64()) for m in MEASURES], fields=list(kinds))
                yield b.append_column(own, found)

    common.prepare(docs.sparkSession)
    row = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, row)]))
    failed = bits(lambda m: F.col(own)[m]).bitwiseAND(F.lit(mask(policy)).cast("long"))
    return rows.where(failed == 0).drop(own)
