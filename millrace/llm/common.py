"""What the training-data operators share: words, Arrow batches, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One Arrow batch is at most this large, so that a Python worker's memory is bounded.
BATCH_ROWS, BATCH_BYTES = 1024, "8m"
#: Characters that separate words.
SPACE = "\\x20\\x09-\\x0D"


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes for plans made from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where everything runs in one process (tests) a
    folder of our own does instead."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, so a lost executor costs a reread only."""
    path = f"{shared_dir(df.sparkSession)}/millrace-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def narrowed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, ids as longs; extra columns, whatever their names, don't go on."""
    return docs.select(*(F.col("doc_id").cast("long").alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in columns))


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, b"" for null."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def flat_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words one after another, and the number of words of each text.

    bytes.split() parts at exactly 0x20 and 0x09-0x0D."""
    words, counts = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        counts[i] = len(w)
        words += w
    return words, counts


def coded(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """A code for each word, equal just for equal words, and the distinct words by code."""
    found = pa.array(words, pa.large_binary()).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as codes, the number of words of each text, and the distinct words by code; only those
    become objects."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inner = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inner.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inner])])
    found = words.dictionary_encode()
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    _, at, flat = found.dictionary.buffers()
    cuts, flat = np.frombuffer(at, np.int64, len(found.dictionary) + 1).tolist(), flat.to_pybytes() if flat else b""
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def owners(counts: np.ndarray) -> np.ndarray:
    """The text's index for each of its words."""
    return np.repeat(np.arange(len(counts)), counts)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask over n places of those that a window [start, start + width) holds."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's run of values, with 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow with f(RecordBatch) -> dict of columns, for each batch that has rows."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(f(b))

    return df.mapInArrow(run, schema)
