"""Token-id output coded by a range asymmetric numeral system (rANS) with static, shared frequency tables.

Format. A token file is a Parquet file whose rows are independent blocks: `shard`, `block`, `first` (ids of the shard before
the block), `n_docs`, `n_tokens`, `data`. `data` is the block: header, document ids and lengths, checkpoints (stream
position and the states of all lanes, every INTERVAL steps), checksums of the ids after each checkpoint, 32-bit code words,
and a CRC-32 of all that. Lanes are interleaved: id number i of a block belongs to lane i mod lanes, so numpy codes one id
of every lane at once. Any part between checkpoints can be decoded alone. Shards are ranges of ascending doc_id.

Parquet as the container gives Spark's commit protocol: a lost executor leaves no half-written block, and files may lie in
any store that Spark can reach.

Null or empty text: the end id only. Null ids come first. Rows of equal id are kept in the order of a hash of their token
ids, so that a hot id is spread over shards, too. An empty table gives no rows. A document is coded whole, in a block of
its own if it is long. Files whose tokenizer isn't built as the fast path assumes go through the tokenizer whole.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, LANES, INTERVAL, BLOCK, SHARD = 20, 2048, 256, 1 << 20, 1 << 24
LOW, MAGIC, VERSION = 1 << 31, b"MRAN", 1
HEADER = struct.Struct("<4sHHIQIIII")
END = 2


# --- coder ---


def quantised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^scale, at least 1 for every id that occurs."""
    freq = np.zeros(len(counts), np.int64)
    seen = counts > 0
    if not seen.any():
        return freq.astype(np.uint64)
    total = float(counts.sum())
    freq[seen] = np.maximum(1, np.floor(counts[seen] / total * (1 << scale)))
    over = int(freq.sum()) - (1 << scale)
    for i in np.argsort(-freq, kind="stable"):
        take = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= take
        over -= take
        if not over:
            break
    if over:
        raise ValueError("more ids than the scale holds")
    return freq.astype(np.uint64)


class Tables:
    """Frequencies, their running sums, and the id of each slot."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.freq, self.scale = freq.astype(np.uint64), scale
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - scale)

    @property
    def slots(self) -> np.ndarray:
        if not hasattr(self, "_slots"):
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def lanes_for(n: int) -> int:
    """A power of two; small blocks get few lanes, as each checkpoint holds 8 bytes a lane."""
    return min(LANES, 1 << max(0, (n // 256).bit_length() - 1)) if n >= 256 else 1


def encode(ids: np.ndarray, t: Tables, interval: int = INTERVAL) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """lanes, checkpoint positions, checkpoint states, words. Coded from the last id to the first, decoded forwards."""
    n, lanes = len(ids), lanes_for(len(ids))
    x = np.full(lanes, LOW, np.uint64)
    steps = -(-n // lanes)
    groups, states, sizes = [], [], np.zeros(steps, np.int64)
    bits, half, low = np.uint64(t.scale), np.uint64(32), np.uint64(0xFFFFFFFF)
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        f, y = t.freq[s], x[: len(s)]
        out = y >= t.limit[s]
        if out.any():
            words = y[out]
            groups.append((words & low).astype(np.uint32))
            sizes[step] = len(words)
            y[out] = words >> half
        q = y // f
        x[: len(s)] = (q << bits) + (y - q * f) + t.start[s]
        if step % interval == 0:
            states.append(x.copy())
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1][::interval] if steps else np.zeros(0, np.int64)
    words = np.concatenate(groups[::-1]) if groups else np.zeros(0, np.uint32)
    return lanes, before.astype(np.uint64), np.array(states[::-1], np.uint64).reshape(-1, lanes), words


def decode(n: int, lanes: int, x: np.ndarray, words: np.ndarray, at: int, t: Tables) -> np.ndarray:
    """n ids from a checkpoint's states and its place in the words."""
    x, out, slots = x.copy(), np.empty(n, np.uint32), t.slots
    bits, mask, low, half = np.uint64(t.scale), np.uint64((1 << t.scale) - 1), np.uint64(LOW), np.uint64(32)
    for a in range(0, n, lanes):
        k = min(lanes, n - a)
        y = x[:k]
        slot = y & mask
        s = slots[slot]
        y = t.freq[s] * (y >> bits) + slot - t.start[s]
        need = y < low
        m = int(need.sum())
        if m:
            y[need] = (y[need] << half) | words[at : at + m]
            at += m
        x[:k] = y
        out[a : a + k] = s
    return out


# --- blocks ---


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, t: Tables, interval: int = INTERVAL) -> bytes:
    lanes, at, states, words = encode(ids, t, interval)
    span = lanes * interval
    sums = np.array([zlib.crc32(ids[a : a + span].astype("<u4").tobytes()) for a in range(0, len(ids), span)], "<u4")
    body = b"".join((
        HEADER.pack(MAGIC, VERSION, t.scale, lanes, len(ids), interval, len(at), len(words), len(doc_ids)),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.asarray(lengths, "<u8").tobytes(), at.astype("<u8").tobytes(), states.astype("<u8").tobytes(), sums.tobytes(), words.astype("<u4").tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A parsed block; part(i) decodes what follows checkpoint i, all() the whole."""

    def __init__(self, data: bytes, t: Tables):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block checksum differs")
        magic, version, scale, self.lanes, self.n, self.interval, points, n_words, n_docs = HEADER.unpack_from(data)
        if (magic, version, scale) != (MAGIC, VERSION, t.scale):
            raise ValueError("not a block of this format")
        self.t, self.at = t, HEADER.size
        known = self._take(data, "u1", n_docs)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, self._take(data, "<i8", n_docs))]
        self.lengths = self._take(data, "<u8", n_docs).astype(np.int64)
        self.points = self._take(data, "<u8", points)
        self.states = self._take(data, "<u8", points * self.lanes).reshape(points, self.lanes).astype(np.uint64)
        self.sums = self._take(data, "<u4", points)
        self.words = self._take(data, "<u4", n_words).astype(np.uint64)

    def _take(self, data: bytes, kind: str, n: int) -> np.ndarray:
        found = np.frombuffer(data, kind, n, self.at)
        self.at += found.nbytes
        return found

    def part(self, i: int) -> np.ndarray:
        span = self.lanes * self.interval
        ids = decode(min(span, self.n - i * span), self.lanes, self.states[i], self.words, int(self.points[i]), self.t)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.sums[i]:
            raise ValueError("ids differ from their checksum")
        return ids

    def all(self) -> np.ndarray:
        return np.concatenate([self.part(i) for i in range(len(self.points))]) if len(self.points) else np.zeros(0, np.uint32)


# --- tokenizer ---

# The contractions that the tokenizer's pattern parts off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Words of these characters are in normal form, lower-case one by one, and have no white space of any kind.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ıĲ-ňŊ-ž]+")
PIECES = re.compile("|".join((*CONTRACTIONS, "[a-zß-öø-ž]+", "[0-9]", "[^0-9a-zß-öø-ž]+")))


# How a tokenizer file must normalise and part texts for the fast path.
FAST = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Tokenizer(dict):
    """Word (bytes) -> number of its run of ids, filled as words turn up.

    The tokenizer drops white space and treats what lies between on its own, so the ids of a text are those of its words
    one after another. Plain words are parted as the tokenizer's pattern does and their pieces go to its BPE model; any
    other word goes through the whole tokenizer, and so does every text if the file's settings aren't those of FAST."""

    LIMIT, PIECES_LIMIT = 800_000, 600_000

    def __init__(self, path: str):
        import tokenizers

        super().__init__()
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, byte_letters()
        settings = json.loads(self.whole.to_str())
        self.fast = all(settings.get(k) == v for k, v in FAST.items())
        self.pieces: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.sizes, self.ids = array("I", [1]), array("I", [END])  # run 0: the end of a document

    def __missing__(self, word: bytes) -> int:
        if word.isalpha():  # ASCII letters only: one piece, the same run of ids in either case
            low = word.lower()
            if low != word:
                self[word] = n = self[low]
                return n
            return self.added(word, self.of_piece(low.decode()))
        text = word.decode("utf-8", "replace")
        if word[:-1].isalpha() and word[-1:] in b".,":
            return self.added(word, self.of_piece(text[:-1].lower()) + self.of_piece(text[-1]))
        if PLAIN.fullmatch(text) and "<|" not in text:
            found = b"".join([self.of_piece(p) for p in PIECES.findall(text.lower())])
        else:
            found = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return self.added(word, found)

    def of_piece(self, text: str) -> bytes:
        return self.pieces.get(text) or self.piece(text)

    def added(self, word: bytes, found: bytes) -> int:
        self[word] = n = len(self.sizes)
        self.sizes.append(len(found) // 4)
        self.ids.frombytes(found)
        return n

    def piece(self, text: str) -> bytes:
        if len(self.pieces) >= self.PIECES_LIMIT:
            self.pieces.clear()
        spelt = text if text.isascii() else "".join(self.letters[b] for b in text.encode())
        found = self.pieces[text] = array("I", [x.id for x in self.model.tokenize(spelt)]).tobytes()
        return found

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has, its end id included."""
        if not self.fast:
            whole = self.whole.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            runs = [[*x.ids, END] for x in whole]
            return np.array([i for r in runs for i in r], np.uint32), np.array([len(r) for r in runs], np.int64)
        if len(self) > self.LIMIT:
            self.reset()
        codes, counts, distinct = common.word_codes(texts)
        runs = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))[codes]
        runs = np.insert(runs, np.cumsum(counts), 0)
        sizes = np.array(self.sizes, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        own = sizes[runs]
        place = np.repeat(starts[runs] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
        return np.frombuffer(self.ids, np.uint32)[place], common.sums(own, counts + 1)


@cache
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(path)


# --- Spark ---

TOKENS = "doc_id long, mark long, ids binary, n_tokens long, counts binary"
BLOCKS = "shard int, block int, first long, n_docs long, n_tokens long, data binary"


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, mark (a hash of the ids), ids (little-endian, the end id last; two bytes each if the vocabulary allows, else
    four), n_tokens, and on one row of each task, else null, how often each id occurs in what the task tokenized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        width = 2 if own.whole.get_vocab_size() <= 1 << 16 else 4
        total, held = np.zeros(own.whole.get_vocab_size() + 1, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            if held:
                yield pa.RecordBatch.from_pydict(held)
            ids, counts = own.encode(common.raw(b.column(1)))
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
            ends = width * np.concatenate([[0], np.cumsum(counts)])
            data = ids.astype(f"<u{width}").tobytes()
            runs = [data[a:e] for a, e in zip(ends.tolist(), ends[1:].tolist())]
            marks = np.fromiter(map(xxhash.xxh3_64_intdigest, runs), np.uint64, len(runs)).view(np.int64)
            held = {"doc_id": b.column(0), "mark": marks, "ids": pa.array(runs, pa.binary()), "n_tokens": counts, "counts": pa.nulls(b.num_rows, pa.binary())}
        if held:
            n = len(held["counts"])
            held["counts"] = pa.array([total.astype("<i8").tobytes()] + [None] * (n - 1), pa.binary())
            yield pa.RecordBatch.from_pydict(held)

    common.prepare(docs.sparkSession)
    return common.narrowed(docs, "doc_id", "text").mapInArrow(run, TOKENS)


def unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{len(ids) // n}").astype(np.uint32)


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; bounded by the vocabulary. Reads the tasks' counts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for x in (x for b in batches for x in b.column(0).to_pylist()):
            got = np.array(np.frombuffer(x, "<i8"))
            got[: len(total)] += total[: len(got)]
            total = np.concatenate([got, total[len(got) :]])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]})

    common.prepare(tokens.sparkSession)
    counted = tokens.select("counts").where("counts IS NOT NULL").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def shards_for(n_tokens: int, partitions: int) -> int:
    """Shards of at most about SHARD ids, so they grow in number with the corpus; a small corpus uses the cluster's partitions."""
    return max(1, -(-n_tokens // SHARD), min(partitions, n_tokens >> 18))


def write(tokens: DataFrame, counts: dict[int, int], label: str = "tokens") -> tuple[DataFrame, np.ndarray]:
    """Writes the token files, in ascending order of doc_id; the table of blocks read back, and the frequency table."""
    size = max(counts, default=0) + 1
    dense = np.zeros(size, np.int64)
    for i, n in counts.items():
        dense[i] = n
    freq = quantised(dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, shard = Tables(freq), TaskContext.get().partitionId()
        ids, held, names, block, first = [], 0, [], 0, 0

        def flushed() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids], np.int64)
            data = pack(names, lengths, np.concatenate(ids), t)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first": [first],
                "n_docs": [len(names)], "n_tokens": [held], "data": pa.array([data], pa.binary()),
            })

        for b in batches:
            for name, x, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids.append(unpacked(x, n))
                names.append(name)
                held += len(ids[-1])
                if held >= BLOCK:
                    yield flushed()
                    first, block, ids, names, held = first + held, block + 1, [], [], 0
        if names:
            yield flushed()

    common.prepare(tokens.sparkSession)
    shards = shards_for(sum(counts.values()), int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.select("doc_id", "mark", "ids", "n_tokens").repartitionByRange(shards, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "ids")
    return common.staged(ordered.select("doc_id", "ids", "n_tokens").mapInArrow(run, BLOCKS), label), freq


def read(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32, ids."""
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for s in sorted(totals):
        base[s], total = total, total + totals[s]

    def batch(b: pa.RecordBatch) -> dict:
        t = tables(freq.tobytes())
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        for shard, first, data in zip(*(b.column(i).to_pylist() for i in range(3))):
            block = Block(data, t)
            text, at = block.all().astype("<u4").tobytes(), 0
            for name, n in zip(block.doc_ids, block.lengths.tolist()):
                out["doc_id"].append(name)
                out["start"].append(base[shard] + first + at)
                out["n_tokens"].append(n)
                out["ids_crc32"].append(zlib.crc32(memoryview(text)[4 * at : 4 * (at + n)]))
                at += n
        return {k: pa.array(v, pa.int64()) for k, v in out.items()}

    return common.mapped(blocks.select("shard", "first", "data"), batch, "doc_id long, start long, n_tokens long, ids_crc32 long")


@cache
def tables(freq: bytes) -> Tables:
    return Tables(np.frombuffer(freq, np.uint64))


def output(docs: DataFrame, path: str) -> DataFrame:
    """Encodes, writes and reads back all documents."""
    tokens = common.staged(tokenized(docs, path), "ids")
    blocks, freq = write(tokens, id_counts(tokens))
    common.dropped(tokens)
    return read(blocks, freq)
