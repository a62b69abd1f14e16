import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import ans

PATH = public_tokenizers.path("word_bpe_49k.json")


def coded(ids, interval=4):
    ids = np.array(ids, np.uint32)
    t = ans.Tables(ans.quantised(np.bincount(ids, minlength=10)))
    return ids, t, ans.pack([1], np.array([len(ids)]), ids, t, interval)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60_000), min_size=1, max_size=3000))
def test_round_trip(ids):
    ids, t, data = coded(ids)
    block = ans.Block(data, t)
    assert (block.all() == ids).all()
    at = 0
    for i in reversed(range(len(block.points))):
        span = block.lanes * block.interval
        assert (block.part(i) == ids[i * span : (i + 1) * span]).all()
        at += 1


@pytest.mark.parametrize("ids", [[5] * 10_000, [0], list(range(50_000)), np.random.default_rng(1).zipf(1.3, 300_000) % 49_000])
def test_sizes(ids):
    ids, t, data = coded(ids, ans.INTERVAL)
    assert (ans.Block(data, t).all() == ids).all()
    p = np.bincount(ids)[np.unique(ids)] / len(ids)
    entropy = -(p * np.log2(p)).sum() * len(ids) / 8
    assert len(data) < 1.1 * entropy + 30_000


def test_damage_is_found():
    _, t, data = coded(list(range(1000)))
    for at in (10, 500, len(data) - 1):
        with pytest.raises(ValueError, match="checksum"):
            ans.Block(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], t)


def test_frequencies():
    f = ans.quantised(np.array([0, 1, 10**9, 5, 0, 3]))
    assert f.sum() == 1 << ans.SCALE and (f[[1, 3, 5]] >= 1).all() and f[0] == f[4] == 0
    with pytest.raises(ValueError, match="scale"):
        ans.quantised(np.ones(20, int), scale=4)


def test_tokenizer_equals_library():
    texts = [
        "It's 12 o'clock, don't!! we'll 'sup''s", "été ÀÉÑ ß ẞ İ ı ŉ ſ Ǆ", "<|endoftext|>x <|startoftext|> <|", "x́ é  nb sp\x85\x1c", "中文 한국 ★☆ 🙂", "", "\x00 \x7f a\x0bb", "a#b_c-d%%% *** ###",
        "Straße ÆØÅ æøå œ Œ × ÷ ¡¿ ªº", "''''s 't're", "1234 5a6 ½ ² Ⅷ",
    ]
    whole, own = Tokenizer.from_file(PATH), ans.Tokenizer(PATH)
    ids, counts = own.encode([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2], t
        at += n


def test_other_tokenizers_go_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), ["It's  12 o'clock", "", "\n\n été 中文 "]
    ids, counts = ans.Tokenizer(path).encode([t.encode() for t in texts])
    want = [[*whole.encode(t, add_special_tokens=False).ids, ans.END] for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_counts_and_shards(docs):
    tokens = ans.tokenized(docs, PATH)
    found = np.concatenate([ans.unpacked(r["ids"], r["n_tokens"]) for r in tokens.collect()])
    assert ans.id_counts(tokens) == dict(zip(*(x.tolist() for x in np.unique(found, return_counts=True))))
    assert ans.shards_for(0, 8) == ans.shards_for(1000, 8) == 1 and ans.shards_for(1 << 22, 8) == 8
    assert ans.shards_for(10**14, 8) == -(-(10**14) // ans.SHARD)


def test_files(docs, odd, none, corpus):
    whole = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, ans.output(docs, PATH).collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, t, *_ in sorted(corpus, key=lambda r: (r[0], r[1] or "")):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got) == sorted(want)
    rows = ans.output(odd, PATH)
    assert rows.count() == odd.count() and rows.where(F.col("doc_id").isNull()).count() == 2
    assert rows.where(F.col("doc_id").isNull()).agg(F.min("start")).first()[0] == 0
    assert ans.output(none, PATH).count() == 0
