import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import anchors, exchange, sufarr
from millrace.llm.lyndon import grouped, suffix_array


def kept_words(corpus, width=13):
    first = {}
    for i, t, *_ in corpus:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            s = b" ".join(w[k : k + width])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t, *_ in corpus:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[b" ".join(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def kept_bytes(corpus, width=50):
    first = {}
    for i, t, *_ in corpus:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(first.get(b[k : k + width], i), i)
    out = []
    for i, t, *_ in corpus:
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_words_against_brute_force(docs, corpus, chunk):
    got = anchors.deduplicated(docs, chunk_bytes=chunk).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == kept_words(corpus)


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_bytes_against_brute_force(docs, corpus, chunk):
    got = sufarr.deduplicated(docs, chunk_bytes=chunk).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == kept_bytes(corpus)


def test_dense_repeats(spark):
    """Few words, so that nearly everything repeats, overlaps and ties."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for i in range(60)] + [(60, "a " * 500), (61, "ab" * 300), (62, "ab" * 300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = anchors.deduplicated(df, chunk_bytes=700).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == kept_words(rows)
    got = sufarr.deduplicated(df, chunk_bytes=700).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == kept_bytes(rows)


def test_anchors_in_batches(spark, corpus, monkeypatch):
    """Few anchors at a time give the same: run in this process, without executors."""
    import pyarrow as pa

    r = random.Random(1)
    side = lambda n: bytes(r.choice(b"\x00b" if r.random() < 0.08 else b"\x00") for _ in range(n))
    middles = [bytes(r.choice(b"cdef") for _ in range(20)) for _ in range(3)]  # anchors; every string holds its own
    places, keys = [r.choice((30, 30, 25, 22)) for _ in range(80)], [r.randrange(3) for _ in range(80)]
    texts = [side(p) + middles[k] + side(r.choice((20, 30, 28))) for p, k in zip(places, keys)]
    for i in range(1, 80, 2):  # documents have two segments each; some repeat what is near the anchor, with less before it
        if r.random() < 0.6:
            cut = r.randint(0, 8)
            keys[i], places[i], texts[i] = keys[i - 1], places[i - 1] - cut, texts[i - 1][cut:]
    table = lambda own: pa.Table.from_pylist([{"bucket": 0, "chunk": 5, **{n: sufarr.zlib.compress(x) for n, x in (
        ("docs", np.array([i // 2 for i in own], "<i8").tobytes()), ("keys", np.array([keys[i] for i in own], "<u4").tobytes()),
        ("sizes", np.array([len(texts[i]) for i in own], "<u2").tobytes()), ("places", np.array([places[i] for i in own], "u1").tobytes()),
        ("data", b"".join(texts[i] for i in own)))}}], sufarr.SEGMENTS_ARROW)
    found = []
    for batch in (1, 200, 1 << 20):
        monkeypatch.setattr(sufarr, "BATCH", batch)
        masks = sufarr.sorted_out((pa.scalar(0),), table(range(80)))["masks"][0].as_py()
        found.append(np.frombuffer(sufarr.zlib.decompress(masks), "<u4").tolist())
    for k in range(3):
        own = [i for i in range(80) if keys[i] == k]
        for i in own:
            want = sum(1 << t for t in range(len(texts[i]) - 49) if any(texts[i][t : t + 50] in texts[j] for j in own if j // 2 < i // 2))
            assert found[0][i] == want
    assert found[0] == found[1] and all(a | b == b for a, b in zip(found[0], found[2]))


def test_equal_parts_of_one_document(spark, words):
    """A document that has a repeated passage twice, with other bytes before and behind it each time, among others that have it."""
    r = random.Random(2)
    passage = [words(900 + k, 14) for k in range(4)]
    rows = []
    for i in range(60):
        parts = [x for k in range(4) for x in (words(1000 + 10 * i + k, r.randint(1, 9)), r.choice(passage)[r.randint(0, 12) :][: r.choice((52, 55, 60, 75))])]
        rows.append((i, " ".join(parts)))
    got = sufarr.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == kept_bytes(rows)


def test_edge_cases(odd, none):
    for f in (anchors.deduplicated, sufarr.deduplicated):
        assert f(none).count() == 0
        got = f(odd)
        assert got.count() == odd.count()
        assert [r.n_removed for r in got.where(F.col("doc_id").isNull()).collect()] == [0, 0]
        assert got.where("doc_id = 1").first().n_removed == 0


def test_suffix_arrays():
    r = random.Random(3)
    cases = [[r.randint(0, a) for _ in range(n)] for n in (0, 1, 2, 3, 10, 50, 200) for a in (0, 1, 2, 5, 255) for _ in range(15)]
    cases += [list(b"abracadabra" * 30), list(b"a" * 300), list(b"ab" * 150), list(bytes(range(256)))]
    for s in cases:
        assert list(suffix_array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_groups_are_by_lyndon_prefix():
    def lyndon_prefix(s):
        return max((s[:k] for k in range(1, len(s) + 1) if all(s[:k] < s[j:k] for j in range(1, k))), key=len)

    r = random.Random(5)
    for _ in range(200):
        s = [r.randint(0, 2) for _ in range(r.randint(1, 25))]
        groups, _ = grouped(s)
        prefixes = [{tuple(lyndon_prefix(s[i:])) for i in g} for g in groups]
        assert all(len(p) == 1 for p in prefixes)
        assert [next(iter(p)) for p in prefixes] == sorted(next(iter(p)) for p in prefixes)


def test_every_string_has_an_anchor():
    """Equal strings have an anchor at the same place, wherever they stand; long texts are cut without loss."""
    r = np.random.default_rng(2)
    for n, top in ((50, 256), (300, 3), (5000, 2), (400, 1)):
        text = r.integers(0, top, n).astype(np.uint8)
        at, _, first, last = sufarr.anchors_of(text)
        assert first[0] == 0 and last[-1] == n - 50 and (first[1:] == last[:-1] + 1).all() and (last - first <= 30).all()
        for i in range(n - 49):
            own = sufarr.anchors_of(text[i : i + 50])[0]
            assert len(own) == 1 and at[np.searchsorted(last, i)] == i + own[0]
    rows = exchange.Rows(0, np.array([1]), np.array([True]), [r.integers(97, 123, 3000).astype(np.uint8).tobytes()])
    whole = sufarr.Anchors(rows).at.tolist()
    old, sufarr.PIECE = sufarr.PIECE, 100
    try:
        cut = sufarr.Anchors(rows)
        assert set(cut.at.tolist()) == set(whole) and (np.diff(cut.start) > 0).all() and cut.end[-1] == 3000
    finally:
        sufarr.PIECE = old


def test_rolled():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 40).astype(np.uint64)
    for width in (1, 2, 3, 7, 13, 20, 40, 41):
        got = exchange.rolled(x, width, 0x9E3779B97F4A7C15)
        want = []
        for i in range(40 - width + 1):
            h = 0
            for k in range(width):
                h = (h * 0x9E3779B97F4A7C15 + int(x[i + k])) % (1 << 64)
            want.append(h)
        assert got.tolist() == exchange.mixed(np.array(want, np.uint64)).tolist()


def test_rows_without_an_id_are_spread(spark):
    """A third of the rows without an id, and a third of one id: no chunk holds them all."""
    df = spark.range(900).selectExpr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE id END AS doc_id", "concat('text ', id) AS text")
    rows, n = exchange.chunked(df, 3000)
    sizes = [r["count"] for r in rows.groupBy("chunk").count().collect()]
    assert n > 20 and len(sizes) > n / 2 and max(sizes) < 900 / n * 3
