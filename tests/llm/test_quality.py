import re

from pyspark.sql import functions as F

from millrace.llm import common, quality

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = SPLIT.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, again = set(), set()
    for w in windows:
        (again if w in seen else seen).add(w)
    hit = set()
    for i, w in enumerate(windows):
        if w in again:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_measurements(docs, corpus):
    got = sorted(tuple(r) for r in quality.judged(quality.ledger(docs)).select("doc_id", *quality.MEASURES[:5], "base_failed").collect())
    want = []
    for i, t, *_ in corpus:
        m = brute(t)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(want)


def test_verdicts(docs):
    kept = {r.doc_id: r.kept for r in quality.judged(quality.ledger(docs)).collect()}
    assert kept[1] and kept[2] and kept[8] and kept[10]
    assert not any(kept[i] for i in (4, 5, 6, 7, 12, 15, 16, 17))


def test_ledger_bits_and_ablations(docs):
    rows = quality.ledger(docs).persist()
    bits = [r.fail_bits for r in rows.collect()]
    mask = quality.mask("v1")
    for r in quality.ablations(rows, "v1").collect():
        bit = quality.BIT[r.rule]
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_only == sum(b & mask == bit for b in bits)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)
    assert rows.where(quality.passes("base")).count() == sum(b & quality.mask("base") == 0 for b in bits)


def test_stage_keeps_columns(odd, none):
    kept = quality.kept_documents(odd)
    assert kept.schema == odd.schema
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 2), (False, 3), (False, 8), (False, 9), (True, 0)]
    assert quality.kept_documents(none).count() == 0 and quality.judged(quality.ledger(none)).count() == 0
    assert quality.judged(quality.ledger(odd)).where(F.col("doc_id").isNull()).count() == 2


def test_word_codes():
    texts = ["".encode(), b" \t\n\x0b\x0c\r ", b"one", b" two  one\x0btwo\n", "é\x85x \x1cy".encode(), b""]
    codes, counts, distinct = common.word_codes(texts)
    words, want = common.flat_words(texts)
    assert [distinct[i] for i in codes.tolist()] == words and counts.tolist() == want.tolist()
    codes, counts, distinct = common.word_codes([])
    assert len(codes) == len(counts) == len(distinct) == 0


def test_stored_ledger_is_all_that_policies_read(docs, none):
    rows = quality.stored(docs)
    assert sorted(map(tuple, quality.judged(rows).collect())) == sorted(map(tuple, quality.judged(quality.ledger(docs)).collect()))
    for df in (quality.judged(rows), quality.judged(rows, "base"), quality.ablations(rows, "v1")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "text" not in plan
    assert quality.ablations(quality.ledger(none), "v1").count() == 0
