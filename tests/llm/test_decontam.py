import math
import random

from millrace.llm import decontam


def brute(index, words):
    """Items that score at least 1, by adding up all postings."""
    score = {}
    for w in set(words):
        if w in index.terms:
            for i, x in zip(index.item[index.term == index.terms[w]].tolist(), index.value[index.term == index.terms[w]].tolist()):
                score[i] = score.get(i, 0) + x
    return {i for i, s in score.items() if s >= 1}


def items(words, n):
    return [(i, f"{words(100 + i, 6 + i % 20)}. {words(200 + i, 3 + i % 9)}.") for i in range(n)]


def test_wand_equals_brute_force(words):
    index = decontam.Index(items(words, 60))
    r = random.Random(1)
    bags = [[w for i in r.sample(range(60), k) for p in index.parts[i] for s in p for w in s if r.random() < 0.9] for k in (1, 1, 2, 3, 5, 0) for _ in range(20)]
    hits = 0
    for bag in bags:
        found = {i for i, _ in index.search(sorted({index.terms[w] for w in bag}))}
        assert found == brute(index, bag)
        hits += len(found)
    assert hits > 50


def test_passages_equal_brute_force(words):
    own = items(words, 30)
    index = decontam.Index(own)
    texts = [decontam.words_of(words(9, 300) + " " + own[3][1] + " " + words(8, 200)), [], decontam.words_of(own[5][1] * 3), decontam.words_of(words(7, 1000))]
    got = {(t, first): {i for i, _ in hits} for t, first, hits in index.passages(texts)}
    want = {}
    for t, text in enumerate(texts):
        for first in range(0, len(text), index.step):
            if found := brute(index, text[first : first + 2 * index.step]):
                want[t, first] = found
    assert got == want


def test_retrieval_loses_nothing(words):
    """Whatever lacks a fifth of the shingles at most is retrieved and verified; less is not reported."""
    index = decontam.Index([(1, f"{words(1, 40)}. {words(2, 20)}.")])
    whole = decontam.words_of(f"{words(1, 40)} {words(2, 20)}")
    for cut in range(0, 14):
        text = whole[cut:]
        share = max(0, 36 - cut) / 36
        assert bool(list(decontam.matches(index, [text]))) == (share >= 0.8 - 1e-9)


def test_leaks(spark, docs, odd, none, words):
    bench = spark.createDataFrame([(1, words(1, 60)), (2, None), (3, ""), (4, "one two three"), (5, words(50, 30)), (6, words(1, 60))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert found == {(d, i) for d in (8, 9, 11) for i in (1, 6)} | {(7, 4)}
    kept = decontam.clean_documents(odd, bench)
    assert kept.schema == odd.schema
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6]
    assert decontam.leaks(none, bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.clean_documents(docs, bench.limit(0)).count() == docs.count()


def test_upper_case_and_punctuation(spark, words):
    text = words(3, 40)
    df = spark.createDataFrame([(1, "Intro. " + text.upper().replace(" ", "!! ") + " end"), (2, "é " + words(4, 300))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()] == [(1, 7)]


def test_index_in_shards(spark, docs, words):
    bench = spark.createDataFrame([(i, words(1, 60) if i % 7 == 0 else words(300 + i, 30)) for i in range(40)], "item_id long, text string")
    old, decontam.SHARD_BYTES = decontam.SHARD_BYTES, 2000
    try:
        assert len(list(decontam.shards(bench, 2000))) > 2
    finally:
        decontam.SHARD_BYTES = old
    found = [m for index in decontam.shards(bench, 2000) for m in decontam.matches(index, [decontam.words_of(words(1, 60))])]
    assert len(found) == 6


def test_results_do_not_depend_on_shards(spark, docs, words, monkeypatch):
    """Scores, places and numbers of passages come from statistics of the whole benchmark."""
    bench = spark.createDataFrame([(i, words(1, 60) if i % 9 == 0 else words(2, 40) if i % 9 == 1 else words(300 + i, 20 + i)) for i in range(60)], "item_id long, text string")
    found = []
    for size in (1 << 20, 4000, 900):
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        monkeypatch.setattr(decontam.shards, "__defaults__", (size,))
        found.append(sorted(tuple(r) for r in decontam.leaks(docs, bench).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 10


def test_scores_are_bm25(words):
    """Impacts against the formula, from the texts."""
    own = items(words, 25)
    index = decontam.Index(own)
    bags = {i: decontam.words_of(t) for i, t in own}
    mean = sum(map(len, bags.values())) / len(bags)
    for i, bag in bags.items():
        score = {}
        for w in set(bag):
            n = sum(w in b for b in bags.values())
            tf = bag.count(w)
            score[w] = math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))
        got = {w: x for w, t in index.terms.items() for j, x in zip(index.item[index.term == t].tolist(), index.value[index.term == t].tolist()) if j == index.items.index(i)}
        ratio = [got[w] / score[w] for w in score]
        assert set(got) == set(score) and max(ratio) - min(ratio) < 1e-6 * max(ratio)
