import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import kneser, queries


def brute(texts):
    """log10 p by the textbook formulas, over words."""
    low = "".maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    seqs = [["<s>", "<s>", *((t or "").translate(low)).encode().split(), "</s>"] for t in texts]
    three = Counter(tuple(s[i : i + 3]) for s in seqs for i in range(len(s) - 2))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)

    def discounts(c):
        n1, n2, n3, n4 = (sum(x == k for x in c.values()) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        raw = [k - (k + 1) * y * b / a if a else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return [min(max(x, 0.1), k - 0.05) for k, x in enumerate(raw, 1)]

    d1, d2, d3 = map(discounts, (one, two, three))
    off = lambda n, d: d[min(n, 3) - 1]
    total = sum(one.values())
    unseen = sum(off(n, d1) for n in one.values()) / total / (len(one) + 1)
    ctx2, ctx3 = defaultdict(list), defaultdict(list)
    for (v, _), n in two.items():
        ctx2[v].append(n)
    for (u, v, _), n in three.items():
        ctx3[u, v].append(n)

    def p(u, v, w):
        x = (one[w] - off(one[w], d1)) / total + unseen if w in one else unseen
        for grams, key, ctx, d in ((two, (v, w), ctx2.get(v), d2), (three, (u, v, w), ctx3.get((u, v)), d3)):
            if ctx:
                left = sum(off(n, d) for n in ctx) / sum(ctx)
                x = (max(grams[key] - off(grams[key], d), 0) / sum(ctx) if grams[key] else 0) + left * x
        return x

    return lambda t: sum(math.log10(p(*s)) for q in [["<s>", "<s>", *((t or "").translate(low)).encode().split(), "</s>"]] for s in zip(q, q[1:], q[2:])), p, one


def test_model_equals_formulas(spark, words):
    texts = [words(i % 5, 30) + " the cat sat on the mat" * (i % 3) for i in range(20)] + [None, ""]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    score, p, one = brute(texts)
    model = kneser.Lookup(spark, kneser.fitted(train))
    tests = [*texts, "the cat sat on a hat", "UNKNOWN Words only", "the the the"]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(tests)], "doc_id long, lang string, text string")
    for r in kneser.surprise(df, model).collect():
        assert r.log10_prob == pytest.approx(score(tests[r.doc_id]), rel=1e-4)
    assert sum(p("<s>", "<s>", w) for w in one) + p("<s>", "<s>", "never") == pytest.approx(1)


def test_judged(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{n}.parquet") for n in ("documents", "labels"))
    rows = kneser.judged(docs, labels).join(labels, "doc_id", "left")
    good = rows.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = rows.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert rows.count() == docs.count() and good > 0.95 and junk < 0.5


def test_edge_cases(spark, docs, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, None), (3, 0, 0), (8, 1, 1), (9, 1, 0), (None, 1, 0), (11, None, None)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in kneser.trusted(labels).collect()) == [1, 2, 9]
    for own in (labels, labels.limit(0)):
        for df in (docs, odd, none):
            rows = kneser.judged(df, own).collect()
            assert len(rows) == df.count()
            assert all((r.perplexity is None) == (r.n_words == 0) and (r.n_words or not r.kept) for r in rows)


@pytest.mark.parametrize("hot", [0, 7, 60])
def test_joined_and_sent_entries_give_the_same(spark, words, hot):
    """Whatever share of the table is sent to all tasks, the rest is joined: the same log probabilities, to the last bit."""
    texts = [words(i % 5, 30) + " the cat sat on the mat" * (i % 3) for i in range(20)] + [None, "", "one"]
    df = spark.createDataFrame([(None if i % 7 == 0 else i // 2, "en", t) for i, t in enumerate(texts + ["UNKNOWN words", "the the the cat"])], "doc_id long, lang string, text string")
    train = df.where("text IS NULL OR NOT text LIKE 'UNKNOWN%'")
    whole, some = (sorted(map(repr, kneser.surprise(d, kneser.Lookup(spark, kneser.fitted(train), n)).collect())) for d, n in ((df, None), (df.repartition(3), hot)))
    assert whole == some and len(whole) == df.count()


def test_filter():
    keys = kneser.mixed(np.arange(5000, dtype=np.uint64))
    f = kneser.Filter(keys)
    assert len(f.may_have(keys)) == 5000
    assert len(f.may_have(kneser.mixed(np.arange(10_000, 60_000, dtype=np.uint64)))) < 1000
    assert len(kneser.Filter(keys[:0]).may_have(keys)) == 0


def test_sample_is_bounded_by_size(spark, monkeypatch):
    """Documents are fitted on whole, in order of their hash, up to the bound of bytes."""
    seen = []

    def fitted(fit):
        seen.extend(r.doc_id for r in fit.collect())
        raise StopIteration

    monkeypatch.setattr(kneser, "fitted", fitted)
    monkeypatch.setattr(kneser, "MAX_BYTES", 1000)
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('a b ', 10) AS text", "'en' AS lang")
    with pytest.raises(StopIteration):
        kneser.judged(docs, spark.range(200).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    order = [r.doc_id for r in docs.where("pmod(xxhash64(doc_id), 2) = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(25).collect()]
    assert sorted(seen) == sorted(order)


def test_sample_is_not_cut_below_4000(spark, monkeypatch):
    """More trusted documents than 1,500 on the side of the sample: all up to 4,000 are fitted on."""
    sizes = []

    def fitted(fit):
        sizes.append(fit.count())
        raise StopIteration

    monkeypatch.setattr(kneser, "fitted", fitted)
    docs = spark.range(10_000).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang")
    labels = spark.range(10_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    with pytest.raises(StopIteration):
        kneser.judged(docs, labels)
    assert sizes == [4_000]


def test_query_fits_on_the_whole_fold(spark, monkeypatch, tmp_path):
    """10,000 trusted documents: the query's model sees all of the even fold, not 4,000 of it."""
    sizes = []

    def fitted(fit):
        sizes.append(fit.count())
        raise StopIteration

    monkeypatch.setattr(kneser, "fitted", fitted)
    spark.range(10_000).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(10_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.raises(StopIteration):
        queries.op5_kneser_ney(spark, str(tmp_path))
    assert sizes == [spark.range(10_000).where("pmod(xxhash64(id), 2) = 0").count()]


def test_filter_made_in_tasks_is_the_same(spark):
    df = spark.range(70_000).select(F.xxhash64("id").alias("key")).repartition(3)
    keys = np.array([r.key for r in df.collect()], np.int64).view(np.uint64)
    for own, some in ((keys, df), (keys[:0], df.limit(0))):
        assert (kneser.Filter.of(some).bits == kneser.Filter(own).bits).all()


def test_thresholds_are_exact(spark):
    """Rank ceil(q * n) of each language and of all, over more rows than an approximate quantile of 10,000 holds."""
    rng = np.random.default_rng(5)
    rows = [(["en", "de", None][i % 7 % 3], float(x)) for i, x in enumerate(rng.lognormal(3, 2, 30_000))] + [("fr", 2.5), ("es", None)]
    df = spark.createDataFrame(rows, "lang string, perplexity double").repartition(4)
    got = {(r.lang, r.whole): r.threshold for r in kneser.thresholds(df, 0.995).collect()}
    groups = {(k, False): sorted(x for l, x in rows if l == k and x is not None) for k in ("en", "de", None, "fr")}
    groups[None, True] = sorted(x for _, x in rows if x is not None)
    assert got == {k: xs[math.ceil(0.995 * len(xs)) - 1] for k, xs in groups.items()}


def test_shuffle_files_are_swept(spark):
    """What a staged step shuffles is deleted as soon as the step has run."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = held()
    with kneser.swept(spark):
        out = kneser.fetched(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and out.num_rows == 7


def test_result_can_be_run_twice(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    out = kneser.judged(docs, labels, max_docs=None)
    assert len(out.collect()) == len(out.collect()) == docs.count()


@pytest.mark.parametrize("passes", [1, 3])
def test_parts_of_the_keys_give_the_same(spark, words, passes, monkeypatch):
    df = spark.createDataFrame([(i, "en", words(i % 5, 30) + " the cat sat" * (i % 3)) for i in range(20)], "doc_id long, lang string, text string")
    rows = lambda: sorted(map(repr, kneser.surprise(df, kneser.Lookup(spark, kneser.fitted(df.where("doc_id < 12")), 7)).collect()))
    whole = rows()
    monkeypatch.setattr(kneser, "PASSES", passes)
    monkeypatch.setattr(kneser, "HOT_WORDS", 3)
    assert rows() == whole


def test_frequent_finds_what_halving_finds():
    """Frequent keys are looked up by their highest bits: also where many share them, at both ends, and with none held."""
    rng = np.random.default_rng(3)
    own = np.unique(np.concatenate([kneser.mixed(np.arange(5000, dtype=np.uint64)), np.arange(40, dtype=np.uint64), ~np.arange(40, dtype=np.uint64)]))
    values = rng.integers(-9, 9, len(own))
    asked = np.concatenate([own, kneser.mixed(np.arange(4000, 9000, dtype=np.uint64)), np.arange(80, dtype=np.uint64)])
    for n in (len(own), 1, 0):
        order = rng.permutation(n)
        found = kneser.Frequent(own[:n][order], values[:n][order])
        at, places = found.find(asked)
        expected = {int(k): int(v) for k, v in zip(own[:n], values[:n])}
        assert {int(i): int(found.values[p]) for i, p in zip(at, places)} == {i: expected[int(k)] for i, k in enumerate(asked) if int(k) in expected}


def test_parts_ask_each_key_once():
    """What a pack asks of the parts is together what it asks of one, and no key is hashed for another part than its own."""
    flat, hashed = np.array([0, 1, 0, 2, 3, 3]), kneser.hashes([b"a", b"b", b"c", b"d"])
    row = {"row": 5, **kneser.asked(flat, hashed, np.array([0, 0, 0, 0, 1, 1]), np.array([0, 4]), [np.array([0, 5]), np.array([1, 4]), np.array([0, 3, 5])])}
    pairs = lambda part, parts: sorted(zip(*(x.tolist() for x in kneser.asked_keys(row, part, parts))))
    s, (a, b, c, d) = np.uint64(kneser.START), hashed
    grams = [((a,), 5), ((d,), 6), ((a, b), 5), ((s, d), 6), ((s, s, a), 5), ((b, a, c), 5), ((s, d, d), 6)]
    expected = sorted((int(kneser.key(*(np.array([x], np.uint64) for x in g))[0]), r) for g, r in grams)
    assert pairs(0, 1) == expected == sorted(x for part in range(3) for x in pairs(part, 3))


def test_what_is_sent_is_freed(spark, words):
    """After the documents are scored neither the filter nor packs without p1 are held on disk; a second scoring gives the same."""
    df = spark.createDataFrame([(i, "en", words(i % 5, 30)) for i in range(12)], "doc_id long, lang string, text string")
    model = kneser.Lookup(spark, kneser.fitted(df), 7)
    first = sorted(map(repr, kneser.surprise(df, model).collect()))
    assert model.shared is None
    assert sorted(map(repr, kneser.surprise(df, model).collect())) == first
