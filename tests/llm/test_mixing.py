import math
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.queries import QUERIES


def filled(sizes, weights=(1.0, 2.0, 3.0), most=3):
    """Targets by repeated sharing out."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        share = {i: rest * w[i] / sum(w[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        for i in over or open_:
            target[i] = most * sizes[i] if over else share[i]
        open_ -= over or set(open_)
    return target


@pytest.mark.parametrize("sizes", [[10, 20, 30], [100, 1, 1, 500], [0, 5, 0], [0, 0], [7], [1000, 1, 2, 3, 1, 1, 900]])
def test_targets(spark, sizes):
    rows = [(f"s{i:02}" if i < len(sizes) - 1 else None, 1, s) for i, s in enumerate(sizes)]
    got = mixing.targets(spark.createDataFrame(rows, "source string, n_rows long, source_size long")).orderBy(F.col("source").asc_nulls_last()).collect()
    assert [r.target for r in got] == pytest.approx(filled(sizes))


def test_words(spark, corpus):
    df = spark.createDataFrame([(t,) for _, t, *_ in corpus] + [("\x0ba\x0c\rb c d ",)], "t string")
    for r in df.select("t", mixing.n_words(F.col("t")).alias("n")).collect():
        assert r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.t or ""))


def test_mix(spark, docs, odd, none, data):
    for df in (docs, odd):
        rows = mixing.balanced(df).collect()
        assert len(rows) == df.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert mixing.balanced(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    data = data.replace("sf0.001", "sf0.01")
    rows = QUERIES["op7_mixing"](spark, data).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op7_mixing"](spark, data).collect()))
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for s in set(sources.values()):
        own = [r for r in rows if sources[r.doc_id] == s]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)
        assert len({r.rate for r in own}) > 10 and own[0].residual <= mixing.PRECISION


def solved_by_halving(sizes, target, most=3):
    """The multiplier of one source, by halving an interval."""
    mean = sum(sizes) / sum(s > 0 for s in sizes)
    taken = lambda l: sum(s * min(most, math.exp(min(50, l * s / mean))) for s in sizes)  # noqa: E731, E741
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if taken(mid) < target else (low, mid)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_rates_against_brute_force(spark, seed):
    """Multipliers by halving, and whether any document's rate could be changed to a better mix: the tilted rates satisfy
    the conditions of the constrained minimum."""
    r = random.Random(seed)
    own = {f"s{k}": [int(r.lognormvariate(3, 1.3)) for _ in range(r.choice((1, 30, 200)))] for k in range(5)}
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate((s, n) for s, ns in own.items() for n in ns)]
    got = {}
    for x in mixing.balanced(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect():
        got.setdefault(rows[x.doc_id][1], []).append(x)
    want = filled([sum(own[s]) for s in sorted(own)])
    for s, target in zip(sorted(own), want):
        found = got[s]
        assert found[0].target == pytest.approx(target)
        if found[0].multiplier is None:
            assert target == 0 or target == pytest.approx(3 * sum(own[s])) and all(x.copies == 3 for x in found if x["size"])
            continue
        assert sum(x["size"] * x.rate for x in found) == pytest.approx(target, rel=1e-8)
        assert found[0].multiplier == pytest.approx(solved_by_halving(own[s], target), rel=1e-6, abs=1e-9)
        mean = sum(own[s]) / sum(n > 0 for n in own[s])
        assert all(x.rate == pytest.approx(min(3, math.exp(min(50, found[0].multiplier * x["size"] / mean)))) for x in found)
        assert all(0 <= x.copies <= 3 for x in found) and abs(sum(x.taken for x in found) - target) <= max(own[s])


def test_repeated_and_null_ids_keep_their_share(spark):
    """Rows of one id, or none, are mixed as rows of their own: none of their source vanishes."""
    rows = [(None if i % 2 else 7, "a" if i % 5 else "b", f"w{i} " * (1 + i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = {r.source: r.n for r in mixing.balanced(df).join(df.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("source_size")), "source_size").groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = {r.source: r.n for r in mixing.mixed_documents(df).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert got == taken and set(got) == {"a", "b"}


def test_hot_source_is_rounded_in_buckets(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 97 as int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 50)) AS source")
    rows = mixing.balanced(df, bucket_rows=100).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect()
    assert all(abs(r.t - r.x) <= 0.02 * r.x + 5 for r in rows)


def test_native_plan(spark, data):
    plan = QUERIES["op7_mixing"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_stage(odd, docs):
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    taken = {r.doc_id: r.n for r in mixing.balanced(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    times = {r.doc_id: r.n for r in mixing.mixed_documents(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(abs(times.get(i, 0) - n) <= 1 for i, n in taken.items())
