import random
import re

import xxhash
from pyspark.sql import functions as F

from millrace.llm import components, simhash
from millrace.llm.queries import QUERIES


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=4):
    """(id, fingerprint) -> smallest id reachable."""
    found = {}
    todo = sorted(prints)
    while todo:
        own, todo = [todo[0]], todo[1:]
        for p in own:
            near = [q for q in todo if bin(p[1] ^ q[1]).count("1") <= distance]
            own += near
            todo = [q for q in todo if q not in near]
        for i, _ in own:
            found[i] = own[0][0]
    return found


def test_against_brute_force(spark, docs, corpus):
    got = {(r.doc_id, r.bits & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, brute(t)) for i, t, *_ in corpus]
    want = classes(prints)
    assert got == {(i, p, want[i]) for i, p in prints}


def test_links_are_complete(spark):
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for p in prints for _ in range(3)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in set(signed)], "bits long")
    for distance, blocks in ((4, 7), (3, 5), (4, 5)):
        got = sorted((x.u, x.v) for x in simhash.links(df, distance, blocks).collect())
        want = sorted((a, b) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= distance)
        assert got == want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4050)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {(x.node, x.component) for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {(n, find(n)) for n in root if n not in loops}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edge_cases(docs, odd, none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(odd).count() == odd.count()
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()) == [1, 4, 7, 8, 9]
    assert kept.where(F.col("doc_id").isNull()).count() == 2
    assert simhash.one_of_each(none).count() == 0
    ids = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert len(ids) == len(set(ids)) and -5 in ids and 1 not in ids


def test_query_columns(spark, data):
    df = QUERIES["op4_simhash"](spark, data)
    assert df.dtypes[:3] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in df.collect())


def test_repeated_ids_keep_each_text(spark, words):
    """Rows (0, A), (1, B), (1, A): A stays with 0 and B with 1, in every order of the rows; whole repeats stay once."""
    a, b, c = (words(k, 50) for k in range(3))
    rows = [(0, a, "x"), (1, b, "x"), (1, a, "x"), (2, c, "x"), (2, c, "x"), (2, c, "y"), (3, b + " more", "x")]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        for parts in (1, 4):
            df = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(parts)
            got = sorted((r.doc_id, r.text) for r in simhash.one_of_each(df).collect())
            assert got[:3] == sorted([(0, a), (1, b), (2, c)])
            assert len(got) == 3 + (bin(simhash.fingerprint(b.encode()) ^ simhash.fingerprint((b + " more").encode())).count("1") > 4)


def test_exploded_rows_are_not_broadcast(spark):
    """35 keys a fingerprint and 32 salts a class escape Spark's estimate of sizes; broadcast, they fill the driver."""
    prints = spark.range(1000).select(F.xxhash64("id").alias("bits"), F.col("id").alias("low"), (F.col("id") % 7).alias("class"))
    for df in (simhash.links(prints.select("bits")), simhash.with_class(prints, prints.groupBy("class").agg(F.min("low").alias("component_id")))):
        df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode" in plan or "Generate posexplode" in plan
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
