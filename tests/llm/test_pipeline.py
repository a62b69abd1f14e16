import re

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import mixing, simhash
from millrace.llm.oracles import OP2
from millrace.llm.queries import QUERIES
from tests.llm.test_quality import brute as measured
from tests.llm.test_simhash import brute as fingerprint
from tests.llm.test_simhash import classes


def test_stages(spark, data):
    """Each stage against a brute-force version on its own input."""
    docs, found = spark.read.parquet(f"{data}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).persist()
        found.append((docs, out))
        if stage is not corpus_pipeline.token_output:
            assert out.columns == docs.columns
        docs = out
    rows = lambda df: [r.asDict() for r in df.collect()]

    before, after = map(rows, found[0])
    kept = {r["doc_id"] for r in after}
    for r in before:
        n, _, symbols, _, again = measured(r["text"])
        if n < 20 or 100 * again > 30 * n or 10 * symbols > n:
            assert r["doc_id"] not in kept
    assert len(kept) > len(before) / 2
    # Both ways: SQL's verdicts on the same rows, and each kept row as it was.
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert kept == {i for i, ok in sql.execute(f"SELECT doc_id, kept FROM ({OP2})").fetchall() if ok}
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if r["doc_id"] in kept)
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()

    before, after = map(rows, found[1])
    part = classes([(r["doc_id"], fingerprint(r["text"])) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(part.values()))

    before, after = map(rows, found[2])
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    for r in before:
        line = " ".join(re.findall(r"\w+", r["text"].lower()))
        assert (r["doc_id"] in gone) == any(f" {' '.join(i)} " in f" {line} " for i in items)

    copies = {r.doc_id: r.copies for r in mixing.balanced(found[3][0]).collect() if r.copies}
    after = rows(found[3][1])
    assert copies == {i: sum(r["doc_id"] == i for r in after) for i in {r["doc_id"] for r in after}}

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = sorted(rows(found[4][1]), key=lambda r: r["start"]), 0
    texts = sorted(((r["doc_id"], r["text"]) for r in after))
    for r, (i, t) in zip(out, texts, strict=True):
        n = len(whole.encode(t, add_special_tokens=False).ids) + 1
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, n)
        at += n


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
    assert len(QUERIES) == 10 and sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
    assert simhash.BLOCKS - simhash.DISTANCE >= 1


def test_empty(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
