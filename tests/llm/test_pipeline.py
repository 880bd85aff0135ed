"""The pipeline stage by stage, and its queries, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline as p

    from ledgerframe.llm import decontamination, mixing, ngram_join, sharding, toxicity
    from ledgerframe.llm.storage import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {}
    for name, stage in p.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, DATA), name)
        out[name] = docs
        if name != "sharding":
            assert docs.columns == before.columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(before, model).filter("predicted = 0").collect()}
            assert {r.doc_id for r in docs.collect()} == want and len(want) > 150
        elif name == "ngram_join":
            groups = ngram_join.find_near_duplicates(before).groupBy("class_id").count().count()
            assert docs.count() == groups and ngram_join.find_near_duplicates(docs).filter("n_links > 0").count() == 0
        elif name == "decontamination":
            bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert docs.count() == decontamination.find_contamination(before, bench).filter("n_hit = 0").count() < before.count()
        elif name == "mixing":
            want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == want
        else:
            assert docs.count() == before.count() and docs.filter(F.col("shard_bytes") > sharding.SHARD_BYTES).count() == 0
    last = p.run(spark, DATA)
    key = lambda df: sorted((r.doc_id, r.shard_id) for r in df.collect())
    assert key(last) == key(out["sharding"])


def test_queries_against_sql(spark):
    from ledgerframe.llm import suite

    assert {int(n[2:].split("_")[0]) for n in suite.QUERIES} == set(range(1, 11))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in suite.ORACLES.items():
        df = suite.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        got = sorted(tuple(repr(r[k]) for k in columns) for r in df.collect())
        r = c.sql(sql)
        assert sorted(r.columns) == columns, name
        assert got == sorted(tuple(repr(x[r.columns.index(k)]) for k in columns) for x in r.fetchall()), name
