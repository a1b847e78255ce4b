from __future__ import annotations

import corpus_pipeline as C
from pyspark.sql import functions as F

from lodestrata.llm import decontam as D
from lodestrata.llm.neardup import near_duplicates
from lodestrata.llm.pii import find_base

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        if name != C.STAGES[-1][0]:
            assert docs.columns == names and docs.count() > 100
    before, after = seen["near_dedup"]
    kept = {r["doc_id"] for r in near_duplicates(before).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept
    assert near_duplicates(after).where("not kept").count() == 0
    before, after = seen["decontamination"]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    hit = {r["doc_id"] for r in D.contaminated(before, bench).collect()}
    assert hit and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hit
    before, after = seen["pii"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert not find_base(r["text"]) and r["n_chars"] == len(r["text"])
        assert bool(find_base(old[r["doc_id"]])) or r["text"] == old[r["doc_id"]]
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_odd_rows(odd, none, spark):
    for start in (odd, none):
        docs = start
        for _, stage in C.STAGES:
            docs = stage(spark, docs, DATA)
        assert docs.count() >= 0


def test_run(spark):
    assert C.run(spark, DATA).count() > 100
