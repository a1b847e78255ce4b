from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm.sharding import find_splitters, keyed, shard_by_bytes


def check(df, rows, shards):
    out = df.collect()
    assert len(out) == len(rows)
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in out) == want
    by: dict = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    for s, mine in by.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in mine) == list(range(len(mine)))
    return {s: sum(r["size"] for r in mine) for s, mine in by.items()}


@pytest.mark.parametrize("kind", ["even", "copies", "one"])
def test_balance(spark, kind):
    n = 3000
    text = {"even": lambda i: f"{i} " * (i % 50), "copies": lambda i: "same text" if i % 3 else f"t{i}", "one": lambda i: "all the same"}[kind]
    rows = [(i * 7, text(i)) for i in range(n)]
    df = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 6, slices=3)
    sizes = check(df, rows, 6)
    mean = sum(sizes.values()) / 6
    assert len(sizes) == 6 and max(abs(x - mean) for x in sizes.values()) <= 0.01 * mean + 400


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(shard_by_bytes(odd, 4, slices=2), rows, 4)
    assert shard_by_bytes(none, 4).count() == 0
    two = odd.where("doc_id in (1, 9)").limit(2)
    check(shard_by_bytes(two, 24), [(r["doc_id"], r["text"]) for r in two.collect()], 24)


def test_splitters_are_exact(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text"), F.col("id").cast("string")).alias("text"))
    keys = keyed(df).cache()
    total = keys.agg(F.sum("size")).first()[0]
    rows = sorted((r["k0"], r["k1"], r["size"]) for r in keys.collect())
    for (k0, k1, below, n), t in zip(find_splitters(keys, [total // 4, total // 2], 0, bits=3), [total // 4, total // 2], strict=True):
        mine = [r for r in rows if (r[0], r[1]) < (k0, k1)]
        assert (sum(r[2] for r in mine), len(mine)) == (below, n) and abs(below - t) <= 16
