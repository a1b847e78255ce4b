from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm.components import connected_components
from lodestrata.llm.neardup import keep_one_each, near_duplicates


def brute(rows, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=5):
    """Copies, a star of near copies too far from each other, chains, and a passage that all the rest share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(120)]
    rows, i = [], 0
    for n in range(150):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(0, 5)):
            w[at] = word()
        rows.append(" ".join(w))
    for n in range(60):
        rows.append(" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]))
    for n in range(30):
        w = [word() for _ in range(rng.randint(1, 60))]
        rows += [" ".join(w), " ".join(w).upper(), " ".join(w + [word()])]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, k, percent, region_rows=16).collect()}
    assert got == brute(rows, k, percent)


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(odd, 3, 85).collect()}
    assert {(1, 17, 1, True), (2, 17, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 7, True), (9, 1, 9, True)} <= got
    assert (None, 3, None, True) in got
    assert near_duplicates(odd, 3, 85).count() == odd.count()
    assert near_duplicates(none, 3, 85).count() == 0
    kept = keep_one_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 8, 9)]
    assert kept.where(F.col("doc_id").isNull()).count() == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(7000, 7001), (7001, 7000), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1300)} == {1000} and got[7001] == 7000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def table_sets(path, k):
    import duckdb

    rows = duckdb.execute(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {d: {hash(tuple(w[i : i + k])) for i in range(max(1, len(w) - k + 1))} if (w := words(t)) else set() for d, t in rows}


def links_of(sets, queries, percent):
    """Every link of the given documents, by an index of all shingles."""
    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for a in queries:
        both: dict = {}
        for x in sets[a]:
            for b in holders[x]:
                both[b] = both.get(b, 0) + 1
        for b, n in both.items():
            if b != a and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                yield a, b


def test_components_of_few_links_take_few_jobs(spark):
    """Rounds over many links and one task over few give the same components; few links run no rounds."""
    rng = np.random.default_rng(5)
    for kind, name in (("long", int), ("string", "n{:03}é".format)):
        # a chain, a star, loops, repeated and random links
        links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(7, 7), (3, 4)] + rng.integers(200, 400, (120, 2)).tolist()
        df = spark.createDataFrame([(name(a), name(b)) for a, b in links], f"a {kind}, b {kind}")
        want = {tuple(r) for r in connected_components(df, few=0).collect()}
        assert want == {tuple(r) for r in connected_components(df, few=30).collect()}
        spark.sparkContext.setJobGroup(f"few-{kind}", "")
        got = connected_components(df)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few-{kind}")) <= 8
        assert want == {tuple(r) for r in got.collect()} and min(want) == (name(0), name(0))


@pytest.mark.parametrize(("sf", "every"), [("sf0.01", 1), ("sf0.1", 100)])
def test_components_of_the_test_tables(spark, sf, every):
    """sf0.01: all components against brute force. sf0.1: every link of the documents whose id is divisible by 100 is in one component."""
    sets = table_sets(f"/root/testdata/{sf}", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), 3, 85).collect()}
    assert got.keys() == sets.keys() and all(got[d][0] == len(s) for d, s in sets.items())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = list(links_of(sets, [d for d in sets if d % every == 0], 85))
    assert links and all(got[a][1] == got[b][1] for a, b in links)
    if every == 1:
        for a, b in links:
            x, y = sorted((find(a), find(b)))
            up[y] = x
        assert all(got[d][1] == find(d) for d in sets)
