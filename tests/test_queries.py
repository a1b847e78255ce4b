"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import collections
import datetime
import math
import re

import duckdb
import numpy as np
import pytest

from lodestrata.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert cols
        return
    r = duck.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_corpus_queries_read_the_corpus(spark, tmp_path):
    """Against brute force over a few documents; there are no other tables."""
    texts = ["theFirst bridge_Of 37 planks\n\nold river stone", "river stone\nthe old bridge\nxy", "ab", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def weight(a, b):
        h = ((ord(a) * 2654435761 + ord(b) * 40503) ^ 0x9E3779B9) & 0xFFFFFFFF
        h = (h ^ (h >> 15)) * 2246822519 & 0xFFFFFFFF
        return float(h ^ (h >> 13)) * (2 if a.islower() and b.isupper() or "_" in (a, b) else 1)

    grams = set()
    for d, t in enumerate(texts):
        for line in t.split("\n"):
            w = [weight(a, b) for a, b in zip(line, line[1:], strict=False)]
            grams |= {(d, line[j : i + 2]) for i in range(len(w)) for j in range(i) if i - j + 2 <= 16 and all(x < min(w[j], w[i]) for x in w[j + 1 : i])}
    assert sorted(map(tuple, QUERIES["sparse_grams"](spark, str(tmp_path)).select("doc_id", "gram").collect())) == sorted(grams)

    tokens = [[["first", "bridge", "planks"], ["old", "river", "stone"]], [["river", "stone"], ["old", "bridge"], ["xy"]], [["ab"]]]
    pairs = collections.Counter()
    for lines in tokens:
        at = [(k, t) for k, line in enumerate(lines) for t in line]
        pairs.update(tuple(sorted((t, u))) for i, (k, t) in enumerate(at) for m, u in at[:i] if t != u and k - m <= 5)
    got = {(r["a"], r["b"]): r["n"] for r in QUERIES["pair_counts_documents"](spark, str(tmp_path)).collect()}
    assert got == pairs
    assert QUERIES["pair_total_documents"](spark, str(tmp_path)).first()["pairs"] == pairs.total()
    assert {r["token"]: r["n"] for r in QUERIES["tokens_documents"](spark, str(tmp_path)).collect()} == collections.Counter(t for x in tokens for line in x for t in line)
    assert QUERIES["line_entropy_documents"](spark, str(tmp_path)).count() == sum(t.count("\n") + 1 for t in texts)


def against_sql(name, spark, tmp_path, texts):
    """The rows of a query over a few documents, which must be those of its SQL."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((tuple(plain(r[x]) for x in df.columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()), key=repr)
    return got


def test_symbol_names_end_at_other_letters(spark, tmp_path):
    assert against_sql("symbol_names", spark, tmp_path, ["The Laciónllo ab\nThe river", "The été"]) == [(0, 1, "Laci"), (0, 2, "river")]


def test_sparse_grams_of_equal_weights_and_long_lines(spark):
    """Equal weights inside end a gram; grams are found across the parts of a long text."""
    from lodestrata.operators import index as I

    rng = np.random.default_rng(1)
    texts = ["aaaa", "abababab\nxy", None, "".join(rng.choice(list("abcAB_\n é"), 500)), "x" * (I.CHUNK - 9) + "".join(rng.choice(list("pqrstuvw"), 40))]

    def weight(a, b):
        h = ((ord(a) * 2654435761 + ord(b) * 40503) ^ 0x9E3779B9) & 0xFFFFFFFF
        h = (h ^ (h >> 15)) * 2246822519 & 0xFFFFFFFF
        return float(h ^ (h >> 13)) * (2 if a.islower() and b.isupper() or "_" in (a, b) else 1)

    want = set()
    for d, t in enumerate(texts):
        for line in (t or "").split("\n"):
            w = [weight(a, b) for a, b in zip(line, line[1:], strict=False)]
            want |= {(d, line[j : i + 2]) for i in range(len(w)) for j in range(max(0, i - 14), i) if all(x < min(w[j], w[i]) for x in w[j + 1 : i])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, I.sparse_grams(docs).collect())) == sorted(want)
    assert sorted(map(tuple, I.sparse_grams(docs.union(docs)).collect())) == sorted(want)
    # one hash for all: contents decide
    codes = np.frombuffer("abcabdabc\nabc".encode("utf-32-le"), dtype=np.uint32)
    doc, start = np.repeat([0, 1], [10, 3]), np.array([0, 3, 6, 10])
    same = np.array([0, 0, 0, 0xA0761D6478BD642F], dtype=np.uint64)  # doc goes into the key
    assert I.distinct_grams(codes, doc, start, np.full(4, 3), same).tolist() == [0, 1, 3]


def test_line_entropy_of_grams_beyond_the_table(spark, tmp_path):
    """Grams that the table doesn't hold are joined; no gram is shuffled where it holds all."""
    from lodestrata.operators import compress as C

    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc é𝄞\n"), 60)) for _ in range(30)] + ["", "\n", "ab\nabc", None]
    want = against_sql("line_entropy_documents", spark, tmp_path, texts)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for table in (0, 5, 10_000):
        assert sorted((tuple(map(plain, r)) for r in C.line_entropy(docs, table).collect()), key=repr) == want
    assert "Exchange hashpartitioning(doc_id" not in C.line_entropy(docs)._jdf.queryExecution().toString()


def test_neighbours_of_one_word_are_those_of_all(spark):
    """Only pairs of the word are counted; names, totals and order are those of the whole table."""
    from lodestrata.operators import cooccur as C

    rng = np.random.default_rng(3)
    words = ["ing", "Oak elm", "elm", "fir", "yew", "ash birch", "", "box ing ing"]
    docs = spark.createDataFrame([(i, "\n".join(rng.choice(words, rng.integers(1, 30)))) for i in range(60)] + [(98, ""), (99, None)], "doc_id long, text string")
    counts = {r["token"]: (r["n"], r["near"], r["pairs"]) for r in C.neighbour_counts(docs, "ing").collect()}
    pairs = {(r["a"], r["b"]): r["n"] for r in C.pair_counts(docs).collect()}
    assert counts.pop(None) == (0, 0, sum(pairs.values()))
    assert {t: n for t, (n, _, _) in counts.items()} == {r["token"]: r["n"] for r in C.token_counts(docs).collect()}
    assert {t: m for t, (_, m, _) in counts.items() if m} == {(set(p) - {"ing"}).pop(): n for p, n in pairs.items() if "ing" in p}
    every = C.ppmi_neighbours(docs)
    for word in ("ing", "Elm", "none"):
        assert C.neighbours_of(docs, word) == C.expansion(every, word)
    assert C.neighbours_of(docs, "ing")


def test_line_entropy_of_rows_of_one_doc_id(spark):
    from lodestrata.operators import compress as C

    docs = spark.createDataFrame([(0, "abcd"), (0, "xbc"), (1, "abc")], "doc_id long, text string")
    mean = round((math.log(3 / 3) + 2 * math.log(3 / 2)) / 3, 6)
    for table in (0, 2, 100):
        assert sorted(tuple(r) for r in C.line_entropy(docs, table).collect()) == [(0, 1, mean), (0, 1, mean), (1, 1, 0.0)]


def test_neighbours_are_counted_by_token(spark, tmp_path, monkeypatch):
    """No pair is joined; few common tokens, small chunks, several blocks and rows of one doc_id give the rows of the SQL."""
    from lodestrata.operators import cooccur as C

    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(6)]
    share = np.arange(30, 0, -1) / np.arange(30, 0, -1).sum()
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(0, 7), p=share)) for _ in range(rng.integers(1, 12))) for _ in range(50)] + ["", None, "rare"]
    spark.createDataFrame([(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.execute(f"SELECT token, nb, score, rank FROM ({ORACLES['ppmi_neighbours_documents']})").fetchall())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert want and "Join" not in C.ppmi_neighbours(docs)._jdf.queryExecution().executedPlan().toString()
    for common, block, chunk in ((1 << 16, 1 << 27, 1 << 19), (9, 1 << 27, 64), (9, 300, 64)):
        monkeypatch.setattr(C, "COMMON", common)
        monkeypatch.setattr(C, "BLOCK", block)
        monkeypatch.setattr(C, "CHUNK", chunk)
        assert sorted(map(tuple, C.ppmi_neighbours(docs).select("token", "nb", "score", "rank").collect())) == want


def test_pairs_are_counted_by_token(spark, tmp_path, monkeypatch):
    """No pair is joined or shuffled; few common tokens, small groups, several blocks, long lines and rows of one doc_id or none give the
    rows of the SQL."""
    from lodestrata.operators import cooccur as C

    rng = np.random.default_rng(5)
    words = [f"{a}{chr(97 + i)}" for a in ("w", "Ü", "𝐚", "\ufb01", "z9") for i in range(8)]
    share = np.arange(40, 0, -1) / np.arange(40, 0, -1).sum()
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(0, 7), p=share)) for _ in range(rng.integers(1, 12))) for _ in range(50)]
    texts += ["", None, "rare", " ".join(rng.choice(words, 300)), "\n\nwa wa Üb\nonce\n\nwa"]
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)] + [(None, "wa wb none"), (None, "wa")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.execute(f"SELECT a, b, n FROM ({ORACLES['pair_counts_documents']})").fetchall())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["pair_counts_documents"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert want and "Join" not in plan and "Exchange" not in plan
    for common, block, chunk, part, work in ((1 << 16, 1 << 25, 1 << 19, 4096, 1 << 31), (1 << 16, 1 << 25, 64, 0, 1 << 31), (9, 1 << 25, 64, 30, 50_000), (9, 300, 64, 200, 50_000), (9, 300, 1 << 19, 1 << 20, 1 << 31)):
        monkeypatch.setattr(C, "COMMON", common)
        monkeypatch.setattr(C, "ROWS_BLOCK", block)
        monkeypatch.setattr(C, "CHUNK", chunk)
        monkeypatch.setattr(C, "PART", part)
        monkeypatch.setattr(C, "ROWS_WORK", work)
        assert sorted(map(tuple, C.pair_counts(docs).collect())) == want
    often = {r["token"] for r in C.token_counts(docs.where("doc_id is not null")).where("n >= 30").collect()}
    assert sorted(map(tuple, C.pair_counts(docs, min_token=30).collect())) == [x for x in want if {*x[:2]} <= often] != want
    assert C.pair_counts(docs.limit(0)).count() == 0


def test_pairs_read_bands_alone(spark, tmp_path, monkeypatch):
    """A task of pairs reads the bands of its tokens and of those near them, not all texts; bands are of bounded size."""
    from lodestrata.operators import cooccur as C

    rng = np.random.default_rng(6)
    texts = ["\n".join(" ".join(rng.choice(list("αβγδεζηθικλμ"), rng.integers(1, 6)) + rng.choice(["", "x", "y"])) for _ in range(8)) for _ in range(30)]
    monkeypatch.setattr(C, "ROWS_BLOCK", 150)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["pair_counts_documents"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    read = [{*map(int, re.findall(r"\d+", x))} for x in re.findall(r"PartitionFilters: \[[^]]*band#\d+ (?:IN|=) ([(\d, )]+)", plan)]
    every = set().union(*read)
    assert len(every) > 3 and max(map(len, read)) < len(every), plan[:3000]
    against_sql("pair_counts_documents", spark, tmp_path / "again", texts)


def test_near_tokens_of_a_band():
    """By one place after another, by each place once, and by sorting, in and above the band of the tokens."""
    from lodestrata.operators import cooccur as C

    rng = np.random.default_rng(7)
    for width, first, part, chunk in ((7, 3, 0, 5), (7, 7, 0, 1 << 19), (40, 0, 10, 64), (5000, 4990, 0, 700), (1 << 17, (1 << 17) - 5, 50, 1 << 19)):
        ids = np.minimum(rng.zipf(1.3, 900), width).astype(np.int32) - 1
        own = np.minimum(rng.zipf(1.2, 700), 30).astype(np.int32) - 1
        low = np.sort(rng.integers(0, 890, 700))
        high = np.minimum(np.maximum.accumulate(low + rng.integers(0, 60, 700)), 900)
        want = collections.Counter((t, x) for t, a, b in zip(own.tolist(), low.tolist(), high.tolist(), strict=True) for x in ids[a:b].tolist() if x < t + first)
        got = [tuple(map(int, r)) for x in C._Near(ids, own, low, high, width, chunk).pairs(first, part) for r in zip(*x, strict=True)]
        assert {(t, x): n for t, x, n in got} == want and len(got) == len(want)
