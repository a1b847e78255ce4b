from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.regexes import is_plain_word, literals, search_pattern, to_java, validate
from lodestrata.operators import index as I
from lodestrata.operators import search as S


@pytest.mark.parametrize("bad", ["", "(?=a)b", "(?<!a)b", r"(a)\1", "(", "["])
def test_rejected(bad):
    with pytest.raises(ValueError):
        validate(bad)


def test_java_meaning(spark):
    rows = [("éa",), ("a\n",), ("x\ry",), ("A",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    hit = lambda p, **k: [r[0] for r in df.where(F.rlike("t", F.lit(to_java(p, **k)))).collect()]
    assert hit(r"\ba") == ["éa", "a\n"]  # word bounds are ASCII
    assert hit(r"\ba\b") == ["éa", "a\n"] and hit(r"\bA\b|x\b") == ["x\ry", "A"] and hit(r"\b(?:a|\W)\b") == ["éa", "a\n", "x\ry"]
    assert hit("a$") == ["éa"]  # not before a final line end
    assert hit("x.y") == ["x\ry"]  # only \n ends a line
    assert hit("^a$", ignore_case=True) == ["A"]


def test_patterns():
    assert search_pattern("a.b", fixed=True) == r"a\.b"
    assert search_pattern("a|b", word=True) == r"\b(?:a|b)\b"
    assert is_plain_word("ab_c-1") and not is_plain_word("a b")
    assert literals("foo(bar|baz)") == ["foobar", "foobaz"]
    assert literals("[a-z]+") is None
    assert literals("abc+defg") == ["defg"]
    assert literals("(abc|x*)") is None


def test_index_equals_scan(spark):
    """Seeded random patterns, with accents, short ones, line ends and ones without a match."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdé \nxyz") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "abc", "日本語 abc"]
    corpus = spark.createDataFrame([(i, f"s/{i}.t", t) for i, t in enumerate(texts)], "doc_id long, path string, text string").cache()
    post = I.postings(corpus).cache()
    folded = I.postings(corpus, folded=True).cache()
    patterns = ["ab", "abc", "é", "日本語", "zzzzzz", "a\nb", "(abc|xyz)", "ab[cd]", "a.*b", "c d"]
    patterns += ["".join(rng.choice("abcdéxyz") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    for p in patterns:
        for case in (False, True):
            o = S.SearchOptions(p, ignore_case=case)
            want = {tuple(r) for r in S.counts(corpus, o).collect()}
            flags = re.ASCII | (re.IGNORECASE if case else 0)
            if p.isascii():
                assert {r[0] for r in want} == {i for i, t in enumerate(texts) if re.search(p, t, flags)}
            assert {tuple(r) for r in I.search(corpus, folded if case else post, o).collect()} == want


def test_position_masks_are_a_superset(spark):
    texts = ["xxabcdef", "abc zz cdef", "abcdef", "defabc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0] for r in I.residual(I.postings(docs), "abcdef").collect()}
    assert {i for i, t in enumerate(texts) if "abcdef" in t} <= got and 3 not in got


def test_publish_and_latest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abcd"), (2, "bcde")], "doc_id long, text string")
    folder = str(tmp_path / "index")
    I.publish(spark, I.postings(docs), folder, 1)
    I.publish(spark, I.postings(docs.where("doc_id = 1")), folder, 2)
    assert {r["doc_id"] for r in I.latest(spark, folder).collect()} == {1}
    assert [I.maintenance(100, 101, 0), I.maintenance(100, 1, 11), I.maintenance(100, 1, 10)] == ["rebuild", "compact", "overlay"]
