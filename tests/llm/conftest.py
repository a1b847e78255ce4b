from __future__ import annotations

import pytest

#: Nulls, empty and wordless texts, repeated rows, ties, a long text without breaks, other scripts.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the wood", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the wood", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \n\t ", "en", "a"),
    (6, "x" * 50_000, "en", "a"),
    (7, "ab " * 20_000, "en", None),
    (8, "日本語のテキスト 🙂 é", None, "b"),
    (1, "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the wood", "en", "a"),
    (None, "a row without an id", "en", "a"),
    (9, "one", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every odd kind, with extra columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, sig string, region int, found string, component_id int, size string, score string, target string, length int, h int, gram int"
    rows = [(i, t, lang, s, len(t) if t else None, "x", 1, "y", 2, "z", "w", "v", 3, 4, 5) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
