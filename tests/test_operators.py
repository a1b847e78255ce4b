from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import compress as C
from lodestrata.operators import cooccur as K
from lodestrata.operators import filters as FI
from lodestrata.operators import housekeeping as H
from lodestrata.operators import lines as L
from lodestrata.operators import search as S
from lodestrata.operators import symbols as Y
from lodestrata.operators import usage as U
from lodestrata.sources import tables as T
from lodestrata.streaming import watch as W


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def lines(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return L.split_lines(docs, keep_final=False)


def test_line_flavours(spark):
    docs = spark.createDataFrame([(0, "a\r\nb\n"), (1, ""), (2, "\n"), (3, None)], "doc_id long, text string")
    assert rows(L.split_lines(docs), "doc_id", "line_no") == [(0, 1, "a\r"), (0, 2, "b"), (0, 3, ""), (1, 1, ""), (2, 1, ""), (2, 2, "")]
    assert rows(L.split_lines(docs, keep_final=False), "doc_id", "line_no") == [(0, 1, "a"), (0, 2, "b"), (2, 1, "")]
    assert rows(L.line_offsets(docs), "doc_id", "line_no") == [(0, 1, 0), (0, 2, 3), (2, 1, 0)]


def test_runs_and_caps(spark):
    x = lines(spark, "a\na\na\nb\n\n\nb\nb")
    assert [r[2] for r in rows(L.dedup_consecutive(x), "line_no")] == ["a  (×3)", "b", "  (×2)", "b  (×2)"]
    assert [r[2] for r in rows(L.collapse_blank(x), "line_no")] == ["a", "a", "a", "b", "", "b", "b"]
    y = lines(spark, "\n".join(map(str, range(1, 11))))
    assert [r[2] for r in rows(L.cap(y, 5), "line_no")] == ["1", "2", "3", "… (5 lines omitted)", "9", "10"]
    assert [r[2] for r in rows(L.head(y, 2), "line_no")] == ["1", "2", "… (8 lines omitted)"]
    assert [r[2] for r in rows(L.tail(y, 9), "line_no")] == ["… (1 lines omitted)", *map(str, range(2, 11))]
    assert len(rows(L.cap(y, 10), "line_no")) == 10
    e = lines(spark, "fine\nError: x\nok", "fine")
    assert rows(L.errors_only(e), "doc_id") == [(0, 2, "Error: x"), (1, 1, "[ok] No errors")]


def test_filters(spark):
    toml = '[[filters]]\nname = "t"\nmatch = "^x"\nstrip_ansi = true\nkeep_lines = "keep"\non_empty = "none"\nreplace = [{ find = "a+", with = "b" }]\n'
    (spec,) = FI.from_toml(toml)
    out = spec.apply(lines(spark, "\x1b[31mkeep aaa\x1b[0m\ndrop", "drop"))
    assert rows(out, "doc_id") == [(0, 1, "keep b"), (1, 1, "none")]
    with pytest.raises(ValueError):
        FI.FilterSpec("both", "x", keep_lines="a", drop_lines="b")
    r = FI.Registry(user=[spec])
    assert r.find("xpytest").name == "t" and r.find("/usr/bin/pytest -q").name == "unit-tests" and r.find("echo") is None


def test_tokens(spark):
    cases = {"handleSubmit": ["handle", "submit"], "HTTPRequest": ["http", "request"], "get_user_by_id": ["get", "user", "id"], "AParser": ["aparser"], "u00e9lan 123 x": [], "data-testid": ["data", "testid"]}
    for text, want in cases.items():
        assert spark.range(1).select(K.tokens_of(F.lit(text))).first()[0] == want


def test_search_context_and_json(spark):
    c = spark.createDataFrame([(1, "a/1.x", "one\ntwo hit\nthree\nfour"), (2, "b/2.x", "\0hit")], "doc_id long, path string, text string")
    got = rows(S.with_context(c, S.SearchOptions("hit", context=1)), "line_no")
    assert got == [(1, 1, "one", True), (1, 2, "two hit", False), (1, 3, "three", True)]  # the binary one is skipped
    assert S.json_lines(S.lines(c, S.SearchOptions("hit"))).first()[0] == '{"file":"a/1.x","line":2,"text":"two hit"}'


def test_walk(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src").mkdir()
    for name, data in {"src/a.rs": b"fn main", "src/b.bin": b"x\0y", "node_modules/c.js": b"x", "big.txt": b"y" * 50}.items():
        (tmp_path / name).write_bytes(data)
    got = [r["path"].rsplit("/", 1)[1] for r in T.walk(spark, str(tmp_path), max_size=49).collect()]
    assert got == ["a.rs"]


def test_budget_and_weights(spark):
    scored = spark.createDataFrame([(1, 1, "aaaa", 1.0), (1, 2, "bbbb", 0.2), (1, 3, "cccc", 0.5)], "doc_id long, line_no int, line string, score double")
    assert [r[1] for r in rows(C.budget_fit(scored, 9), "line_no")] == [1, 2, 3]
    assert [r[1] for r in rows(C.budget_fit(scored, 8), "line_no")] == [1, 3]
    assert [r[1] for r in rows(C.budget_fit(scored, 3), "line_no")] == [1]
    assert rows(C.budget_fit(scored, 0), "line_no") == []
    cases = {"pub fn main() {": 1.0, "x->y(": 0.8, "if a {": 0.5, "a = b": 0.3, "a == b": 0.5, "});": 0.1, "": 0.0, "plain": 0.5}
    for text, want in cases.items():
        assert spark.range(1).select(C.line_weight(F.lit(text))).first()[0] == want, text
    out = C.aggressive("// c\nfn f() {\n  body();\n}\nstruct S {\n  a: u8,\n}\n", "rs")
    assert [t for _, t in out] == ["fn f() {", "}", "struct S {", "  a: u8,", "}"]
    assert [t for _, t in C.aggressive("# c\ndef f():\n    x = 1\n\ny = 2\n", "py")] == ["def f():", "y = 2"]


def test_history_files(spark, tmp_path):
    p = str(tmp_path / "h")
    h = spark.sql("SELECT TIMESTAMP'2024-12-30 00:00:00' AS ts, 'ls' AS cmd, 100L AS in_bytes, 30L AS out_bytes, 'p' AS project UNION ALL SELECT TIMESTAMP'2024-12-31 00:00:00', 'cat', 5L, 9L, 'p'")
    U.append_history(h, p)
    (tmp_path / "h" / "bad.json").write_text('not json\n{"cmd":"x"}\n')
    got = rows(U.read_history(spark, p).select("cmd", "in_bytes", "saved"), "cmd")
    assert got == [("cat", 5, 0), ("ls", 100, 70), ("x", 0, 0)]
    assert rows(U.bucketed(U.read_history(spark, p).where("cmd <> 'x'"), "week").select("bucket", "n"), "bucket") == [("2025-W01", 2)]


def test_commands_and_json(spark):
    c = {"sudo rm -rf /": "deny", "git push": "ask", "cat a": "rewrite", "cat a | wc": "passthrough", "/bin/ls": "rewrite", "A=1 B=2 grep x": "rewrite", "make": "passthrough"}
    for text, want in c.items():
        assert spark.range(1).select(H.classify_command(F.lit(text))).first()[0] == want, text
    j = spark.createDataFrame([(1, '{"a":[1,2],"b":{"c":null},"d":1.5,"e":[]}'), (2, "{"), (3, None)], "id long, value string")
    assert rows(H.json_schema(j), "id") == [(1, '{"a":["int","(2)"],"b":{"c":"null"},"d":"float","e":"[] (0)"}'), (2, None), (3, None)]
    d = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "", None)], "id long, old string, new string")
    assert [(r[2], r[3]) for r in rows(H.line_diff(d), "pos")] == [("same", "a"), ("removed", "b"), ("added", "x"), ("same", "c"), ("added", "d")]


def test_cosine_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert rows(Y.cosine_topk(v, v.where("vec_id = 1").select(F.col("embedding").alias("q")), 2), "vec_id") == [(1, 1.0), (3, 1.0)]


def test_content_stream_equals_batch(spark, tmp_path):
    data = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (1, 5, None), (1, 6, "a"), (2, 7, "a")]
    df = spark.createDataFrame(data, "key long, seq long, content string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = W.changed_content_stream(stream, "key", "content").writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(r["seq"] for r in spark.table("changes").collect())
    assert got == [1, 3, 4, 5, 6, 7]
    assert got == sorted(r["seq"] for r in W.changed_content(df, "key", F.col("content"), ["seq"]).collect())


def test_window_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = {tuple(r) for r in W.tumbling(W.instants(e), "event_type").collect()}
    s = W.event_stream(spark, "/root/testdata/sf0.001", e.schema, "events.parquet")
    q = W.tumbling(s, "event_type", late="1 hour").writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("days").collect()} == want


def test_holds(spark):
    e = spark.createDataFrame([("k", 1, 1, "begin", None), ("k", 2, 2, "change", "p"), ("k", 3, 3, "change", "p"), ("k", 4, 4, "end", None), ("k", 5, 5, "change", "q"), ("k", 6, 6, "begin", None), ("k", 7, 7, "change", "r")], "key string, ts int, seq int, kind string, path string")
    assert rows(W.held(e), "path") == [("k", "p", 4), ("k", "q", 5), ("k", "r", None)]


def test_built_in_filters():
    names = [f.name for f in FI.BUILT_IN]
    assert len(names) == len(set(names)) >= 70
    r = FI.Registry()
    found = {c: r.find(c).name for c in ("cargo audit", "uv sync", "kubectl apply -f x", "aws s3 cp a b", "env", "terraform init", "git fetch")}
    assert found["cargo audit"] == "cargo-audit" and found["uv sync"] == "uv" and found["git fetch"] == "git-sync" and found["env"] == "environment"


def test_nearest_of_every_query(spark):
    """In one block or many, against brute force; equal scores go by id, rows without a vector are left out."""
    from lodestrata.operators.symbols import nearest

    vectors = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(700)] + [(700, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    queries = df.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(q, v, r) for q, e in vectors[:700:100] for r, (_, v) in enumerate(sorted((-dot(e, x), i) for i, x in vectors[:700])[:10], 1)}
    for block in (2048, 2):
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in nearest(df, queries, block=block).collect()} == want
    assert nearest(df, queries.where("false")).count() == 0 and nearest(df.where("false"), queries).count() == 0


def test_lines_of_whole_content_matches(spark):
    """Matches are those of the whole text: against Python's, for anchors, flags, empty matches and matches across lines."""
    import re

    texts = ["hello\nhello x\nhello", "x\nhello", "", "\n", "é\nxéx hello\n", "a\n\nb\n", "hello", "\ufdd0 hello \ufdd1\nhello"]
    c = spark.createDataFrame([(i, f"p/{i}.x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    for pattern in ("^hello", "hello$", "x\\nhello", "(?m)^hello", "(?m)hello$", "l+", "x*", "o\\s+h", "[^a]l", "(?s)x.h", "\\bhello\\b", "e.l", "(?i)HELLO$"):
        o = S.SearchOptions(pattern)
        want, places = {}, set()
        for i, t in enumerate(texts):
            for m in re.finditer(re.sub(r"(?<![\\(])\$$", lambda _: r"\Z" if not pattern.startswith("(?m)") else "$", pattern), t):
                line = t.count("\n", 0, m.start()) + 1
                at = t.rfind("\n", 0, m.start()) + 1
                want[i, line] = want.get((i, line), 0) + 1
                places.add((i, line, want[i, line], m.start() - at, m.end() - at))
        got = {(r["doc_id"], r["line_no"]): r["n_ranges"] for r in S.lines(c, o).collect()}
        assert got == want, pattern
        assert {tuple(r) for r in S.ranges(c, o).collect()} == places, pattern
        assert {(r["doc_id"], r["line_no"]) for r in S.with_context(c, o).where("not is_context").collect()} == set(want), pattern
        totals = {}
        for (i, _), n in want.items():
            totals[i] = totals.get(i, 0) + n
        assert {r["doc_id"]: r["match_count"] for r in S.counts(c, o).collect()} == totals, pattern


def test_content_stream_over_micro_batches(spark, tmp_path):
    """State holds from one micro-batch to the next, for hashes of either sign."""
    texts = [f"text {i}" for i in range(30)]
    rows = [(k, b * 10 + j, t) for b in range(3) for k, t in enumerate(texts) for j in range(1 if k % 3 else 2)]
    rows += [(100, 1, "a"), (100, 11, None), (100, 21, "a"), (101, 1, "a"), (101, 11, "b"), (101, 21, "a")]
    df = spark.createDataFrame(rows, "key long, seq long, content string")
    for b in range(3):
        df.where(f"seq div 10 = {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = W.changed_content_stream(stream, "key", "content").writeStream.format("memory").queryName("three").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    got = sorted((r["key"], r["seq"]) for r in spark.table("three").collect())
    assert got == sorted((r["key"], r["seq"]) for r in W.changed_content(df, "key", F.col("content"), ["seq"]).collect())
    assert len(got) == 36


def test_index_and_scan_agree(spark, tmp_path):
    """Random patterns with flags, classes, alternatives and repeats, on folded and plain postings: the rows of the plain scan."""
    import random

    from lodestrata import api
    from lodestrata.functions.regexes import validate
    from lodestrata.operators import index as I

    rng = random.Random(31)
    words = ["hello", "Hello", "HELLO world", "the_end", "naïve", "x1y2", "Foo.bar", "a-b", "tion"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    c = spark.createDataFrame([(i, f"p/{i}.x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string").cache()
    plain, folded = I.postings(c).cache(), I.postings(c, folded=True)
    I.publish(spark, folded, str(tmp_path / "index"), 1)
    folded = I.latest(spark, str(tmp_path / "index")).cache()
    assert I.is_folded(folded) and not I.is_folded(plain) and I.is_folded(I.overlay(folded, folded.where("false"), c.where("false")))
    parts = ["hello", "Hel", "end", "tion", "[Hh]el", "(foo|Foo)", "naï", "wor?ld", "l{2}", "(?:the)+", "\\w+", ".", "o\\.b", "[^x]", "_", " ", "(?i:HEL)lo", "\\bhello", "end$", "^the", "x*", "[[:alpha:]]lo", "\\\\b"]
    fixed = ["(?i)hello", "(?i)WORLD", "(?im)^hello", "(?s)hello.HELLO", "(?x) hel lo", "hello(?i)WORLD", "a-b", "Foo\\.bar|TION", "[h-i&&[h]]ello", "(?i)naÏve"]
    patterns = fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(90)]
    tried = pruned = 0
    for p in patterns:
        for ignore in (False, True) if rng.random() < 0.3 else (rng.random() < 0.5,):
            try:
                validate(p)
                o = S.SearchOptions(p, ignore_case=ignore)
                want = None
                for postings in (plain, folded):
                    plan = I.plan(p, ignore, folded=I.is_folded(postings))
                    if plan.alternatives is None:
                        continue
                    if want is None:
                        want = {r["doc_id"] for r in S.files(c, o).collect()}
                    left = {r["doc_id"] for r in I.candidates(postings, plan).collect()}
                    if plan.literals:
                        fewer = {r["doc_id"] for r in I.masked(postings, plan).collect()}
                        assert fewer <= left, (p, ignore)
                        left = fewer
                    pruned += 1
                    assert want <= left, (p, ignore)
                tried += 1
            except ValueError:
                continue
    assert tried > 40 and pruned > 40
    for p in ("(?i)hello", "HELLO"):
        for ignore in (False, True):
            scan = sorted(map(tuple, api.search(c, S.SearchOptions(p, ignore_case=ignore), "count").collect()))
            for postings in (plain, folded):
                assert sorted(map(tuple, api.search(c, S.SearchOptions(p, ignore_case=ignore), "count", postings=postings).collect())) == scan


def test_blocks_against_brute_force(spark):
    import random

    rng = random.Random(8)
    texts = ["\n".join(rng.choice(["{", "}", "{ {", "} }", "x", "} {", "{ }"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    x = lines(spark, *texts)
    starts = x.select("doc_id", "line_no")
    want, blocks = set(), {}
    for d, t in enumerate(texts):
        depth, depths = 0, [0]
        for line in t.split("\n"):
            depth += line.count("{") - line.count("}")
            depths.append(depth)
        for i in range(1, len(depths)):
            if depths[i] > depths[i - 1]:
                end = next((j for j in range(i, len(depths)) if depths[j] <= depths[i - 1]), None)
                want.add((d, i, end))
                blocks.setdefault(d, []).append((i, end))
    ends = Y.block_ends(x, starts).cache()
    assert {tuple(r) for r in ends.collect()} == want
    got = {(r["doc_id"], r["target"]): (r["start"], r["end"]) for r in Y.enclosing(ends, starts).collect()}
    for d, t in enumerate(texts):
        for line in range(1, t.count("\n") + 2):
            inside = [b for b in blocks.get(d, []) if b[1] is not None and b[0] <= line <= b[1]]
            assert got[d, line] == (max(inside) if inside else (max(1, line - 20), line + 20))


def test_pairs_of_long_lines(spark, monkeypatch):
    """Lines dealt to several tasks give the counts of lines that are not."""
    import random

    rng = random.Random(3)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet"]
    docs = spark.createDataFrame([(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(9))) for i in range(6)], "doc_id long, text string")
    want = {tuple(r) for r in K.pair_counts(docs).collect()}
    monkeypatch.setattr(K, "PART", 3)
    assert {tuple(r) for r in K.pair_counts(docs).collect()} == want and want


def test_walk_honours_ignore_files(spark, tmp_path):
    root = tmp_path / "w"
    files = {
        ".git/config": "", ".git/info/exclude": "private.txt\n", ".gitignore": "*.log\n!keep.log\n/out/\ndoc/**/draft\n# x\n\nb[0-9].txt\nsub/only.txt\n", "a.txt": "a", "x.log": "x", "keep.log": "k",
        "out/a.txt": "x", "sub/out/a.txt": "y", "doc/one/two/draft/z.txt": "x", "doc/final.txt": "f", "b1.txt": "x", "bx.txt": "b", ".hidden/a.txt": "x", ".env": "x", "__init__.py": "i",
        "sub/.gitignore": "!x.log\nlocal*\n", "sub/x.log": "s", "sub/local1": "x", "sub/only.txt": "x", "private.txt": "x", "node_modules/m.js": "x", "naïve.txt": "é",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    want = ["__init__.py", "a.txt", "bx.txt", "doc/final.txt", "keep.log", "naïve.txt", "sub/out/a.txt", "sub/x.log"]
    got = T.walk(spark, str(root)).collect()
    assert [r["path"] for r in got] == want and {r["path"]: r["text"] for r in got}["naïve.txt"] == "é"
    assert [r["path"] for r in T.walk(spark, str(root / "a.txt")).collect()] == ["a.txt"]
    (root / "Cargo.toml").write_text("")
    (root / "sub" / "go.mod").write_text("")
    assert T.find_root(str(root / "sub" / "out"), home=str(tmp_path)) == str(root)
    assert T.find_root(str(root / "sub"), home=str(root)) == str(root / "sub")


def test_manifests(spark):
    files = [
        ("a/Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["full"] }\n'),
        ("b/package.json", '{"name":"n","dependencies":{"left":"^1.0"},"devDependencies":{"right":"2"}}'),
        ("c/composer.json", '{"require":{"php":">=8"}}'),
        ("d/go.mod", "module m\n\ngo 1.21\nrequire one.org/a v1.0.0\nrequire (\n\tgithub.com/x/y v1.2.3\n\t// no\n\tz.org/w v0.1.0 // indirect\n)\n"),
        ("e/requirements.txt", "# c\nflask==2.0  # web\n-r other.txt\nnumpy>=1.2,<2\nplain\nextra[socks]~=1.0\n"),
        ("f/pyproject.toml", '[project]\nname = "p"\ndependencies = [\n  "click>=8",\n  "rich",\n]\n'),
        ("g/Gemfile", "source 'x'\ngem 'rails', '~> 7.0'\ngem \"puma\"\n"),
        ("h/other.txt", "gem 'no'"), ("i/package.json", "not json"), ("j/package.json", None),
    ]
    got = {tuple(r) for r in H.dependencies(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        ("a/Cargo.toml", "dependencies", "serde", "1.0"), ("a/Cargo.toml", "dependencies", "tokio", "1.2"), ("b/package.json", "dependencies", "left", "^1.0"), ("b/package.json", "devDependencies", "right", "2"),
        ("c/composer.json", "require", "php", ">=8"), ("d/go.mod", "require", "one.org/a", "v1.0.0"), ("d/go.mod", "require", "github.com/x/y", "v1.2.3"), ("d/go.mod", "require", "z.org/w", "v0.1.0"),
        ("e/requirements.txt", "requirements", "flask", "==2.0"), ("e/requirements.txt", "requirements", "numpy", ">=1.2,<2"), ("e/requirements.txt", "requirements", "plain", ""), ("e/requirements.txt", "requirements", "extra", "~=1.0"),
        ("f/pyproject.toml", "dependencies", "click", ">=8"), ("f/pyproject.toml", "dependencies", "rich", ""), ("g/Gemfile", "gems", "rails", "~> 7.0"), ("g/Gemfile", "gems", "puma", ""),
    }


def test_formats_and_costs(spark):
    from lodestrata.functions import text as X
    from lodestrata.operators import index as I

    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(X.format_duration(F.lit(s))) for s in (0.0005, 0.0123, 2.5)] == ["500μs", "12.3ms", "2.50s"]
    for s in ("abc", "abcdefghij", "ééééééé", "日本語日本語", "ab🙂cd🙂ef", ""):
        for most in (3, 4, 7, 8, 9, 10):
            raw = s.encode()
            want = s if len(raw) <= most else raw[: most - 3].decode(errors="ignore") + "..."
            assert one(X.truncate_bytes(F.lit(s), most)) == want, (s, most)
    docs = spark.createDataFrame([(i, "abcdef" if i else "abcxyz") for i in range(10)], "doc_id long, text string")
    p = I.postings(docs)
    plan = I.Plan((("abc", "xyz", "cxy"), ("qqq",)))
    costs = I.leaf_costs(p, plan)
    assert costs == {"abc": 10, "cxy": 1, "qqq": 0, "xyz": 1}
    best = I.cheapest(plan, costs, 10, most=1)
    assert best.alternatives == (("cxy",),) and [r["doc_id"] for r in I.candidates(p, best).collect()] == [0]
    assert I.cheapest(I.Plan((("abc",),)), costs, 10).alternatives is None
    assert I.candidates(p, I.cheapest(I.Plan((("qqq",),)), costs, 10)).count() == 0


def test_masks_prune(spark):
    """Documents with all grams of a literal, but not side by side, go by their masks; those that hold it stay."""
    from lodestrata import api
    from lodestrata.operators import index as I

    texts = ["abcdef", "xbcdefabc abcdez", "abcd cdefq bcdex", "defabc", "zz abcdef", "abc bcd cde def"]
    c = spark.createDataFrame([(i, f"{i}.x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    p = I.postings(c).cache()
    plan = I.plan("abcdef")
    assert {r["doc_id"] for r in I.candidates(p, plan).collect()} >= {0, 1, 4, 5}
    left = {r["doc_id"] for r in I.masked(p, plan).collect()}
    assert {0, 4} <= left < {r["doc_id"] for r in I.candidates(p, plan).collect()}
    out = api.respond(c, "abcdef", "count", postings=p)
    assert out["total"] == 2 and out["candidates"] == len(left) and out["error"] is None
    assert api.respond(c, "(")["error"] and sorted(r["doc_id"] for r in api.search(c, "abcdef", "files", postings=p, documents=6).collect()) == [0, 4]


def test_renderers(spark, tmp_path):
    from lodestrata.operators import render as R

    c = spark.createDataFrame([(1, "a/1.x", "one\ntwo hit\nthree\nfour\nfive\nhit")], "doc_id long, path string, text string")
    out = rows(R.matches_text(S.with_context(c, S.SearchOptions("hit", context=1))), "seq")
    assert [r[2] for r in out] == ["1-one", "2:two hit", "3-three", "--", "5-five", "6:hit"]
    t = spark.createDataFrame([("b", 2), ("a", None)], "name string, n long")
    assert [r[1] for r in rows(R.table_text(t, ["name"], 5), "seq")] == ["a", "b    2"]
    assert R.command_output(spark.createDataFrame([("o", None), (None, "e"), ("o", "e")], "stdout string, stderr string")).select("text").collect() == [("o",), ("e",), ("oe",)]
    R.write_manifest(t, str(tmp_path / "m"))
    assert rows(R.read_manifest(spark, str(tmp_path / "m"), "name string, n long"), "name") == [("a", None), ("b", 2)]


def test_hold_stream_over_micro_batches(spark, tmp_path):
    import random

    rng = random.Random(14)
    data = [(rng.choice("ab"), i, i, rng.choice(["begin", "end", "change", "change", "change"]), f"p{rng.randrange(4)}") for i in range(90)]
    data += [(k, 100 + i, 100 + i, "end", None) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(data, "key string, ts long, seq long, kind string, path string")
    for lo, hi in ((0, 30), (30, 60), (60, 200)):
        df.where(f"ts >= {lo} and ts < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = W.held_stream(stream).writeStream.format("memory").queryName("holds").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    want = sorted(tuple(r) for r in W.held(df).where("released is not null").collect())
    assert want and sorted(tuple(r) for r in spark.table("holds").collect()) == want


def test_activity_changes(spark):
    e = spark.sql("SELECT timestamp_seconds(c1) AS ts, c2 AS key, c3 AS item FROM VALUES (0, 'k', 'x'), (20, 'k', 'y'), (500, 'k', 'x') AS t(c1, c2, c3)")
    got = [(r["start"], r["items"]) for r in W.activity_changes(e, "key", "item").selectExpr("unix_seconds(start) AS start", "items").orderBy("start").collect()]
    assert got == [(-290, ["x"]), (-270, ["x", "y"]), (10, ["y"]), (210, ["x"])]
