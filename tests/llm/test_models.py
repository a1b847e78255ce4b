"""Languages, quality, HTML and decontamination."""

from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontam as D
from lodestrata.llm import html as H
from lodestrata.llm import langid as G
from lodestrata.llm import quality as Q
from lodestrata.llm.common import chunks, lower_az, words

DATA = "/root/testdata/sf0.001"


def test_words_and_lower():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "É", "Z", " ", "\t", "\x1c", "\x85", "\xa0", " ", "　", "\n", "\x0b", "🙂"]) for _ in range(rng.randint(0, 12)))
        assert words(t) == re.findall(r"[^\x20\x09-\x0D]+", t)
        assert lower_az(t) == re.sub("[A-Z]", lambda m: m[0].lower(), t)
    assert list(chunks(["aa", "b", None, "cccc", ""], 3)) == [(0, 3), (3, 4), (4, 5)] and list(chunks([])) == []


# ---- languages ----


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, G.train(docs.where(~G.held_out(F.col("doc_id"))))


def test_held_out_accuracy(model):
    docs, m = model
    out = G.identify(docs.where(G.held_out(F.col("doc_id"))), m).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n >= 0.97
    assert {int(r[0]) for r in docs.where(G.held_out(F.col("doc_id"))).select("doc_id").collect()} == {int(r[0]) for r in docs.select("doc_id").collect() if G.crc_of(r[0]) % 5 == 0}


def test_spans_of_a_mixed_text(model, spark):
    docs, m = model
    t = {r["lang"]: r["t"] for r in docs.where("n_chars > 400").groupBy("lang").agg(F.min("text").alias("t")).collect()}
    en, de = t["en"][:300].rsplit(" ", 1)[0], t["de"][:900].rsplit(" ", 1)[0]
    r = G.identify(spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string"), m).first()
    assert r["lang_pred"] == "de" and [s["lang"] for s in r["spans"]][:1] == ["en"] and r["spans"][-1]["lang"] == "de" and 0.5 < r["score"] < 0.95


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(40):
        counts = rng.integers(0, 6, size=5)
        scores = rng.normal(size=(int(counts.sum()), 3)).astype(np.float32)
        ends = np.cumsum(counts)
        got = G.viterbi(scores, ends - counts, counts, 0.8)
        for a, b in zip(ends - counts, ends, strict=True):
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 0.8 * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
            if b > a:
                assert value(tuple(got[a:b])) >= max(map(value, itertools.product(range(3), repeat=int(b - a)))) - 1e-5


def test_languages_odd_rows(odd, none, model):
    got = {(r["doc_id"], r["lang_pred"]) for r in G.identify(odd, model[1]).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (1, "en")} <= got
    assert G.identify(none, model[1]).count() == 0
    empty = G.train(none)
    assert empty.langs == [] and {r["lang_pred"] for r in G.identify(odd, empty).collect()} == {"und"}
    assert G.keep_identified(odd, empty).count() == odd.count()
    kept = G.keep_identified(odd, model[1])
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert [G.script_of(w) for w in ("été", "слово", "日本", "かな", "λόγος")] == ["Latin", "Cyrillic", "Han", "Kana", "Greek"]


# ---- quality ----


def plain_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))


def test_base_counts():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["".join(rng.choice(["a", " ", "\n", "#", "|", "x y", "\x1c", "\xa0"]) for _ in range(rng.randint(0, 60))) for _ in range(500)] + [None, "", "\n\n"]
    ratio = np.zeros(1 << 10, np.float32)
    assert [r[:5] for r in Q.measure(texts, ratio)] == [plain_counts(t) for t in texts]


def test_likelihood_ratio(spark):
    """Counts and scores against a direct computation, and junk told from prose."""
    rng = random.Random(2)
    good = [" ".join(rng.choice(["river", "stone", "light", "walks", "slowly", "under"]) for _ in range(60)) for _ in range(40)]
    bad = [" ".join(rng.choice(["buy", "now", "click", "$$$"]) for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(i, 0, 0) for i in range(40, 55)] + [(None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in Q.quality(docs, labels).collect()}
    n = Q.BUCKETS
    counts = {}
    for name, ids in (("raw", range(70)), ("target", range(20))):
        c = np.ones(n)
        for i in ids:
            one, two = Q.Grams([(good + bad)[i]], n).of(0)
            np.add.at(c, one, 1)
            np.add.at(c, two, 1)
        counts[name] = np.log(c / c.sum())
    ratio = counts["target"] - counts["raw"]
    for i, t in enumerate(good + bad):
        one, two = Q.Grams([t], n).of(0)
        assert abs(out[i]["score"] - (ratio[one].sum() + ratio[two].sum()) / (len(one) + len(two))) < 1e-4
        if not out[i]["base_failed"]:
            assert out[i]["kept"] == (i < 40)


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["n_words"], r["kept"]) for r in Q.quality(odd, labels).collect()}
    assert got[3] == (0, False) and got[6] == (1, False) and got[7][0] == 20_000 and not got[7][1]
    assert Q.quality(odd, labels).count() == odd.count()
    assert Q.quality(none, labels).count() == 0 and Q.quality(odd, labels.where("false")).count() == odd.count()


def test_every_label_counts(spark):
    """However many labels there are, each labelled document is in the target multinomial and the threshold."""
    docs = spark.createDataFrame([(i, f"word{i} " * 30) for i in range(40)] + [(None, "word40 " * 30)], "doc_id long, text string")
    many = spark.range(1_000, 401_000).selectExpr("id AS doc_id", "int(id % 2) AS quality", "0 AS toxic")
    few = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    want = {r["doc_id"]: (r["score"], r["threshold"]) for r in Q.quality(docs, few).collect()}
    got = {r["doc_id"]: (r["score"], r["threshold"]) for r in Q.quality(docs, few.union(many)).collect()}
    assert got == want and len({t for _, t in got.values()}) == 1
    good = Q.labelled(few.union(many), 1)
    counts = Q.bucket_counts(Q.marked(docs, good), Q.BUCKETS).agg(F.sum("raw"), F.sum("target")).first()
    assert tuple(counts) == (41 * 59, 20 * 59)


def test_buckets_follow_the_input():
    assert [Q.buckets_of(n) for n in (0, 4 << 16, (4 << 16) + 1, 15_000_000)] == [1 << 16, 1 << 16, 1 << 17, 1 << 22]


# ---- HTML ----


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(labels):
            own = sum(-g if x else 0 for g, x in zip(gain, labels, strict=True))  # noqa: B023
            return own + sum(w for a, b, w in edges if labels[a] != labels[b])  # noqa: B023

        assert abs(cost(H.minimum_cut(gain, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6
    long = [3.0 if i % 7 else -0.5 for i in range(5000)]
    assert all(H.minimum_cut(long, [(i, i + 1, 1.0) for i in range(4999)]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy this now, please.</div><article><h1>A&nbsp;title</h1><p>First   paragraph, <b>with</b> caf&eacute; &amp; more&#46;</p><p>Second paragraph has
a line end.<aside>Related: other things, here.</aside><p>Third one &lt;kept&gt;.<!-- <p>no</p> --></article>
<div id="comments"><article class="comment"><p>Great article, I liked it very much.</p></article></div><form><p>Your name, please:</p><input></form><footer>&copy; site</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE, H.PRIOR) == "A title\nFirst paragraph, with café & more.\nSecond paragraph has a line end.\nThird one <kept>."
    plain = "<body><div><a href=x>One</a> <a href=y>Two</a></div><div>" + "".join(f"<p>This is a long paragraph of running text, number {i}, that says something.</p>" for i in range(4)) + "</div><div><a href=z>Imprint</a></div>"
    assert H.main_text(plain, H.PRIOR).count("\n") == 3 and "Imprint" not in H.main_text(plain, H.PRIOR)
    for bad in (None, "", "<", "<p", "<!-- x", "<script>x", "plain text", "<p title='>x</p>", "<b><i><p>" * 2000, "a<b" * 5000):
        H.main_text(bad, H.PRIOR)


def test_marks_that_hide_nothing():
    """Words in other attributes' values, tags left open, and classes that say whether there are comments leave the text alone."""
    text = "This is a long paragraph of running text, that says something, and ends."
    for start in ('<article style="overflow:hidden">', '<article data-hidden="false">', '<article title="A hidden valley">', '<article class="x hidden-xs">', "<article data-id=5 aria-hidden=false>", "<article title='a class=\"comments\"'>"):
        assert H.main_text(f"<body>{start}<p>{text}</p></article>", H.PRIOR) == text, start
    for start in ("<article hidden>", "<article hidden=''>", '<article data-x="1" HIDDEN>', '<article aria-hidden="true">', '<article class="comment-list">', '<article id="comments-wrapper">'):
        assert H.main_text(f"<body>{start}<p>{text}</p></article>", H.PRIOR) == "", start
    for tag in sorted(H.RAW - H.TO_THE_END):
        assert H.main_text(f"<body><article><{tag}><p>{text}</p></article>", H.PRIOR) == text, tag
    assert H.main_text(f"<article><p>{text}</p><script><p>{text}</p>", H.PRIOR) == text
    for word in ("has-comments", "no-comments", "hasComments", "post with-comments"):
        for page in (f'<div class="{word}"><article><p>{text}</p></article></div>', f'<div class="content {word}"><p>{text}</p></div>'):
            assert H.main_text(page, H.PRIOR) == text, page
    assert len(H.read_blocks("<button>" * 200_000 + "x")) == 1


def test_articles_of_the_test_pages(spark):
    import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in pages.join(H.extract(pages).select("page_id", F.col("text").alias("got")), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner))
        assert r["got"] == "\n".join(x for x in parts if x)


LONG = "This is a long paragraph of running text, that says something, and ends."
PAGE_OF = "<body><nav><a href=x>Home</a></nav>%s<footer>&copy; x</footer></body>"
AD = "Buy this now, please, it is a very good thing to have."
REPLY = "Great article, I liked it very much, thanks."


@pytest.mark.parametrize(
    ("middle", "want"),
    [
        (f'<article><p>{LONG}</p><p class="share-price related-work">The share price rose.</p><p>{LONG}</p></article>', [LONG, "The share price rose.", LONG]),
        (f'<article><div class="share-price related-work"><p>The share price rose.</p></div><p>{LONG}</p></article>', ["The share price rose.", LONG]),
        (f"<article><p>{LONG}</p><math><mi>x</mi><mo>=</mo><mn>1</mn></math><p>{LONG} <math><mi>y</mi></math> ok.</p></article>", [LONG, "x=1", f"{LONG} y ok."]),
        (f"<article><p>{LONG}</p><p>Press the <button>OK</button> key.</p></article>", [LONG, "Press the OK key."]),
        (f"<article><p>{LONG}</p><p>No.</p><table><tr><td>1<td>2</table><ul><li>One<li>Two</ul></article>", [LONG, "No.", "1", "2", "One", "Two"]),
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><div><p>{REPLY}</p><p>I did not like it at all.</p></div>", [LONG, LONG]),
        (f"<main><article><h1>T</h1><p>{LONG}</p></article><section><h2>Comments</h2><div><p>{REPLY}</p></div></section></main>", ["T", LONG]),
        (f"<article><h1>T</h1><p>{LONG}</p><section><h3>3 Comments</h3><div><b>Jo</b><p>{REPLY}</p></div></section></article>", ["T", LONG]),
        (f"<article><h1>T</h1><p>{LONG}</p><section><article><p>{REPLY}</p></article></section></article>", ["T", LONG]),
        (f'<article><p>{LONG}</p><div class="ad">{AD}</div><p>{LONG}</p><div class="ad-box"><p>{AD}</p></div></article>', [LONG, LONG]),
        (f'<article><p>{LONG}</p><aside><p>{LONG}</p></aside><ul class="related"><li><a href=a>One</a><li><a href=b>Two</a></ul></article>', [LONG]),
        (f'<div class="cookie-notice"><p>We use cookies, to show adverts.</p></div><div id="content"><h1>Title here</h1><p>{LONG}</p></div><div class="sidebar"><p>Some teaser text, here.</p></div>', ["Title here", LONG]),
    ],
)
def test_the_cut_weighs_marks(middle, want):
    assert H.main_text(PAGE_OF % middle, H.PRIOR).split("\n") == want


def test_the_cut_changes_labels():
    """Short blocks among text are content although their own odds say no; a lone sentence among links is not although they say yes."""
    short = PAGE_OF % f"<div><h1>T</h1><p>{LONG}</p><h2>A</h2><p>{LONG}</p><ul><li>b<li>c</ul><p>{LONG}</p></div>"
    lone = "<body><div>" + "<p><a href=x>Some other page</a></p>" * 3 + "<p>Do see more.</p>" + "<p><a href=x>Some other page</a></p>" * 3 + f"</div><div><p>{LONG}</p><p>{LONG}</p></div>"
    for page, sign in ((short, False), (lone, True)):
        blocks = H.read_blocks(page)
        odds, labels = H.odds(blocks, H.PRIOR), H.label_blocks(blocks, H.PRIOR)
        changed = [b.text for b, o, keep in zip(blocks, odds, labels, strict=True) if (o > 0) != keep]
        assert changed and all((o > 0) == sign for b, o, keep in zip(blocks, odds, labels, strict=True) if (o > 0) != keep), (changed, odds, labels)


def test_reading_is_linear():
    import time

    for page in ("<div>", "<div>x<p>", "<section><article><div>x</section>", '<p title="x>text</p>', '<a x="1>="', "<p x='>text", "<ul><li>", "</p>", "<svg>"):
        seconds = []
        for n in (4000, 32000):
            t = time.process_time()
            H.read_blocks(page * n)
            seconds.append(time.process_time() - t)
        assert seconds[1] < max(0.2, 24 * seconds[0]), (page, seconds)


def test_html_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, doc_id long"
    pages = spark.createDataFrame([(1, "u", None, "x", 1), (1, "u", None, "x", 1), (None, None, "", None, None), (2, "v", PAGE, "", 2)], schema)
    got = {(r["page_id"], len(r["text"]) > 0) for r in H.extract(pages).collect()}
    assert got == {(1, False), (None, False), (2, True)} and H.extract(pages.where("false")).count() == 0


# ---- decontamination ----


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 60)))) for i in range(60)] + [(60, "short one"), (61, None), (62, ""), (63, "x")]
    docs, want = [], set()
    for i in range(200):
        w = [word() for _ in range(rng.randint(0, 200))]
        if i % 4 == 0:
            item, text = items[rng.randrange(60)]
            passage = text.split()
            n = len(passage)
            if i % 8 == 0 and n > 30:
                passage[rng.randrange(n)] = word()
            elif i % 24 == 4 and n > 30:
                del passage[rng.randrange(n)]
            elif i % 24 == 12 and n > 30:
                passage.insert(rng.randrange(n), word())
            elif i % 24 == 20 and n > 40:
                passage = passage[n // 2 :] + passage[: n // 2]
            at = rng.randint(0, len(w))
            w[at:at] = " ".join(passage).upper().replace(" ", ". ", 1).split()
            want.add((i, item))
        docs.append((i, " ".join(w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def plain(doc, item):
        """The best share over all item-sized windows, by counting."""
        d, m = D.normalised(doc), D.normalised(item)
        if not m or not d:
            return 0.0
        k = min(5, len(m))
        grams = lambda w: collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        mine = grams(m)
        if not mine.keys() & grams(d).keys():
            return 0.0
        return max((mine & grams(d[s : s + len(m)])).total() / mine.total() for s in range(max(1, len(d) - len(m) + 1)))

    brute = {(d, i): s for d, t in docs for i, x in items if (s := plain(t, x)) >= 0.8}
    for block in (5000, 20):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.contaminated(df, bench, block_items=block).collect()}
        assert got.keys() == brute.keys() and want <= got.keys()
        assert all(abs(got[k] - brute[k]) < 1e-9 for k in got)
    kept = {r["doc_id"] for r in D.decontaminate(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, "jumps over the lazy dog and runs away"), (2, None), (3, "")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(odd, bench).collect()) == [(1, 1), (1, 1), (2, 1)]
    out = D.decontaminate(odd, bench)
    assert out.columns == odd.columns and out.count() == odd.count() - 3
    assert D.contaminated(none, bench).count() == 0 and D.contaminated(odd, bench.where("false")).count() == 0
    assert D.decontaminate(odd, bench.where("false")).count() == odd.count()


def test_fingerprints_within_the_radius_are_found():
    """Multi-index blocks return every pair within the radius, and few others are looked at."""
    rng = np.random.default_rng(3)
    stored = rng.integers(0, 2**63, size=500, dtype=np.uint64)
    asked = stored.copy()
    for i in range(500):
        for b in rng.choice(64, size=int(rng.integers(0, D.RADIUS + 2)), replace=False):
            asked[i] ^= np.uint64(1) << np.uint64(b)
    tables = D.HammingTables(stored, D.RADIUS)
    w, i, d = tables.within(asked)
    want = np.bitwise_count(asked[:, None] ^ stored[None, :])
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(want <= D.RADIUS)), strict=True))
    assert (d == want[w, i]).all()
    unrelated = rng.integers(0, 2**63, size=2000, dtype=np.uint64)
    passed = sum(int((np.searchsorted(v, own, "right") - np.searchsorted(v, own, "left")).sum()) for (lo, mask), (v, _) in zip(tables.blocks, tables.tables, strict=True) for own in [(unrelated >> lo) & mask])
    assert passed < 2000 * 500 * 2e-4


def test_recall_of_the_fingerprints():
    """Edited items: of all pairs that brute force over every window finds, none is missed; swapped halves and edits of each kind."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    items = [[word() for _ in range(rng.randint(20, 80))] for _ in range(150)]
    index = D.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    missed = found = 0
    for i, item in enumerate(items):
        for kind in range(5):
            w = list(item)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w))
                if kind == 0:
                    w[at] = word()
                elif kind == 1:
                    del w[at]
                elif kind == 2:
                    w.insert(at, word())
                elif kind == 3:
                    w = w[at:] + w[:at]
                else:
                    w[at:at] = [word(), word()]
            text = [word() for _ in range(rng.randrange(50))] + w + [word() for _ in range(rng.randrange(50))]
            grams = lambda x: collections.Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4))
            mine = grams(item)
            truth = max((mine & grams(text[s : s + len(item)])).total() / mine.total() for s in range(max(1, len(text) - len(item) + 1)))
            h = D.hash_words(text)
            got = {x[1]: x[4] for x in index.matches(h, np.array([len(h)]))}
            if truth >= D.THRESHOLD:
                found += 1
                missed += i not in got or abs(got[i] - truth) > 1e-9
            assert truth >= D.THRESHOLD or i not in got
    assert found > 250 and missed == 0


def test_equal_items_answer_each(spark):
    bench = spark.createDataFrame([(i, "one two three four five six seven") for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight"), (2, "none")], "doc_id long, text string")
    assert sorted(r["item_id"] for r in D.contaminated(docs, bench, block_items=1).collect()) == list(range(50))
