"""Language of whole texts, with the spans of mixed ones (operator 6).

Training counts hashed character n-grams (2 and 3, with word bounds) of the words of labelled texts, by language, and which scripts
(Unicode ranges) the letters of each language are of. A word's scores are naive Bayes log-likelihoods; languages that don't write the
word's script are ruled out before. Over the words (runs of letters) of a text, Viterbi with a constant switching penalty gives the
likeliest sequence of languages; runs of one language are its spans, and the language with most letters is the text's.

Training rows are a sample by hash of the id of at most about `most_rows` rows in all (documented bound). The model is one table of
`buckets` rows by languages (broadcast). Prediction reads the whole text, nothing else.

score: the share of letters in spans of the predicted language, times the mean posterior of that language over those spans.

Nulls and edges: a null text, or one without letters, is `und` with score 0, as is every text if nothing could be learned; ties go
to the language first in alphabetical order; null languages aren't learned from; repeated rows get equal results; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carry, chunks, mix, small_batches, spread, table, tidy

#: First code points of script ranges, and their names (Unicode blocks; fixed values).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_STARTS = [a for a, _ in SCRIPTS]
_LETTERS = re.compile(r"[^\W\d_]+")
GRAMS = (2, 3)
BUCKETS = 1 << 17
PENALTY = 6.0
#: Characters worked on at once: side by side, long texts cost less.
CHUNK = 2_000_000


def script_of(word: str) -> str:
    if word.isascii():
        return "Latin"
    counts = Counter(SCRIPTS[bisect.bisect_right(_STARTS, ord(c)) - 1][1] for c in word)
    return max(sorted(counts), key=lambda s: counts[s])


def tokens(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower()) if text else []


def gram_buckets(uniques: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, one word after another for each n, and the word of each."""
    chars = np.frombuffer(("^" + "$^".join(uniques) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, uniques), np.int64, len(uniques)) + 2
    word = np.repeat(np.arange(len(uniques)), sizes)
    at, of = [], []
    for n in GRAMS:
        h = np.full(len(chars) - n + 1, n, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + chars[i : len(chars) - n + 1 + i])
        inside = word[: len(h)] == word[n - 1 :]
        at.append((h[inside] & np.uint64(buckets - 1)).astype(np.int64))
        of.append(word[: len(h)][inside])
    return np.concatenate(at), np.concatenate(of)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: log-likelihoods
    scripts: dict[str, np.ndarray]  # script -> 0, or far below for languages that don't use it

    def word_scores(self, uniques: list[str]) -> np.ndarray:
        """Log-likelihoods of words relative to each one's best language, ruled-out languages far below."""
        at, of = gram_buckets(uniques, len(self.table))
        out = np.empty((len(uniques), len(self.langs)), np.float32)
        for i in range(len(self.langs)):
            # n-grams overlap: scaled to about one independent observation a letter
            out[:, i] = np.bincount(of, weights=self.table[at, i], minlength=len(uniques)) / len(GRAMS)
        for i, w in enumerate(uniques):
            if (ruled := self.scripts.get("Latin" if w.isascii() else script_of(w))) is not None:
                out[i] += ruled
        return out - out.max(axis=1, keepdims=True)


def train(docs: DataFrame, most_rows: int = 40_000, buckets: int = BUCKETS) -> Model:
    """From docs(doc_id, text, lang) whose lang isn't null; the caller leaves out what is held out."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    n = known.select("lang").count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most_rows / n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, Counter] = {}
        for batch in batches:
            texts, langs = batch["text"].tolist(), batch["lang"].tolist()
            for a, b in chunks(texts):
                by_lang: dict[str, Counter] = {}
                for text, lang in zip(texts[a:b], langs[a:b], strict=True):
                    by_lang.setdefault(lang, Counter()).update(tokens(text))
                for lang, found in by_lang.items():
                    if not found:
                        continue
                    uniques = list(found)
                    times = np.fromiter(found.values(), np.float64, len(uniques))
                    at, of = gram_buckets(uniques, buckets)
                    own = counts.setdefault(lang, np.zeros(buckets))
                    own += np.bincount(at, weights=times[of], minlength=buckets)
                    letters = scripts.setdefault(lang, Counter())
                    for w, c in found.items():
                        letters["Latin" if w.isascii() else script_of(w)] += c * len(w)
        for lang, own in sorted(counts.items()):
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "script": "", "bucket": at.astype(np.int32), "n": own[at].astype(np.int64)})
            yield pd.DataFrame([(lang, s, 0, c) for s, c in sorted(scripts[lang].items())], columns=["lang", "script", "bucket", "n"])

    found = spread(known).mapInPandas(tidy(run), "lang string, script string, bucket int, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n"))
    # at most `buckets` rows a language, one row of arrays each
    rows = found.groupBy("lang", "script").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.full((buckets, len(langs)), 0.5)
    letters: Counter = Counter()
    for r in rows:
        if r["script"]:
            letters[r["lang"]] += sum(r["n"])
        else:
            counts[np.array(r["at"], dtype=np.int64), place[r["lang"]]] += r["n"]
    scripts = {}
    for r in rows:
        if r["script"]:
            row = scripts.setdefault(r["script"], np.full(len(langs), -1e4, np.float32))
            if sum(r["n"]) >= 0.01 * letters[r["lang"]]:
                row[place[r["lang"]]] = 0.0
    scripts = {s: row for s, row in scripts.items() if (row == 0).any()}
    return Model(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32), scripts)


def viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word. scores: words x languages, texts one after another; texts advance side by side.

    Texts go in order of length, so that those still running are a prefix; memory is one byte a word and language.
    """
    n_langs = scores.shape[1]
    labels = np.zeros(len(scores), np.int8)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return labels
    first, size = starts[order], counts[order]
    longest = int(size[0])
    running = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than t words
    back = np.zeros((len(scores), n_langs), np.int8)
    best = scores[first].copy()
    own = np.arange(n_langs, dtype=np.int8)
    for t in range(1, longest):
        k = int(running[t])
        b = best[:k]
        top = b.argmax(axis=1)
        switch = b[np.arange(k), top] - penalty
        stay = b >= switch[:, None]
        at = first[:k] + t
        back[at] = np.where(stay, own, top[:, None].astype(np.int8))
        best[:k] = np.where(stay, b, switch[:, None]) + scores[at]
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = int(running[t])
        at = first[:k] + t
        labels[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return labels


def label_batch(texts: list, model: Model, penalty: float) -> list[tuple]:
    """(language, score, spans) of each text; spans: (language, first word, end word, letters)."""
    langs = model.langs
    per = [tokens(t) for t in texts]
    counts = np.array([len(x) for x in per], dtype=np.int64)
    flat = np.array([w for x in per for w in x], dtype=object)
    if not len(flat) or not langs:
        return [("und", 0.0, []) for _ in texts]
    codes, uniques = pd.factorize(flat)
    uniques = uniques.tolist()
    scores = model.word_scores(uniques)[codes]
    sizes = np.fromiter(map(len, uniques), np.int64, len(uniques))[codes]
    del flat, codes, uniques
    ends = np.cumsum(counts)
    labels = viterbi(scores, ends - counts, counts, penalty)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if not n:
            out.append(("und", 0.0, []))
            continue
        own, size, s = labels[end - n : end], sizes[end - n : end], scores[end - n : end]
        letters = np.bincount(own, weights=size, minlength=len(langs))
        lang = int(letters.argmax())
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        bounds = [0, *cuts.tolist(), n]
        spans = [(langs[own[a]], a, b, int(size[a:b].sum())) for a, b in zip(bounds, bounds[1:], strict=False)]
        mass = s[own == lang].sum(axis=0, dtype=np.float64)
        posterior = 1.0 / np.exp(np.clip(mass - mass[lang], -700, 60)).sum()
        out.append((langs[lang], float(min(1.0, letters[lang] / size.sum() * posterior)), spans))
    return out


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows = batch["text"].tolist(), []
            for a, b in chunks(texts, CHUNK):
                rows += label_batch(texts[a:b], shared.value, penalty)
            spans = [[{"lang": x, "start": a, "end": b, "letters": n} for x, a, b, n in s] for _, _, s in rows]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": spans})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int,letters:int>>"
    return spread(docs.select("doc_id", "text")).mapInPandas(tidy(run), schema)


def keep_identified(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """docs without the rows whose text has no language (`und`); all of them if the model knows none."""
    if not model.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(texts: list) -> tuple:
            rows = []
            for a, b in chunks(texts, CHUNK):
                rows += label_batch(texts[a:b], model, penalty)
            return [r[0] != "und" for r in rows], None

        return step

    return carry(docs, make)


def op6_viterbi_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))
    out = identify(docs, model)
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", n_spans)


def crc_of(doc_id: int) -> int:
    """What held_out() computes, for tests."""
    return zlib.crc32(str(doc_id).encode())
