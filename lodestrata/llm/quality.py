"""Quality rules: base counts and a hashed n-gram likelihood ratio (operator 9).

Words and word pairs of every document are hashed to buckets. Two multinomials over the buckets are counted, one from all
documents (raw) and one from the documents labelled as trusted (target). A document's score is the sum of log p_target / p_raw over
its n-grams, divided by their number. Every document is kept or not by one fixed threshold: from a histogram of the labelled
documents' scores, the lowest value that separates trusted from untrusted ones within 0.02 (of the difference of the two shares
below it) as well as the best does, and no higher than the value that `most_lost` of the trusted ones lie below. Without labels of both kinds the threshold is `default_threshold`.

Both multinomials and the threshold's histogram count every document that they speak of: labels meet documents in shuffled joins on
doc_id, and only sums by bucket and bin come to the driver. The number of buckets follows the input (buckets_of).

Nulls and edges: a null text has no words and fails; null ids have no label; repeated rows count each; an empty table gives an
empty result; labels for absent documents are ignored; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, durable, hash_words, small_batches, spread, table, tidy, window_hashes, words

BUCKETS = 1 << 16
SYMBOLS = "#*$%&|<>"
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(windows: np.ndarray, n_words: int, width: int) -> int:
    """Words in windows that occur twice or more."""
    if len(windows) < 2:
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(counts) == len(windows):
        return 0
    starts = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


class Grams:
    """Word and word-pair buckets of a batch of texts, flat, with the words' bounds."""

    def __init__(self, texts: list[str | None], buckets: int):
        self.words = [words(t) for t in texts]
        self.n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(self.n)
        self.h = hash_words([x for w in self.words for x in w])
        mask = np.uint64(buckets - 1)
        self.one = (self.h & mask).astype(np.int64)
        self.two = (window_hashes(self.h, 2) & mask).astype(np.int64)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = int(self.ends[i] - self.n[i]), int(self.ends[i])
        return self.one[a:b], self.two[a : max(a, b - 1)]


def measure(texts: list, ratio: np.ndarray) -> list[tuple]:
    """The base counts and score of each text."""
    g = Grams(texts, len(ratio))
    windows = window_hashes(g.h, WINDOW)
    rows = []
    for i, text in enumerate(texts):
        n, end = int(g.n[i]), int(g.ends[i])
        one, two = g.of(i)
        score = float(ratio[one].sum(dtype=np.float64) + ratio[two].sum(dtype=np.float64)) / (len(one) + len(two)) if n else 0.0
        twice = repeated_words(windows[end - n : max(end - n, end - WINDOW + 1)], n, WINDOW)
        rows.append((n, sum(map(len, g.words[i])), sum(map(text.count, SYMBOLS)) if text else 0, repeated_lines(text) if text else 0, twice, score))
    return rows


def labelled(labels: DataFrame, value: int) -> DataFrame:
    """doc_id of all documents with that quality."""
    return labels.where((F.col("quality") == value) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def buckets_of(n_docs: int) -> int:
    """A power of two, at least BUCKETS: one bucket for four documents at least, so that buckets don't fill up as the input grows."""
    return max(BUCKETS, 1 << max(0, -(-n_docs // 4) - 1).bit_length())


def marked(docs: DataFrame, good: DataFrame) -> DataFrame:
    """text, target of every document; the few ids are hashed, the texts only dealt. Rows without an id stay where they are."""
    docs, keyed = docs.select("doc_id", "text"), F.col("doc_id").isNotNull()
    joined = docs.where(keyed).join(good.withColumn("target", F.lit(True)).hint("shuffle_hash"), "doc_id", "left")
    joined = joined.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    return joined.union(docs.where(~keyed).select("text", F.lit(False).alias("target")))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs(text, target) -> bucket, raw, target."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts, targets = batch["text"].tolist(), batch["target"].tolist()
            for a, b in chunks(texts):
                g = Grams(texts[a:b], buckets)
                for i, is_target in enumerate(targets[a:b]):
                    if is_target:
                        for x in g.of(i):
                            np.add.at(trusted, x, 1)
                raw += np.bincount(g.one, minlength=buckets)
                # pairs across two texts aren't pairs of the corpus
                inner = np.ones(len(g.two), bool)
                cut = g.ends[:-1] - 1
                inner[cut[(cut >= 0) & (cut < len(inner))]] = False
                raw += np.bincount(g.two[inner], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "raw": raw[at], "target": trusted[at]})

    found = docs.select("text", "target").mapInPandas(tidy(run), "bucket int, raw long, target long")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame, buckets: int) -> np.ndarray:
    """log p_target / p_raw by bucket, each multinomial smoothed with the pseudo-count 1 a bucket. At most `buckets` rows come here."""
    raw, target = np.ones(buckets), np.ones(buckets)
    rows = counts.toArrow()
    at = rows["bucket"].to_numpy()
    raw[at] += rows["raw"].to_numpy()
    target[at] += rows["target"].to_numpy()
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def base_and_score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, the base counts and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # 4 bytes a bucket
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for batch in batches:
            texts, rows = batch["text"].tolist(), []
            for a, b in chunks(texts):
                rows += measure(texts[a:b], r)
            out = pd.DataFrame(rows, columns=[*BASE, "score"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return spread(docs.select("doc_id", "text")).mapInPandas(tidy(run), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", score double")


def fit_threshold(scored: DataFrame, good: DataFrame, bad: DataFrame, most_lost: float, default: float, slack: float = 0.02, bins: int = 4000) -> float:
    """From a histogram of at most 2 * bins rows."""
    lo, hi = -10.0, 10.0
    bin_ = F.least(F.greatest(F.floor((F.col("score") - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    tagged = good.withColumn("good", F.lit(1)).union(bad.withColumn("good", F.lit(0)))
    hist = scored.join(tagged, "doc_id").groupBy("good", bin_.alias("bin")).count().collect()
    counts = np.zeros((2, bins))
    for r in hist:
        counts[r["good"], r["bin"]] += r["count"]
    if not counts.sum(axis=1).all():
        return default
    below = np.concatenate([[[0.0], [0.0]], counts.cumsum(axis=1)], axis=1) / counts.sum(axis=1, keepdims=True)
    apart = below[0] - below[1]
    best = int(np.argmax(apart >= apart.max() - slack))
    spare = int(np.searchsorted(below[1], most_lost, side="right")) - 1
    return lo + min(best, max(spare, 0)) * (hi - lo) / bins


def quality(docs: DataFrame, labels: DataFrame, buckets: int | None = None, most_lost: float = 0.005, default_threshold: float = -1.0) -> DataFrame:
    """doc_id, base counts, score, threshold and kept of every document."""
    small_batches(docs.sparkSession)
    good, bad = durable(labelled(labels, 1)), durable(labelled(labels, 0))
    buckets = buckets or buckets_of(docs.count())
    ratio = log_ratio(bucket_counts(marked(docs, good), buckets), buckets)
    scored = durable(base_and_score(docs, ratio))
    threshold = fit_threshold(scored, good, bad, most_lost, default_threshold)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = scored.withColumn("base_failed", failed)
    return out.withColumn("threshold", F.lit(threshold)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold")))


def op9_likelihood_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
