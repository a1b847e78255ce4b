"""Benchmark decontamination by SimHash of item-sized windows (operator 1).

Words are whole texts lower-cased (A-Z) without . , ; : ! ? " ' ( ) [ ], split at white space. An item of m words is compared with
every window of m words (a shorter text is one window). Similarity is the share of the item's k-word shingles, weighted by how often
each occurs in it, that stand in the window (multiset intersection); at least `threshold` is a match.

* A window can only reach the threshold when that many of its shingles, repeats counted, occur in some item of its size. One running
  count over a text finds those windows; every other window is out by proof, whatever the order of the words.
* Each window left has `prints` SimHash fingerprints of 64 bits, over its shingles that occur in some item of its size (others add
  nothing to any similarity). They differ in the weights: a shingle's own weight is 1 / u^2 for a u in (0, 1] drawn by its hash and the number of the
  fingerprint. Weights so uneven let a few shingles steer a fingerprint, so that windows with 0.8 of an item's shingles agree
  within 3 bits in 7 of 10 fingerprints, where evenly weighted ones would differ in 13 bits and no index could tell them from chance.
* Multi-index Hamming blocks: a fingerprint is cut into radius + 1 blocks, each with a table sorted by block value. Two fingerprints
  within `radius` bits agree in at least one block, so the tables return every item within the radius; the exact distance follows. An
  unrelated item passes a table by chance in 6 of 100,000 cases.
* Candidates are verified by exact similarity. A window at the threshold is missed if no fingerprint is within the radius: 0.3^12.

Items are taken once each by text, in blocks of about `block_items` texts or `block_chars` characters (one pass over the documents
each); a block's index is built once and broadcast, so what is sent is bounded, whatever the number of items and of their copies.

Nulls and edges: null or wordless texts and items match nothing; an item of fewer than k words is matched as one shingle of all
its words; equal items match each for itself, repeated documents likewise; a null doc_id is kept as a null doc_id in the result;
of equally similar windows the first is reported; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carry, chunks, hash_words, mix, small_batches, spread, table, tidy, window_hashes, words

K, THRESHOLD, RADIUS, PRINTS = 5, 0.8, 3, 12
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
_DROPPED = b".,;:!?\"'()[]"
_BITS = np.arange(64, dtype=np.uint64)
_PLACES = np.uint64(1) << _BITS


def normalised(text: str | None) -> list[str]:
    if not text:
        return []
    return words(text.encode("utf-8", "surrogatepass").lower().translate(None, _DROPPED).decode("utf-8", "surrogatepass"))


def _votes(shingles: np.ndarray, number: int) -> np.ndarray:
    """Each shingle's 64 votes in the fingerprint of that number: its weight, or minus its weight."""
    h = mix(shingles + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    # u of 23 bits, so that sums of whole weights are exact
    u = ((h >> np.uint64(41)) + np.uint64(1)).astype(np.float64) / (1 << 23)
    weight = np.floor(1 / (u * u)).astype(np.int64)
    signs = ((mix(h)[:, None] >> _BITS) & np.uint64(1)).astype(np.int64) * 2 - 1
    return signs * weight[:, None]


def fingerprints(shingles: np.ndarray, known: np.ndarray, size: int, prints: int) -> np.ndarray:
    """The fingerprints (a row each) of every run of `size` shingles; those not known weigh nothing."""
    n = len(shingles) - size + 1
    out = np.empty((n, prints), np.uint64)
    for i in range(prints):
        votes = _votes(shingles, i)
        votes[~known] = 0
        sums = np.zeros((len(shingles) + 1, 64), np.int64)
        np.cumsum(votes, axis=0, out=sums[1:])
        out[:, i] = ((sums[size:] > sums[:n]) * _PLACES).sum(axis=1, dtype=np.uint64)
    return out


class HammingTables:
    """Finds every stored fingerprint within radius bits: radius + 1 blocks, of which two such fingerprints share at least one."""

    def __init__(self, stored: np.ndarray, radius: int):
        self.stored, self.radius = stored, radius
        edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
        self.blocks = [(np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.tables = []
        for lo, mask in self.blocks:
            values = (stored >> lo) & mask
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], order))

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asked, stored, distance) of all pairs within the radius; a pair may come more than once."""
        found = []
        for (lo, mask), (values, order) in zip(self.blocks, self.tables, strict=True):
            own = (asked >> lo) & mask
            a, b = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = b - a
            q = np.repeat(np.arange(len(asked)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            x = order[place]
            d = np.bitwise_count(asked[q] ^ self.stored[x])
            near = d <= self.radius
            found.append((q[near], x[near], d[near]))
        q, x, d = (np.concatenate(c) for c in zip(*found, strict=True))
        return q, x, d


class SizeClass:
    """The items of one number of words."""

    def __init__(self, m: int, k: int):
        self.m, self.k, self.n = m, min(k, m), m - min(k, m) + 1
        self.ids: list = []
        self.shingles: list[np.ndarray] = []

    def seal(self, radius: int, prints: int) -> None:
        step = max(1, 100_000 // self.n)
        parts = [np.stack(self.shingles[a : a + step]) for a in range(0, len(self.shingles), step)]
        everything = np.concatenate([np.stack([((_votes(x.ravel(), i).reshape(len(x), self.n, 64).sum(axis=1) > 0) * _PLACES).sum(axis=1, dtype=np.uint64) for i in range(prints)], axis=1) for x in parts])
        self.tables = [HammingTables(everything[:, i].copy(), radius) for i in range(prints)]
        self.counts = [np.unique(s, return_counts=True) for s in self.shingles]

    def candidates(self, prints: np.ndarray) -> dict[int, dict[int, int]]:
        """item -> window -> least distance, of all pairs within the radius in some fingerprint."""
        out: dict[int, dict[int, int]] = {}
        for i, t in enumerate(self.tables):
            for w, item, d in zip(*(c.tolist() for c in t.within(prints[:, i])), strict=True):
                at = out.setdefault(item, {})
                at[w] = min(d, at.get(w, 64))
        return out

    def shared(self, item: int, shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """How many of the item's shingles, repeats counted, each of the given runs of `size` shingles holds."""
        keys, most = self.counts[item]
        place = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        place[keys[place] != shingles] = len(keys)
        out = np.empty(len(starts), np.int64)
        step = max(1, 1_000_000 // (len(keys) + size + 1))
        for a in range(0, len(starts), step):
            grid = place[starts[a : a + step][:, None] + np.arange(size)]
            grid += np.arange(len(grid))[:, None] * (len(keys) + 1)
            held = np.bincount(grid.ravel(), minlength=len(grid) * (len(keys) + 1)).reshape(len(grid), -1)[:, : len(keys)]
            out[a : a + step] = np.minimum(held, most).sum(axis=1)
        return out


class Index:
    """Items given as (id, text)."""

    def __init__(self, items: list[tuple], k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS, prints: int = PRINTS):
        self.k, self.threshold, self.prints = k, threshold, prints
        self.classes: dict[int, SizeClass] = {}
        for item_id, text in items:
            h = hash_words(normalised(text))
            m = len(h)
            if m:
                c = self.classes.setdefault(m, SizeClass(m, k))
                c.ids.append(item_id)
                c.shingles.append(window_hashes(h, c.k))
        self.widths = {}
        for width in sorted({c.k for c in self.classes.values()}):
            mine = [c for c in self.classes.values() if c.k == width]
            own = [np.unique(np.concatenate(c.shingles)) for c in mine]
            # (shingle, words of the items that hold it), and where each shingle's rows start
            every, sizes = np.concatenate(own), np.repeat([c.m for c in mine], [len(x) for x in own])
            order = np.argsort(every, kind="stable")
            keys, starts = np.unique(every[order], return_index=True)
            bits = np.zeros(1 << 20, bool)
            bits[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.widths[width] = (bits, keys, np.append(starts, len(every)), sizes[order], min(map(self._least, mine)))
        for c in self.classes.values():
            c.seal(radius, prints)

    def _least(self, c: SizeClass) -> int:
        """The fewest shared shingles that reach the threshold."""
        n = int(np.ceil(self.threshold * c.n - 1e-9))
        return max(n, 1)

    def matches(self, h: np.ndarray, ends: np.ndarray) -> list[tuple]:
        """(document, item id, start word, words, similarity, distance): the best window of each pair. h: word hashes of all texts."""
        best: dict[tuple, tuple] = {}
        for width, (bits, keys, starts, sizes, least) in self.widths.items():
            s = window_hashes(h, width)
            if not len(s):
                continue
            at = np.flatnonzero(bits[(s & np.uint64(0xFFFFF)).astype(np.int64)])
            at = at[np.isin(s[at], keys)]
            doc = np.searchsorted(ends, at, side="right")
            inside = at + width <= ends[doc] if len(at) else np.empty(0, bool)
            at, doc = at[inside], doc[inside]
            for d in np.flatnonzero(np.bincount(doc, minlength=1) >= least).tolist():
                first, last = (int(ends[d - 1]) if d else 0), int(ends[d])
                hits = at[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
                key = np.searchsorted(keys, s[hits])
                n = starts[key + 1] - starts[key]
                rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[key], n)
                places, m = np.repeat(hits - first, n), sizes[rows]
                for size, count in zip(*(x.tolist() for x in np.unique(m, return_counts=True)), strict=True):
                    c = self.classes[size]
                    if count >= self._least(c):
                        self._document(d, c, s[first : last - width + 1], places[m == size], best)
        return [(d, *v) for (d, _), v in best.items()]

    def _document(self, d: int, c: SizeClass, s: np.ndarray, hits: np.ndarray, best: dict) -> None:
        """The matches of one text and items of one size: s are its shingles, hits the places of those that occur in such an item."""
        known = np.zeros(len(s), bool)
        known[hits] = True
        below = np.concatenate([[0], np.cumsum(known)])
        size = min(c.n, len(s))
        # windows with enough known shingles, in runs of windows that overlap
        starts = np.flatnonzero(below[size:] - below[: len(below) - size] >= self._least(c))
        if len(starts):
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
                for a in range(0, len(run), 4096):
                    self._windows(d, c, s, known, run[a : a + 4096], size, best)

    def _windows(self, d: int, c: SizeClass, s: np.ndarray, known: np.ndarray, starts: np.ndarray, size: int, best: dict) -> None:
        lo, hi = int(starts[0]), int(starts[-1]) + size
        prints = fingerprints(s[lo:hi], known[lo:hi], size, self.prints)[starts - lo]
        for item, found in c.candidates(prints).items():
            w = np.array(sorted(found))
            both = c.shared(item, s[lo:hi], starts[w] - lo, size)
            i = int(both.argmax())
            if both[i] >= self.threshold * c.n - 1e-9:
                new = (c.ids[item], int(starts[w[i]]), size + c.k - 1, float(both[i] / c.n), found[int(w[i])])
                key = (d, (c.m, item))
                if key not in best or (-new[3], new[1]) < (-best[key][3], best[key][1]):
                    best[key] = new


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS, prints: int = PRINTS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, distance: the best window of every matching pair."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for index in _indexes(benchmark, block_items, block_chars, k, threshold, radius, prints):

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids = batch["doc_id"].tolist()
                found = [(ids[d], *rest) for d, *rest in _matches(index.value, batch["text"])]
                yield pd.DataFrame(found, columns=["doc_id", "item", "start_word", "n_words", "similarity", "distance"])

        part = spread(docs.select("doc_id", "text")).mapInPandas(tidy(run), f"doc_id {kind}, item string, start_word long, n_words long, similarity double, distance int")
        out = part if out is None else out.unionByName(part)
    items = benchmark.where("text is not null").select("item_id", F.sha2("text", 256).alias("item"))
    return out.join(items, "item").select("doc_id", "item_id", "start_word", "n_words", "similarity", "distance")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS, prints: int = PRINTS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that match an item."""
    out = docs
    for index in _indexes(benchmark, block_items, block_chars, k, threshold, radius, prints):

        def make(index=index):
            def step(texts: list) -> tuple:
                hit = {d for d, *_ in _matches(index.value, texts)}
                return [i not in hit for i in range(len(texts))], None

            return step

        out = carry(out, make)
    return out


def _indexes(benchmark: DataFrame, block_items: int, block_chars: int, *limits):
    """A broadcast index of each block of the benchmark's distinct texts, by their sha-256; at least one, maybe empty."""
    texts = benchmark.where("text is not null").select("text").distinct()
    n, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // block_items), -(-chars // block_chars))
    for b in range(passes):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == b).select(F.sha2("text", 256), "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in rows], *limits))


def _matches(index: Index, texts) -> list[tuple]:
    texts, out = list(texts), []
    for a, b in chunks(texts):
        per_doc = [normalised(t) for t in texts[a:b]]
        ends = np.cumsum([len(x) for x in per_doc]).astype(np.int64)
        h = hash_words([w for x in per_doc for w in x])
        del per_doc
        out += [(a + d, *rest) for d, *rest in index.matches(h, ends)]
    return out


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
