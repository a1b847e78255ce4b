"""Identifier tokens, their co-occurrence within a few lines, positive PMI neighbours, and query expansion from them."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread
from .index import unique_ids
from .lines import split_lines

#: Tokens that are left out (fixed values).
STOPWORDS = [
    "the", "and", "but", "not", "you", "are", "with", "this", "that", "from", "into", "off", "to", "of", "in", "is", "it", "be",
    "as", "on", "by", "or", "an", "at", "so", "we", "he", "she", "his", "her", "has", "was", "any", "all", "let", "var", "def",
    "else", "then", "do", "end", "true", "false", "null", "nil", "none", "void",
]
WINDOW, MIN_PAIR, MIN_TOKEN, KEEP, EXPAND = 5, 15, 10, 10, 6


def tokens_of(line: Column) -> Column:
    """Lower-cased pieces of identifiers: cut at other characters, before a capital after a small letter, and before the last capital
    of several when a small letter follows. Pieces of one byte, stop words, numbers and leaked \\u escapes are left out."""
    cut = F.regexp_replace(line, r"(\p{Ll})(\p{Lu})", "$1 $2")
    cut = F.regexp_replace(cut, r"([\p{Lu}\p{N}]{2,})(\p{Lu}\p{Ll})", "$1 $2")
    pieces = F.split(cut, r"[^\p{L}\p{N}]+")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    low = F.transform(F.filter(pieces, lambda x: F.octet_length(x) >= 2), F.lower)
    return F.filter(low, lambda x: ~F.array_contains(stop, x) & ~F.rlike(x, F.lit("^([0-9]+$|u[0-9a-f]{4})")))


def line_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, k, tokens: the lines with tokens, numbered from 1 within each text."""
    x = split_lines(docs.select("doc_id", "text")).withColumn("tokens", tokens_of(F.col("line"))).where(F.size("tokens") > 0)
    return x.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).alias("k"), "tokens")


def token_counts(docs: DataFrame) -> DataFrame:
    each = split_lines(docs.select("doc_id", "text")).select(F.explode(tokens_of(F.col("line"))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n"))


def _by_line(docs: DataFrame) -> DataFrame:
    x = line_tokens(docs).select("doc_id", "k", F.explode("tokens").alias("token"))
    return x.groupBy("doc_id", "k", "token").agg(F.count("*").alias("c"))


def total_pairs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row, pairs: the sum of pair_counts without its join: all occurrence pairs by line lengths, less those of equal tokens."""
    x = _by_line(docs)
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(-window, -1)
    lines = x.groupBy("doc_id", "k").agg(F.sum("c").alias("n"))
    every = lines.select((F.col("n") * F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n") * (F.col("n") - 1) / 2).alias("p"))
    # of one token, lines at most `window` apart
    same = Window.partitionBy("doc_id", "token").orderBy("k").rangeBetween(-window, -1)
    equal = x.select((F.col("c") * F.coalesce(F.sum("c").over(same), F.lit(0)) + F.col("c") * (F.col("c") - 1) / 2).alias("p"))
    a = every.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("a"))
    b = equal.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("b"))
    return a.crossJoin(b).select((F.col("a") - F.col("b")).cast("long").alias("pairs"))  # one row each


#: Tokens by rank of frequency that have 16-bit numbers; a row of counts is an array of them.
COMMON = 1 << 16
#: Tokens of texts that a task holds at once (2 bytes each, 4 where they are not common), elements that it counts at once, and the
#: least work of a task in elements.
BLOCK, CHUNK, WORK = 1 << 27, 1 << 19, 1 << 29
#: For all pairs: tokens that so few stand near are counted together, by sorting; the cost of a pair that is given and of an occurrence
#: whose neighbours are looked up, in elements; the cost of a task; occurrences in a band, and a quarter of it those of a task's own tokens.
PART, ROW, FIND, ROWS_WORK, ROWS_BLOCK = 4096, 200, 50, 1 << 32, 1 << 24


def _token_lines(docs: DataFrame) -> DataFrame:
    """lines: of each text its lines, each an array of tokens. Rows of one doc_id are one text: their lines of one number are one line."""
    each = spread(docs.select("doc_id", "text")).select("doc_id", F.transform(F.split("text", "\n", -1), tokens_of).alias("lines"))
    if not unique_ids(docs):
        longest = F.array_max(F.transform("all", F.size))
        line = lambda i: F.flatten(F.transform("all", lambda x: F.coalesce(F.get(x, i), F.array().cast("array<string>"))))
        each = each.groupBy("doc_id").agg(F.collect_list("lines").alias("all"))
        each = each.select(F.when(F.size("all") > 0, F.transform(F.sequence(F.lit(0), longest - 1), line)).alias("lines"))
    return each.select(F.filter("lines", lambda x: F.size(x) > 0).alias("lines"))


def _kept(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder, which all machines share."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lodestrata-"))
    return df.checkpoint(eager=True)


def _batches(docs: DataFrame, window: int) -> DataFrame:
    """A row a batch of texts: names (its tokens), n (how often each), near (how many tokens stand near each), ids (of each token, by
    line), sizes (of lines), docs (lines of each text), pairs (of all tokens)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _Lines(batch.column(0), window)
            of = batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            n = np.bincount(x.ids, minlength=len(x.names))
            near = np.bincount(x.ids, (x.start[x.high] - x.start[x.low])[x.line], len(x.names)).astype(np.int64)
            arrays = [a.astype(np.int32).tobytes() for a in (x.ids, np.diff(x.start), of)]
            yield pa.RecordBatch.from_pydict({"names": pa.array([x.names.cast(pa.string()).to_pylist()], pa.list_(pa.string())), "n": pa.array([n], pa.list_(pa.int64())), "near": pa.array([near], pa.list_(pa.int64())), **{k: pa.array([v], pa.binary()) for k, v in zip(("ids", "sizes", "docs"), arrays, strict=True)}, "pairs": pa.array([x.pairs()])})

    return _token_lines(docs).mapInArrow(run, "names array<string>, n array<long>, near array<long>, ids binary, sizes binary, docs binary, pairs long")


def _coded(batches: DataFrame, names) -> DataFrame:
    """common, rare: numbers (places in the broadcast names) of the tokens that are there, by line, those from COMMON on apart; ofc, ofr:
    how many of both in each line; docs as in batches."""

    def run(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in rows:
            for row in range(len(batch)):
                x = {k: np.frombuffer(batch.column(k)[row].as_py(), np.int32) for k in ("ids", "sizes", "docs")}
                number = pc.index_in(batch.column("names")[row].values.cast(pa.string()), value_set=names.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
                ids, line = number[x["ids"]] if len(number) else x["ids"], np.repeat(np.arange(len(x["sizes"])), x["sizes"])
                common, rare = (ids >= 0) & (ids < COMMON), ids >= COMMON
                of = [np.bincount(line[m], minlength=len(x["sizes"])).astype(np.int32) for m in (common, rare)]
                arrays = {"common": ids[common].astype(np.uint16), "rare": ids[rare], "ofc": of[0], "ofr": of[1], "docs": x["docs"]}
                yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()})

    return batches.select("names", "ids", "sizes", "docs").mapInArrow(run, "common binary, rare binary, ofc binary, ofr binary, docs binary")


class _Block:
    """Some coded texts. rows(): of each token in a range what stands near it."""

    def __init__(self, parts: list[dict], window: int, chunk: int):
        self.chunk = chunk
        self.ids = [np.concatenate([x.pop(k) for x in parts]) for k in ("common", "rare")]
        self.start = [np.concatenate([[0], np.cumsum(np.concatenate([x[k] for x in parts]), dtype=np.int64)]) for k in ("ofc", "ofr")]
        of = np.concatenate([x["docs"] for x in parts])
        end, k = np.cumsum(of, dtype=np.int64), np.arange(int(of.sum()))
        self.low, self.high = np.maximum(k - window, np.repeat(end - of, of)), np.minimum(k + window + 1, np.repeat(end, of))

    def _near(self, kind: int, lines: np.ndarray):
        """Arrays of the tokens near the lines, a line given twice counting twice; each of about a chunk of elements."""
        a, b, ids = self.start[kind][self.low[lines]], self.start[kind][self.high[lines]], self.ids[kind]
        cut = [0, *(np.flatnonzero(np.diff(np.cumsum(b - a) // self.chunk)) + 1).tolist(), len(lines)]
        a, b = a.tolist(), b.tolist()
        for i, j in zip(cut, cut[1:]):
            if i < j:
                yield np.concatenate([ids[u:v] for u, v in zip(a[i:j], b[i:j])])

    def _counts(self, lines: np.ndarray, width: int) -> np.ndarray:
        """By common token: how often near the lines."""
        out, start, ids = np.zeros(width, np.int64), self.start[0], self.ids[0]
        if int((start[self.high[lines]] - start[self.low[lines]]).sum()) <= 2 * len(ids):
            for x in self._near(0, lines):
                out += np.bincount(x, minlength=width)
            return out
        # each line once, by the number of lines that it is near to
        size = len(self.low) + 1
        weight = np.cumsum(np.bincount(self.low[lines], minlength=size) - np.bincount(self.high[lines], minlength=size))[:-1]
        total = np.zeros(width)
        for i in range(0, len(weight), 1 << 14):
            j = min(i + (1 << 14), len(weight))
            total += np.bincount(ids[start[i] : start[j]], weights=np.repeat(weight[i:j], np.diff(start[i : j + 1])), minlength=width)
        return total.astype(np.int64)

    def rows(self, first: int, last: int, common: int, width: int, least: int):
        """token, near, n: common tokens that stand near it `least` times or more, and all such tokens near one that is not common."""
        for kind, lo, hi in ((0, first, min(last, common)), (1, max(first, common), last)):
            if lo >= hi:
                continue
            at = np.flatnonzero((self.ids[kind] >= lo) & (self.ids[kind] <= hi - 1))
            own = self.ids[kind][at]
            order = np.argsort(own, kind="stable")
            lines = np.searchsorted(self.start[kind], at[order], "right") - 1
            bounds = np.searchsorted(own[order], np.arange(lo, hi + 1))
            for token, i, j in zip(range(lo, hi), bounds.tolist(), bounds[1:].tolist()):
                if i == j:
                    continue
                counts = self._counts(lines[i:j], width)
                near = np.flatnonzero(counts >= least)
                n = counts[near]
                if kind:
                    more = np.sort(np.concatenate([*self._near(1, lines[i:j])]))
                    edge = np.flatnonzero(np.concatenate([[True], more[1:] != more[:-1], [True]]))
                    often = np.diff(edge)
                    some = often >= least
                    near, n = np.concatenate([near, more[edge[:-1]][some]]), np.concatenate([n, often[some]])
                other = near != token
                yield token, near[other], n[other]


def _together(none: DataFrame, each: list[DataFrame]) -> DataFrame:
    """A union whose parts are tasks of their own. Spark runs a union of single partitions alone as one task, so one part is not: it has
    no rows, which the plan can't know."""
    each = [none, *each]
    while len(each) > 1:
        each = [reduce(DataFrame.union, each[i : i + 2]) for i in range(0, len(each), 2)]
    return each[0]


def _banded(batches: DataFrame, names, edges: np.ndarray) -> DataFrame:
    """A row a batch of texts and band of tokens that it holds: ids (of the tokens in the band, by line), sizes (how many in each line),
    docs (lines of each text). Numbers of tokens are places in the broadcast names; a band has those from one edge to the next, and ids
    count from its first. Kept in the checkpoint folder by band, so that a task reads the bands that it needs."""

    def run(rows):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for batch in rows:
            for row in range(len(batch)):
                x = {k: np.frombuffer(batch.column(k)[row].as_py(), np.int32) for k in ("ids", "sizes", "docs")}
                number = pc.index_in(batch.column("names")[row].values.cast(pa.string()), value_set=names.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
                ids, line = number[x["ids"]] if len(number) else x["ids"], np.repeat(np.arange(len(x["sizes"]), dtype=np.int32), x["sizes"])
                at = np.flatnonzero(ids >= 0)
                band = (np.searchsorted(edges, ids[at], "right") - 1).astype(np.min_scalar_type(len(edges)))
                at = at[np.argsort(band, kind="stable")]
                ends = np.cumsum(np.bincount(band, minlength=len(edges) - 1))
                for k, (i, j) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                    if i < j:
                        own = (ids[at[i:j]] - edges[k]).astype(_kind(edges, k))
                        of = np.bincount(line[at[i:j]], minlength=len(x["sizes"]))
                        of = of.astype(np.min_scalar_type(int(of.max())))
                        yield pa.RecordBatch.from_pydict({"band": pa.array([k], pa.int32()), "batch": pa.array([serial]), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("ids", own), ("sizes", of), ("docs", x["docs"]))}})
                serial += 1

    schema = "band int, batch long, ids binary, sizes binary, docs binary"
    coded, spark = batches.select("names", "ids", "sizes", "docs").mapInArrow(run, schema), batches.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/bands-{uuid.uuid4().hex}"
    coded.write.partitionBy("band").parquet(path)
    return spark.read.schema("batch long, ids binary, sizes binary, docs binary, band int").parquet(path)


def _kind(edges: np.ndarray, band: int):
    return np.uint16 if edges[band + 1] - edges[band] <= 1 << 16 else np.int32


class _Near:
    """ids: the tokens of a band, by line. own, low, high: of each occurrence of some tokens its token, and from where to where in ids
    the tokens stand that are near it; in order of tokens, and of places for each."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, chunk: int):
        self.ids, self.width, self.chunk = ids, width, chunk
        at = np.flatnonzero(low < high)
        at = at[np.argsort(own[at], kind="stable")]
        self.own, self.low, self.high = own[at], low[at], high[at]

    def _found(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The tokens near some occurrences, one given for each that it is near to."""
        size = (high - low).astype(np.int64)
        end = np.cumsum(size)
        if end[-1] > 32 * len(size):
            return np.concatenate([self.ids[u:v] for u, v in zip(low.tolist(), high.tolist())])
        return self.ids[np.repeat(low - (end - size), size) + np.arange(end[-1])]

    def _counts(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """By token of the band: how often near some occurrences of one token."""
        end = np.cumsum(high - low, dtype=np.int64)
        if end[-1] <= 2 * len(self.ids):
            out = np.zeros(self.width, np.int64)
            cut = [0, *(np.flatnonzero(np.diff(end // self.chunk)) + 1).tolist(), len(low)]
            for i, j in zip(cut, cut[1:]):
                if i < j:
                    out += np.bincount(self._found(low[i:j], high[i:j]), minlength=self.width)
            return out
        # each place once, by the number of occurrences that it is near to
        out, near, step = np.zeros(self.width), 0, max(self.chunk, 1 << 14)
        for i in range(0, len(self.ids), step):
            x = self.ids[i : i + step]
            (a, b), (c, d) = (np.searchsorted(y, [i, i + len(x)]) for y in (low, high))
            weight = near + np.cumsum(np.bincount(low[a:b] - i, minlength=len(x)) - np.bincount(high[c:d] - i, minlength=len(x)))
            out += np.bincount(x, weights=weight, minlength=self.width)
            near = int(weight[-1])
        return out.astype(np.int64)

    def pairs(self, first: int, part: int):
        """token, near, n, as arrays: of each own token the tokens of the band that stand near it and have a lower number. first: the
        number of own token 0, counted from the band's first."""
        tokens = int(self.own[-1]) + 1 if len(self.own) else 0
        bounds = np.concatenate([[0], np.cumsum(np.bincount(self.own, minlength=tokens))])
        cost = np.diff(np.concatenate([[0], np.cumsum(self.high - self.low, dtype=np.int64)])[bounds])
        few = cost <= max(part, min(self.width >> 4, self.chunk))
        for token in np.flatnonzero(~few).tolist():
            i, j = bounds[token], bounds[token + 1]
            counts = self._counts(self.low[i:j], self.high[i:j])[: first + token]
            near = np.flatnonzero(counts)
            yield np.full(len(near), token), near, counts[near]
        at = np.flatnonzero(few[self.own])
        own, low, high = self.own[at], self.low[at], self.high[at]
        bits = max(self.width - 1, 1).bit_length()
        group = np.cumsum(np.where(few, cost, 0)) // self.chunk
        cut = [0, *(np.flatnonzero(np.diff(group[own]) | np.diff(own >> max(32 - bits, 0))) + 1).tolist(), len(own)]
        for i, j in zip(cut, cut[1:]):
            if i < j:
                yield self._sorted(own[i:j], low[i:j], high[i:j], first, bits)

    def _sorted(self, own: np.ndarray, low: np.ndarray, high: np.ndarray, first: int, bits: int):
        """The same of some tokens, by sorting."""
        base, kind = int(own[0]), np.uint32 if bits <= 32 else np.int64
        near, token = self._found(low, high), np.repeat(own, high - low)
        if first + base < self.width:
            before = near < token + first
            near, token = near[before], token[before]
        key = (token - base).astype(kind) << kind(bits) | near.astype(kind)
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        key = key[edge[:-1]]
        return (key >> kind(bits)).astype(np.int64) + base, (key & kind((1 << bits) - 1)).astype(np.int64), np.diff(edge)


def _band_pairs(coded: DataFrame, names, places, edges: np.ndarray, band: int, first: int, last: int, window: int) -> DataFrame:
    """a, b, n: the pairs of a range of tokens with those of a band that have lower numbers. One task, which reads the band and those of
    the range."""
    lo, hi = int(edges[band]), int(edges[band + 1])
    own = range(int(np.searchsorted(edges, first, "right")) - 1, int(np.searchsorted(edges, last)))

    def run(rows):
        import pyarrow as pa

        def found():
            """token, low, high of each occurrence of the range's tokens, and the band's tokens, batch by batch."""
            waiting, done, parts = {}, 0, len(own) + (band not in own)
            for batch in rows:
                for row in range(len(batch)):
                    k, serial = batch.column("band")[row].as_py(), batch.column("batch")[row].as_py()
                    docs = np.frombuffer(batch.column("docs")[row].as_py(), np.int32)
                    ids, sizes = np.frombuffer(batch.column("ids")[row].as_py(), _kind(edges, k)), batch.column("sizes")[row].as_py()
                    start = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, f"u{len(sizes) // int(docs.sum())}"), dtype=np.int64)])
                    x = waiting.setdefault(serial, {"own": [], "near": None})
                    if k in own:
                        token = ids.astype(np.int64) + (int(edges[k]) - first)
                        at = np.flatnonzero((token >= 0) & (token < last - first))
                        x["own"].append((token[at].astype(np.int32), np.searchsorted(start, at, "right") - 1))
                    if k == band:
                        x["near"] = ids, start, docs
            for serial in sorted(waiting):
                x = waiting.pop(serial)
                if x["near"] is None or not x["own"]:
                    continue
                ids, start, docs = x["near"]
                token, line = (np.concatenate(c) for c in zip(*x["own"], strict=True))
                end = np.cumsum(docs, dtype=np.int64)
                text = np.searchsorted(end, line, "right")
                low, high = np.maximum(line - window, (end - docs)[text]), np.minimum(line + window + 1, end[text])
                kind = np.int32 if done + len(ids) < 1 << 31 else np.int64
                yield ids, token, *((start[y] + done).astype(kind) for y in (low, high))
                done += len(ids)

        parts = [list(x) for x in zip(*found(), strict=True)]
        if not parts:
            return
        ids, token, low, high = (np.concatenate(parts.pop(0)) for _ in range(4))
        block = _Near(ids, token, low, high, hi - lo, CHUNK)
        del token, low, high
        words = pa.concat_arrays([names.value.slice(first, last - first), names.value.slice(lo, hi - lo)])
        one, two = places.value[first:last], places.value[lo:hi]

        def batches():
            parts, waiting = [], 0
            for x in block.pairs(first - lo, PART):
                parts.append(x)
                waiting += len(x[0])
                if waiting >= 1 << 16:
                    yield [np.concatenate(c) for c in zip(*parts, strict=True)]
                    parts, waiting = [], 0
            if waiting:
                yield [np.concatenate(c) for c in zip(*parts, strict=True)]

        for token, near, n in batches():
            swap = one[token] > two[near]
            near += last - first
            a, b = np.where(swap, near, token), np.where(swap, token, near)
            for i in range(0, len(n), 1 << 16):
                j = i + (1 << 16)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(a[i:j])), words.take(pa.array(b[i:j])), pa.array(n[i:j])], ["a", "b", "n"])

    return coded.where(F.col("band").isin(*{band, *own})).coalesce(1).mapInArrow(run, "a string, b string, n long")


def pair_counts(docs: DataFrame, window: int = WINDOW, min_token: int = 1) -> DataFrame:
    """a, b, n: how often two different tokens (a < b) stand in one line or within `window` token-bearing lines, by occurrences.

    Tokens below min_token occurrences in all are left out, not their lines. Texts are tokenised once and coded, tokens numbered by
    frequency and cut into bands of about as many occurrences; a task counts what of one band stands near each of its tokens and has a
    lower number, from the texts' tokens of those bands alone, so no pair is joined or shuffled and each is given by one task. The tokens
    are broadcast.
    """
    import pyarrow.compute as pc

    batches = _kept(_batches(docs.where("doc_id is not null"), window))
    each = batches.select(F.explode(F.arrays_zip("names", "n", "near")).alias("x")).groupBy(F.col("x.names").alias("token")).agg(F.sum("x.n").alias("n"), F.sum("x.near").alias("near"))
    frequent = each.where(F.col("n") >= min_token).toArrow().combine_chunks().sort_by([("n", "descending"), ("token", "ascending")])
    words, counts, near, sc = frequent["token"].combine_chunks(), frequent["n"].to_numpy(), frequent["near"].to_numpy(), docs.sparkSession.sparkContext
    place = np.empty(len(words), np.int32)
    place[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words), dtype=np.int32)
    names, places = sc.broadcast(words), sc.broadcast(place)
    before = np.concatenate([[0], np.cumsum(counts)])
    mass, bands = max(int(before[-1]), 1), -(-int(before[-1]) // ROWS_BLOCK)
    edges = np.unique([0, *np.searchsorted(before, mass * np.arange(1, bands) / max(bands, 1)).tolist(), len(counts)])
    works = []
    for lo, hi in zip(edges, edges[1:]):
        # elements counted for a token, and pairs given: no more than tokens of the band that have lower numbers
        share = np.minimum(before[lo:-1], before[hi]) - before[lo]
        some = near[lo:] * (share / mass)
        rows = np.minimum(some**0.9, np.minimum(np.arange(len(counts) - lo), hi - lo))
        works.append(4 * np.minimum(some, 2.0 * (before[hi] - before[lo])) + ROW * rows + FIND * counts[lo:] + 100)
    coded, total = _banded(batches, names, edges), sum(float(x.sum()) for x in works)
    # a small input is dealt to all cores, where that is worth while
    aim = min(ROWS_WORK, total / max(1, min(4 * sc.defaultParallelism, int(total) >> 26)))
    tasks = []
    for band, work in enumerate(works):
        lo = int(edges[band])
        part = np.cumsum(np.maximum(work / aim, counts[lo:] * (4 / ROWS_BLOCK))).astype(np.int64)
        ends = [lo, *(np.flatnonzero(np.diff(part)) + lo + 1).tolist(), len(counts)]
        tasks += [_band_pairs(coded, names, places, edges, band, a, b, window) for a, b in zip(ends, ends[1:])]
    none = coded.where("band < 0").select(F.hex("ids").alias("a"), F.hex("ids").alias("b"), F.col("batch").alias("n"))
    return _together(none, tasks)


def _best(token: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the rows of highest score of each token: `keep`, and all that rounding could put among them."""
    order = np.lexsort((-score, token))
    t, s = token[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(t)))
    return order[s >= np.repeat(s[first + np.minimum(keep, size) - 1], size) - 1e-6]


def _candidates(coded: DataFrame, names, counts, first: int, last: int, blocks: int, tokens: int, pairs: int, window: int, min_pair: int, keep: int) -> DataFrame:
    """token, nb, n, ca, cb: what can be among the `keep` best neighbours, from the rows of counts of a range of tokens. One task, which
    reads all texts; it gives both directions of a pair of a common and another token, so common tokens can come from several tasks."""

    def run(rows):
        import pyarrow as pa

        n_of, width = counts.value, min(COMMON, len(counts.value))
        sums: dict[int, list] = {}
        found, back, waiting = [], [], 0

        def score(a, b, n):
            share = np.maximum(n_of[a] / tokens * (n_of[b] / tokens), 1e-12)
            pmi = np.log(n / max(pairs, 1) / share)
            return pmi, pmi * np.log(n + 1.0)

        def joined(parts):
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        def chosen(token, near, n):
            nonlocal back, waiting
            near, n = near[n >= min_pair], n[n >= min_pair]
            pmi, s = score(token, near, n)
            some = pmi > -1e-9
            near, n, s = near[some], n[some], s[some]
            own = np.full(len(near), token)
            i = _best(own, s, keep) if len(near) > keep else np.arange(len(near))
            found.append((own[i], near[i], n[i]))
            if token >= COMMON:
                r = near < COMMON
                back.append((near[r], own[r], n[r], s[r]))
                waiting += int(r.sum())
                if waiting > 1 << 22:
                    x = joined(back)
                    i = _best(x[0], x[3], keep)
                    back, waiting = [tuple(c[i] for c in x)], 0

        def count(parts):
            for token, near, n in _Block(parts, window, CHUNK).rows(first, last, COMMON, width, min_pair if blocks == 1 else 1):
                if blocks == 1:
                    chosen(token, near, n)
                else:
                    sums.setdefault(token, []).append((near.astype(np.int32), n))

        parts, held = [], 0
        for batch in rows:
            for row in range(len(batch)):
                x = {k: np.frombuffer(batch.column(k)[row].as_py(), np.uint16 if k == "common" else np.int32) for k in batch.schema.names}
                if blocks > 1 and parts and held + len(x["common"]) + len(x["rare"]) > BLOCK:
                    count(parts)
                    parts, held = [], 0
                parts.append(x)
                held += len(x["common"]) + len(x["rare"])
        if parts:
            count(parts)
        for token in list(sums):
            near, n = joined(sums.pop(token))
            near, at = np.unique(near, return_inverse=True)
            chosen(token, near, np.bincount(at, weights=n).astype(np.int64))
        if back:
            x = joined(back)
            i = _best(x[0], x[3], keep)
            found.append((x[0][i], x[1][i], x[2][i]))
        if found:
            a, b, n = joined(found)
            for i in range(0, len(a), 1 << 16):
                u, v = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([names.value.take(pa.array(u)), names.value.take(pa.array(v)), pa.array(n[i : i + (1 << 16)]), pa.array(n_of[u]), pa.array(n_of[v])], ["token", "nb", "n", "ca", "cb"])

    return coded.coalesce(1).mapInArrow(run, "token string, nb string, n long, ca long, cb long")


def ppmi_neighbours(docs: DataFrame, window: int = WINDOW, min_pair: int = MIN_PAIR, min_token: int = MIN_TOKEN, keep: int = KEEP) -> DataFrame:
    """token, nb, score, rank: the neighbours of highest PMI * ln(count + 1), PMI > 0, of each token.

    Texts are tokenised once and coded; a task counts all that stands near each of its tokens, from all coded texts, so no pair is
    shuffled but the best of each token. The tokens of min_token occurrences are broadcast.
    """
    batches = _kept(_batches(docs, window))
    total = batches.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0)).alias("tokens")).first()
    each = batches.select(F.explode(F.arrays_zip("names", "n")).alias("x")).groupBy(F.col("x.names").alias("token")).agg(F.sum("x.n").alias("n"))
    frequent = each.where(F.col("n") >= min_token).toArrow().combine_chunks().sort_by([("n", "descending"), ("token", "ascending")])
    counts, sc = frequent["n"].to_numpy(), docs.sparkSession.sparkContext
    names, n = sc.broadcast(frequent["token"].combine_chunks()), sc.broadcast(counts)
    # elements of a row of counts, as far as a mean line tells; a row has some work of its own
    mass = int(counts.sum())
    work = np.cumsum(np.minimum(counts * (2 * total["pairs"] / max(total["tokens"], 1)), 2.0 * mass) + 20_000)
    coded, blocks = _kept(_coded(batches, names)), -(-mass // BLOCK) or 1
    tasks = max(1, min(len(counts), max(int(work[-1] / WORK), 24 * blocks))) if len(counts) else 1
    ends = [0, *np.searchsorted(work, work[-1] * np.arange(1, tasks) / tasks).tolist(), len(counts)] if len(counts) else [0, 0]
    ranges = [(a, b) for a, b in zip(ends, ends[1:]) if a < b] or [(0, 0)]
    none = coded.where("octet_length(docs) < 0").select(*[F.hex("docs").alias(c) for c in ("token", "nb")], *[F.octet_length("docs").cast("long").alias(c) for c in ("n", "ca", "cb")])
    p = _together(none, [_candidates(coded, names, n, a, b, blocks, total["tokens"], total["pairs"], window, min_pair, keep) for a, b in ranges])
    pa, pb = F.col("ca").cast("double") / F.lit(total["tokens"]), F.col("cb").cast("double") / F.lit(total["tokens"])
    pmi = F.log((F.col("n") / F.lit(max(total["pairs"], 1))) / F.greatest(pa * pb, F.lit(1e-12)))
    p = p.withColumn("pmi", pmi).where("pmi > 0").select("token", "nb", F.round(F.col("pmi") * F.log(F.col("n").cast("double") + 1), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "nb"))
    return p.withColumn("rank", rank).where(F.col("rank") <= keep)


class _Lines:
    """Texts of a batch, each a list of token-bearing lines, as arrays: ids (by token), names, line (by token), start (first token by
    line, and the end), low and high (first line, and the one after the last, within `window` lines in the text, by line)."""

    def __init__(self, column, window: int):
        of, tokens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten()
        size = tokens.value_lengths().to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        self.ids, self.names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.line = np.repeat(np.arange(len(size)), size)
        end = np.cumsum(of)
        text = np.repeat(np.arange(len(of)), of)
        k = np.arange(len(size))
        self.low, self.high = np.maximum(k - window, (end - of)[text]), np.minimum(k + window + 1, end[text])
        # numbers of lines in which different texts are out of reach
        self.place = k + text * (window + 1)
        self.window = window

    def pairs(self) -> int:
        """Pairs of different tokens in one line or within the window."""
        size = np.diff(self.start)
        every = int((size * (self.start[:-1] - self.start[self.low])).sum()) + int((size * (size - 1) // 2).sum())
        if not len(self.ids):
            return 0
        far = int(self.place[-1]) + 2 * self.window + 2
        key = np.sort(self.ids * far + self.place[self.line] + self.window)
        return every - int((np.arange(len(key)) - np.searchsorted(key, key - self.window)).sum())

    def near(self, word: str) -> np.ndarray:
        """By token id: occurrence pairs with a word."""
        import pyarrow.compute as pc

        i = pc.index(self.names, word).as_py()
        out = np.zeros(len(self.names), dtype=np.int64)
        if i >= 0:
            at = self.line[self.ids == i]
            for a, b in zip(self.start[self.low[at]].tolist(), self.start[self.high[at]].tolist(), strict=True):
                np.add.at(out, self.ids[a:b], 1)
            out[i] = 0
        return out


def neighbour_counts(docs: DataFrame, word: str, window: int = WINDOW) -> DataFrame:
    """token, n (occurrences), near (pairs with the word), pairs (all pairs; in the row of no token), from one pass over whole texts.

    Counts are summed by token in each batch of texts, so neither lines nor pairs are shuffled.
    """

    def run(batches):
        import pyarrow as pa

        names = ["token", "n", "near", "pairs"]
        for batch in batches:
            x = _Lines(batch.column(0), window)
            n = np.bincount(x.ids, minlength=len(x.names))
            zero = np.zeros(len(n), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([x.names.cast(pa.string()), pa.array(n), pa.array(x.near(word)), pa.array(zero)], names)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0]), pa.array([0]), pa.array([x.pairs()])], names)

    lines = F.filter(F.transform(F.split("text", "\n", -1), tokens_of), lambda x: F.size(x) > 0)
    each = spread(docs.select("doc_id", "text")).select(lines.alias("lines")).mapInArrow(run, "token string, n long, near long, pairs long")
    return each.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "near", "pairs")])


def neighbours_of(docs: DataFrame, word: str, limit: int = EXPAND, window: int = WINDOW, min_pair: int = MIN_PAIR, min_token: int = MIN_TOKEN, keep: int = KEEP) -> list[str]:
    """expansion(ppmi_neighbours(docs), word, limit), for which only the pairs of that word are counted."""
    word = word.lower()
    counts = neighbour_counts(docs, word, window).persist()  # a row a token
    try:
        total = counts.agg(F.sum("n").alias("tokens"), F.sum("pairs").alias("pairs"), F.coalesce(F.sum(F.when(F.col("token") == word, F.col("n"))), F.lit(0)).alias("own")).first()
        if total["own"] < min_token:
            return []
        pa, pb = F.lit(total["own"]).cast("double") / F.lit(total["tokens"]), F.col("n").cast("double") / F.lit(total["tokens"])
        pmi = F.log((F.col("near") / F.lit(max(total["pairs"], 1))) / F.greatest(pa * pb, F.lit(1e-12)))
        p = counts.where((F.col("near") >= min_pair) & (F.col("n") >= min_token)).withColumn("pmi", pmi).where("pmi > 0")
        p = p.withColumn("score", F.round(F.col("pmi") * F.log(F.col("near").cast("double") + 1), 9))
        return [r[0] for r in p.orderBy(F.desc("score"), "token").select("token").limit(min(limit, keep)).collect()]
    finally:
        counts.unpersist()


def expansion(neighbours: DataFrame, word: str, limit: int = EXPAND) -> list[str]:
    """The words that a query word is widened by: at most `limit` rows come to the driver."""
    rows = neighbours.where((F.col("token") == F.lit(word.lower())) & (F.col("rank") <= limit)).orderBy("rank").select("nb").collect()
    return [r[0] for r in rows]
