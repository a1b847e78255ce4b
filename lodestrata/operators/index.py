"""N-gram postings with positional masks: built, maintained by overlays and tombstones, and used to prune candidates before a match.

Keys are the grams themselves (three characters, and two for the pair table), so no hash can collide. The plain scan is the meaning
of a search; the index must give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regexes import leading_flags, literals
from ..sources.tables import spread
from . import search as S
from .lines import split_lines

LOC_BITS, ZONE_BITS = 8, 31
BYPASS_PERCENT = 85
MASKED_LITERALS = 4
OVERLAY_DOCS, COMPACT_DOCS, COMPACT_SHARE = 100, 1000, 0.10


def fold(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams_of(docs: DataFrame, n: int, folded: bool = False) -> DataFrame:
    """doc_id, gram, pos (in the line, from 0), next (the character after, or empty): all grams of all lines.

    Lines are taken apart into arrays of characters: substring() by position walks a string from its start each time.
    """
    lines = split_lines(docs.select("doc_id", "text"))
    line = fold(F.col("line")) if folded else F.col("line")
    # split(x, '') gives one element a character
    x = lines.select("doc_id", F.split(line, "").alias("c")).where(F.size("c") >= n)
    pairs = F.zip_with(_grams(F.col("c"), n), F.slice("c", F.lit(n + 1), F.size("c")), lambda g, nx: F.struct(g.alias("gram"), nx.alias("next")))
    x = x.select("doc_id", F.posexplode(pairs).alias("pos", "g"))
    return x.select("doc_id", "g.gram", "pos", F.coalesce("g.next", F.lit("")).alias("next")).where("gram is not null")


def _grams(chars: Column, n: int) -> Column:
    """The n-grams of an array of at least n characters, in order."""
    shift = lambda i: F.slice(chars, F.lit(i + 1), F.size(chars) - (n - 1))
    gram = shift(0)
    for i in range(1, n):
        gram = F.zip_with(gram, shift(i), lambda a, b: F.concat(a, b))
    return gram


def document_frequency(docs: DataFrame, n: int = 3) -> DataFrame:
    """gram, df. Grams are made distinct within each row, so only counts by gram are shuffled."""
    chars = F.transform(F.split("text", "\n", -1), lambda line: F.split(line, ""))
    per_line = F.transform(F.filter(chars, lambda c: F.size(c) >= n), lambda c: F.array_distinct(_grams(c, n)))
    each = spread(docs.select("text")).select(F.explode(F.array_distinct(F.flatten(per_line))).alias("gram"))
    return each.groupBy("gram").agg(F.count("*").alias("df"))


def _bit(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]), n + 1)


def postings(docs: DataFrame, n: int = 3, folded: bool = False) -> DataFrame:
    """gram, doc_id, loc_mask (positions modulo 8), next_mask (bloom bit of the next character), zone_mask (positions below 31, bit
    31 for the rest)."""
    g = grams_of(docs, n, folded)
    loc = _bit(F.pmod("pos", F.lit(LOC_BITS)).cast("int"))
    code = F.ascii("next")
    nxt = F.when(F.col("next") != "", _bit(F.pmod(code * 31, F.lit(8)).cast("int"))).otherwise(F.lit(0))
    zone = _bit(F.least("pos", F.lit(ZONE_BITS)).cast("int"))
    out = g.groupBy("gram", "doc_id").agg(F.bit_or(loc).alias("loc_mask"), F.bit_or(nxt.cast("long")).alias("next_mask"), F.bit_or(zone).alias("zone_mask"))
    return out.withMetadata("gram", {"folded": folded, "n": n})


def is_folded(posting: DataFrame) -> bool:
    """Whether the grams are of folded text: kept with the table, through files too."""
    return bool(posting.schema["gram"].metadata.get("folded", False))


def gram_df(posting: DataFrame) -> DataFrame:
    return posting.groupBy("gram").agg(F.count("*").alias("df"))


def idf_weight(df: Column, total: Column) -> Column:
    """Weight of a gram by the share of documents it is in."""
    ratio = df / total
    return F.when(ratio > 0.5, 0.25).when(ratio > 0.2, 0.5).when(ratio < 0.01, 3.0).when(ratio < 0.05, 2.0).otherwise(1.0)


@dataclass(frozen=True)
class Plan:
    """An OR of ANDs of grams; grams None: every document is a candidate."""

    alternatives: tuple[tuple[str, ...], ...] | None
    folded: bool = False
    literals: tuple[str, ...] = ()  # of which a match holds one, where they are few enough to be told apart by masks


def covering(literal: str, n: int = 3) -> tuple[str, ...]:
    """Grams that together cover the literal: every n-th, and the last."""
    at = list(range(0, len(literal) - n + 1, n))
    if at and at[-1] + n < len(literal):
        at.append(len(literal) - n)
    return tuple(dict.fromkeys(literal[i : i + n] for i in at))


def plan(pattern: str, ignore_case: bool = False, n: int = 3, folded: bool | None = None) -> Plan:
    """Grams of which a match must hold all of some alternative; no index for literals shorter than n or across lines.

    folded: whether the postings are of folded text (None: as the search is). A search that ignores case needs such postings; one
    that doesn't can use them too. Flags at the start of the pattern count; any others mean no index.
    """
    rest, ignores = leading_flags(pattern)
    folded = ignore_case or bool(ignores) if folded is None else folded
    if ignores is None or (ignore_case or ignores) and not folded:
        return Plan(None, folded)
    found = literals(rest)
    if not found or any(len(x) < n or "\n" in x for x in found):
        return Plan(None, folded)
    if folded:
        found = [x.translate({c: c + 32 for c in range(65, 91)}) for x in found]
    return Plan(tuple(sorted({covering(x, n) for x in found})), folded, tuple(sorted(set(found))) if len(found) <= MASKED_LITERALS else ())


def candidates(posting: DataFrame, p: Plan) -> DataFrame:
    """doc_id of documents that hold every gram of some alternative: one pass over the postings of the grams asked for.

    The query grams are literals of the plan, so they reach the scan as a pushed-down IN filter.
    """
    if p.alternatives is None:
        return posting.select("doc_id").distinct()
    if not p.alternatives:
        return posting.where("false").select("doc_id")
    wanted = sorted({g for a in p.alternatives for g in a})
    bits = F.element_at(F.create_map(*[x for i, g in enumerate(wanted) for x in (F.lit(g), F.lit(1 << i if i < 62 else 0).cast("long"))]), F.col("gram"))
    if len(wanted) <= 62:
        seen = posting.where(F.col("gram").isin(wanted)).groupBy("doc_id").agg(F.bit_or(bits).alias("seen"))
        test = F.lit(False)
        for a in p.alternatives:
            need = sum(1 << wanted.index(g) for g in set(a))
            test = test | (F.col("seen").bitwiseAND(F.lit(need).cast("long")) == F.lit(need))
        return seen.where(test).select("doc_id")
    seen = posting.where(F.col("gram").isin(wanted)).groupBy("doc_id").agg(F.collect_set("gram").alias("seen"))
    test = F.lit(False)
    for a in p.alternatives:
        test = test | (F.size(F.array_intersect("seen", F.array(*[F.lit(g) for g in set(a)]))) == len(set(a)))
    return seen.where(test).select("doc_id")


def leaf_costs(posting: DataFrame, p: Plan) -> dict[str, int]:
    """How many postings each gram of a plan has (0: none), by one pushed-down count; a plan has a few hundred grams at most."""
    wanted = sorted({g for a in p.alternatives or () for g in a})
    found = {r["gram"]: r["count"] for r in posting.where(F.col("gram").isin(wanted)).groupBy("gram").count().collect()} if wanted else {}
    return {g: found.get(g, 0) for g in wanted}


def cheapest(p: Plan, costs: dict[str, int], total: int, most: int = 3, percent: int = BYPASS_PERCENT) -> Plan:
    """The plan with the `most` rarest grams of each alternative, rarest first: fewer postings to read, and the rarest one bounds the
    candidates anyway. An alternative with a gram that no document has is left out. Where the rarest grams alone would let more than
    `percent` of the documents through, the plain scan is as good: no plan."""
    if p.alternatives is None:
        return p
    kept = tuple(tuple(sorted(set(a), key=lambda g: (costs[g], g))[:most]) for a in p.alternatives if all(costs[g] for g in a))
    if sum(costs[a[0]] for a in kept) * 100 > percent * total:
        return Plan(None, p.folded)
    return Plan(kept, p.folded)


def residual(posting: DataFrame, literal: str, n: int = 3) -> DataFrame:
    """doc_id of documents in which the literal's grams can stand at consistent places: all of them are there, each with the literal's
    next character among those that follow it, and their position masks, turned back by their offsets, have a common bit."""
    first: dict[str, int] = {}
    for i in range(len(literal) - n + 1):
        first.setdefault(literal[i : i + n], i)
    value = lambda pairs: F.element_at(F.create_map(*[x for g, v in pairs for x in (F.lit(g), F.lit(v))]), F.col("gram"))
    rel = value([(g, i % LOC_BITS) for g, i in first.items()])
    # 0: the literal ends with the gram, so anything may follow
    follows = value([(g, 1 << ord(literal[i + n]) * 31 % 8 if i + n < len(literal) else 0) for g, i in first.items()])
    mask = F.col("loc_mask").cast("int")
    turned = mask
    for r in range(1, LOC_BITS):
        turn = (F.shiftright(mask, r)).bitwiseOR(F.shiftleft(mask, LOC_BITS - r)).bitwiseAND(F.lit(255))
        turned = F.when(rel == r, turn).otherwise(turned)
    x = posting.where(F.col("gram").isin(list(first))).where((follows == 0) | (F.col("next_mask").cast("int").bitwiseAND(follows) != 0))
    x = x.select("doc_id", turned.alias("m")).groupBy("doc_id").agg(F.count("*").alias("n"), F.bit_and("m").alias("common"))
    return x.where((F.col("n") == len(first)) & (F.col("common") != 0)).select("doc_id")


def masked(posting: DataFrame, p: Plan, n: int = 3) -> DataFrame:
    """Fewer candidates than the plan's grams alone leave: by the masks, for each of the plan's literals."""
    out = None
    for literal in p.literals:
        part = residual(posting, literal, n)
        out = part if out is None else out.unionByName(part)
    return out.distinct() if len(p.literals) > 1 else out


def search(corpus: DataFrame, posting: DataFrame, o: S.SearchOptions, n: int = 3) -> DataFrame:
    """The rows of search.counts, with documents pruned by the postings first (unless nearly all would stay)."""
    return S.counts(pruned(corpus, posting, o, n), o)


def pruned(corpus: DataFrame, posting: DataFrame, o: S.SearchOptions, n: int = 3, documents: int | None = None) -> DataFrame:
    """The documents that may match, by the postings; all of them where the postings can't tell.

    documents: how many there are, if known. Then the plan's grams are counted first, and a plan that leaves nearly all is not followed.
    """
    if o.expand:
        return corpus
    p = plan(S.search_pattern(o.pattern, o.fixed), o.ignore_case, n, is_folded(posting))
    if documents is not None:
        best = cheapest(p, leaf_costs(posting, p), documents)
        p = Plan(best.alternatives, p.folded, p.literals if best.alternatives else ())
    if p.alternatives is None:
        return corpus
    found = masked(posting, p, n) if p.literals and "next_mask" in posting.columns else candidates(posting, p)
    return corpus.join(found, "doc_id", "left_semi")


def worthwhile(posting: DataFrame, total: int, p: Plan, percent: int = BYPASS_PERCENT) -> bool:
    """False where the plan leaves more than `percent` of the documents: then the plain scan is as good. One count."""
    return p.alternatives is not None and candidates(posting, p).count() * 100 <= percent * total


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (added, changed, deleted) of two snapshots(path, content hash)."""
    a, b = old.select("path", F.col("hash").alias("h1")), new.select("path", F.col("hash").alias("h2"))
    status = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "deleted").when(F.col("h1") != F.col("h2"), "changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def overlay(base: DataFrame, delta: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Live postings: the base without shadowed documents, and the delta's."""
    return base.join(tombstones.select("doc_id"), "doc_id", "left_anti").unionByName(delta).withMetadata("gram", base.schema["gram"].metadata)


def live_candidates(base: DataFrame, delta: DataFrame, tombstones: DataFrame, p: Plan) -> DataFrame:
    """The candidates of overlay(base, delta, tombstones): a document's postings are all in one of the two, so each is asked by itself
    and the base keeps its pushed-down filter."""
    return candidates(base, p).join(tombstones.select("doc_id"), "doc_id", "left_anti").unionByName(candidates(delta, p))


def maintenance(base_docs: int, changed: int, overlay_docs: int) -> str:
    """rebuild, compact or overlay, by how much has changed."""
    if changed > OVERLAY_DOCS:
        return "rebuild"
    return "compact" if overlay_docs > COMPACT_DOCS or overlay_docs > COMPACT_SHARE * base_docs else "overlay"


def publish(spark: SparkSession, posting: DataFrame, folder: str, generation: int) -> str:
    """Writes the postings, clustered by gram, under a folder of that generation, and the pointer to it last."""
    path = f"{folder}/v={generation}"
    posting.repartitionByRange("gram").sortWithinPartitions("gram", "doc_id").write.mode("overwrite").parquet(path)
    spark.createDataFrame([(generation, path)], "generation int, path string").coalesce(1).write.mode("append").json(f"{folder}/_SEAL")
    return path


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The postings that the newest pointer names: a reader sees a whole generation or the one before."""
    seal = spark.read.schema("generation int, path string").json(f"{folder}/_SEAL")
    return spark.read.parquet(seal.orderBy(F.desc("generation")).first()["path"])


def published(spark: SparkSession, docs: DataFrame, folded: bool = False, n: int = 3) -> DataFrame:
    """The postings of docs(doc_id, text), read from files: published once for each state of the files that docs is read from.

    They lie in the warehouse folder, which all executors share, under a name made of the paths, sizes and times of those files, so a
    change of the input is another index. Filters on grams reach the files: postings are sorted by gram.
    """
    import hashlib

    files = docs.select("_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time")).distinct().collect()
    name = hashlib.sha256(repr((sorted(map(tuple, files)), folded, n)).encode()).hexdigest()[:16]
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/postings/{name}"
    try:
        return latest(spark, folder)
    except AnalysisException:  # not there yet
        publish(spark, postings(docs, n, folded), folder, 1)
        return latest(spark, folder)


def stats(posting: DataFrame) -> DataFrame:
    return posting.agg(F.count("*").alias("postings"), F.count_distinct("gram").alias("grams"), F.count_distinct("doc_id").alias("documents"))


def unique_ids(docs: DataFrame) -> bool:
    """Whether no doc_id stands twice; reads and shuffles ids alone."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def pair_weights(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Weights of the pairs of neighbouring code points. kind: by code point 1 for small, 2 for capital letters, 0 for others, 4 for not known
    yet (found here)."""
    new = codes[kind[codes] == 4]
    for c in set(new.tolist()):
        kind[c] = 1 if chr(c).islower() else 2 if chr(c).isupper() else 0
    a, b = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    low = np.uint64(0xFFFFFFFF)
    h = ((a * np.uint64(2654435761) + b * np.uint64(40503)) ^ np.uint64(0x9E3779B9)) & low
    h = ((h ^ (h >> np.uint64(15))) * np.uint64(2246822519)) & low
    w = (h ^ (h >> np.uint64(13))).astype(np.int64)
    k = kind[codes]
    bound = (k[:-1] == 1) & (k[1:] == 2) | (codes[:-1] == 95) | (codes[1:] == 95)  # 95: _
    w[bound] *= 2
    return w


def sparse_intervals(codes: np.ndarray, w: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length in characters and hash of all grams, over pair weights; a weight below 0 ends a line."""
    c = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(w >= 0)
    inside = np.full(len(at), -1, dtype=np.int64)  # largest weight between the ends
    h = c[at] * np.uint64(0xD6E8FEB86659FD93) + c[at + 1]
    starts, lengths, hashes = [], [], []
    for d in range(1, most - 1):
        n = np.searchsorted(at, len(w) - d)
        at, inside, h = at[:n], inside[:n], h[:n]
        end = w[at + d]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + c[at + d + 1]
        ok = np.flatnonzero(inside < end)
        starts.append(at[ok])
        lengths.append(np.full(len(ok), d + 2))
        hashes.append(h[ok])
        # a line end and a weight as large as the first one let no longer gram through
        inside = np.maximum(inside, end)
        go = np.flatnonzero((end >= 0) & (inside < w[at]))
        at, inside, h = at[go], inside[go], h[go]
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(hashes)


def distinct_grams(codes: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the first gram of each text (doc by character) and content. Equal hashes are compared by content."""
    h = h ^ (doc[start].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(h)
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    x, y = order[again], order[again + 1]
    differs = (length[x] != length[y]) | (doc[start[x]] != doc[start[y]])
    left = np.flatnonzero(~differs)
    t = 0
    while len(left):
        differs[left[codes[start[x[left]] + t] != codes[start[y[left]] + t]]] = True
        t += 1
        left = left[(length[x[left]] > t) & ~differs[left]]
    keep = np.ones(len(h), dtype=bool)
    keep[y] = False
    for key in set(h[y[differs]].tolist()):  # different grams of one hash
        seen = set()
        for i in np.flatnonzero(h == np.uint64(key)).tolist():
            g = (int(doc[start[i]]), codes[start[i] : start[i] + length[i]].tobytes())
            keep[i] = g not in seen
            seen.add(g)
    return np.flatnonzero(keep)


CHUNK = 1 << 18  # characters weighed at once


def sparse_grams(docs: DataFrame, most: int = 16) -> DataFrame:
    """doc_id, gram: variable-length grams. An interval of a line is one when every pair inside weighs less than the pairs at its ends.

    A pair's weight is a hash, raised at word bounds, so cuts fall at the same places in a query and in a text. Grams are made distinct
    within a row; rows are shuffled only where a doc_id has several.
    """

    def run(batches):
        import pyarrow as pa

        kind = np.full(0x110000, 4, dtype=np.int8)

        def grams(ids: list[int], texts: list[str]):
            """Of whole texts, together."""
            text = "\n".join(texts)
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            if len(codes) < 3:
                return pa.array([], pa.int64()), pa.array([], pa.string())
            doc = np.repeat(np.arange(len(ids)), [len(t) + 1 for t in texts])[:-1]
            w = pair_weights(codes, kind)
            w[(codes[:-1] == 10) | (codes[1:] == 10)] = -1
            start, length, h = sparse_intervals(codes, w, most)
            first = distinct_grams(codes, doc, start, length, h)
            start, length = start[first], length[first]
            byte = np.zeros(len(codes) + 1, dtype=np.int64)
            np.cumsum(1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), out=byte[1:])
            begin, size = byte[start], byte[start + length] - byte[start]
            offset = np.zeros(len(start) + 1, dtype=np.int32)
            np.cumsum(size, out=offset[1:])
            data = np.frombuffer(text.encode(), dtype=np.uint8)[np.repeat(begin - offset[:-1], size) + np.arange(offset[-1])]
            return pa.array(np.array(ids, dtype=np.int64)[doc[start]]), pa.StringArray.from_buffers(len(start), pa.py_buffer(offset), pa.py_buffer(data))

        def long(d: int, text: str):
            """Of a text of several parts; the characters after a part belong to grams that start in it."""
            found = set()
            for i in range(0, len(text) - 2, CHUNK):
                found.update(grams([d], [text[i : i + CHUNK + most - 1]])[1].to_pylist())
            rows = sorted(found)
            for i in range(0, len(rows), CHUNK):
                part = rows[i : i + CHUNK]
                yield pa.array([d] * len(part), pa.int64()), pa.array(part, pa.string())

        def parts(batch):
            ids, texts, n = [], [], 0
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if len(text) > CHUNK:
                    yield from long(d, text)
                    continue
                if n + len(text) > CHUNK:
                    yield grams(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(d)
                texts.append(text)
                n += len(text) + 1
            yield grams(ids, texts)

        for batch in batches:
            for columns in parts(batch):
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "gram"])

    out = spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, gram string")
    return out if unique_ids(docs) else out.distinct()


def top_grams(frequencies: DataFrame, k: int = 20) -> DataFrame:
    """The k commonest grams and their rank."""
    top = frequencies.orderBy(F.desc("df"), "gram").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("df"), "gram")))


def resolve_stats(corpus: DataFrame, posting: DataFrame, pattern: str) -> DataFrame:
    """One row: how many postings the grams of a pattern have, documents after the intersection, after the match, and rejects."""
    p = plan(pattern, folded=is_folded(posting))
    wanted = sorted({g for a in p.alternatives or () for g in a})
    raw = posting.where(F.col("gram").isin(wanted)).agg(F.count("*").alias("raw"), F.count_distinct("gram").alias("leaves"))
    found = candidates(posting, p)
    hits = corpus.join(found, "doc_id", "left_semi").select(S.hit(F.col("text"), S.SearchOptions(pattern)).alias("m"))
    n = hits.agg(F.count("*").alias("after_intersection"), F.count_if("m").alias("matched"))
    return raw.crossJoin(n).withColumn("rejected", F.col("after_intersection") - F.col("matched"))  # one row each
