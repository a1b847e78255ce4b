"""Near-duplicate groups by a MinHash LSH forest (operator 7).

1. Every text becomes the set of its distinct k-word shingles (A-Z lower-cased), the set's 128-bit key and a MinHash signature of
   trees * depth coordinates of 16 bits. Texts of equal sets collapse to the smallest doc_id at once.
2. Forest: tree l sorts the signatures by their coordinates from l * depth on, cyclically. A region is what shares the first depth
   coordinates; a large region is parted at more coordinates, the more rows it has. In each region neighbours in sorted order
   (longest common prefix) are candidates; of these every text takes the best-voted one before and after it over all trees.
3. Candidates are confirmed on the full sets, and links join to components.
4. What neighbours alone would miss: in each region whose texts are not yet one component, all pairs across components are
   compared, in blocks of rows, by their signatures; those within reach of the threshold are confirmed on the full sets.
   Pairs inside one component need no link. No number of partners is capped.

A pair at the threshold shares a region of some tree but for (1 - t^depth)^trees of cases (2e-8 at 0.85 with 32 trees of depth 5),
and falls below the signature margin with 4.5 standard deviations.

Nulls and edges: null, empty or wordless texts have no shingles, link with nothing and stay; repeated rows get equal answers; a
null doc_id is in no component (component_id null) and stays; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, durable, hash_words, lower_az, mix, parts, small_batches, spread, spread_join, table, tidy, window_hashes, words
from .components import connected_components

TREES, DEPTH = 32, 5
BLOCK = 320
FILTER_BITS = 1 << 22


def _coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:m] >> np.uint64(32)).astype(np.uint32), ((x[m:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))


def signature(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> bytes:
    """MinHash coordinates, the low 16 bits of each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, ((x[None, i : i + 512] ^ flips[:, None]) * factors[:, None]).min(axis=1), out=least)
    return (least & np.uint32(0xFFFF)).astype("<u2").tobytes()


def sketch(docs: DataFrame, k: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, set_key, sig."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips, factors = _coefficients(coordinates)
        for batch in batches:
            texts, rows = batch["text"].tolist(), []
            for first, last in chunks(texts):
                for s in shingle_sets(texts[first:last], k):
                    if len(s):
                        key = f"{int(np.bitwise_xor.reduce(mix(s))):016x}{int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))):016x}{len(s):x}"
                        rows.append((len(s), key, signature(s, flips, factors)))
                    else:
                        rows.append((0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "sig"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key string, sig binary"
    return spread(docs.select("doc_id", "text")).mapInPandas(tidy(run), schema)


def shingle_sets(texts: list, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, as shingle_set gives them, with the words of all texts hashed at once."""
    per_doc = [words(lower_az(t)) if t else [] for t in texts]
    flat = hash_words([w for x in per_doc for w in x])
    counts = [len(x) for x in per_doc]
    del per_doc
    windows = window_hashes(flat, k)
    end = 0
    for n in counts:
        end += n
        if n >= k:
            yield np.unique(windows[end - n : end - k + 1])
        else:
            yield np.unique(window_hashes(flat[end - n : end], n)) if n else flat[:0]


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def shingle_table(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id, s: the full shingle sets (sorted 64-bit hashes) of the documents whose id is in ids(id).

    A bitmap of fixed size keeps other texts out of the shuffle (some may pass; the join drops them).
    """
    bits = ids.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("p")).distinct()
    cells = bits.groupBy(F.bitmap_bucket_number("p").alias("c")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    p = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    byte = F.floor(F.bitmap_bit_position(p) / 8).cast("int")
    bit = F.pmod(F.bitmap_bit_position(p), F.lit(8)).cast("int")
    # cells: one row for each 32,768 bits, at most 129 rows of 4 KB
    found = docs.select("doc_id", "text").withColumn("c", F.bitmap_bucket_number(p)).join(F.broadcast(cells), "c")
    hit = F.conv(F.hex(F.substring("m", byte + 1, F.lit(1))), 16, 10).cast("int")
    found = found.where(F.pmod(F.floor(hit / F.pow(F.lit(2), bit)), F.lit(2)) == 1).select("doc_id", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame({"id": batch["doc_id"], "s": [x.tobytes() for a, b in chunks(texts) for x in shingle_sets(texts[a:b], k)]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return durable(found.mapInPandas(tidy(sets), f"id {kind}, s binary").dropDuplicates(["id"]))


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union of two full sets."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of pairs(a, b) whose full sets are similar."""
    sets = shingle_table(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), docs, k)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similar(x, y, percent) for x, y in zip(batch["sa"], batch["sb"], strict=True)]
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return durable(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInPandas(tidy(check), f"a {kind}, b {kind}"))


def forest(nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """Regions of two rows or more: tree, region, ord (the next coordinates), id, n, size (rows of the region)."""
    width = 2 * depth
    rows = nodes.select("id", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    start = F.col("tree") * width + 1
    rows = rows.select(
        "tree",
        F.xxhash64("tree", F.substring("sig", start, F.lit(width))).alias("region"),
        F.substring(F.concat("sig", "sig"), start + width, F.lit(24)).alias("ord"),
        "id",
        "n",
    )
    sizes = rows.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    return durable(rows.join(sizes, "region"))


def neighbour_pairs(regions: DataFrame, percent: int, region_rows: int) -> DataFrame:
    """For each text the neighbour before and the one after it that most trees vote for."""
    deeper = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / F.lit(region_rows)))).cast("int")
    part = F.when(F.col("size") > region_rows, F.xxhash64("region", F.substring("ord", F.lit(1), 2 * deeper))).otherwise(F.col("region"))
    w = Window.partitionBy("part").orderBy("ord", "id")
    near = regions.withColumn("part", part).select("id", "n", F.lag("id").over(w).alias("o"), F.lag("n").over(w).alias("m"))
    near = near.where(F.col("o").isNotNull() & _near_sizes(F.col("n"), F.col("m"), percent))
    votes = near.groupBy(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).agg(F.count("*").alias("v"))
    best_a = votes.groupBy("b").agg(F.max(F.struct("v", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    best_b = votes.groupBy("a").agg(F.max(F.struct("v", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    return durable(best_a.union(best_b).distinct())


def links_across(regions: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, trees: int, depth: int) -> DataFrame:
    """Links (a, b) between different components that share a region: all of them, confirmed on the full sets.

    Rows of a region are dealt to blocks, and every two blocks of it meet in one task. Signatures come first: a pair whose
    signatures can't reach the threshold is out. Only rows with a pair left get their full sets, and meet in the same blocks again;
    pairs themselves are never sent anywhere, only links are.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    r = regions.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = r.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("region")
    r = r.join(mixed, "region").join(nodes.select("id", "sig"), "id")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    r = r.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["tree", "region", "i", "j", "mine", "id", "n", "root", "sig"]
    r = r.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).select(names)
    t = percent / 100
    least = t - 4.5 * (t * (1 - t) / (trees * depth)) ** 0.5

    def near(g: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """A row and the later rows that may be similar to it."""
        n, root, mine, tree = (g[c].to_numpy() for c in ("n", "root", "mine", "tree"))
        s = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g), -1)
        cross = g["i"].iat[0] != g["j"].iat[0]
        for x in range(len(g) - 1):
            y = slice(x + 1, None)
            ok = (root[y] != root[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)
            if cross:
                ok &= mine[y] != mine[x]
            at = np.flatnonzero(ok) + x + 1
            if len(at):
                same = s[at] == s[x]
                # a pair is looked at in the first tree where it shares a region
                first = same.reshape(len(at), trees, depth).all(axis=2).argmax(axis=1) == tree[x]
                at = at[(same.mean(axis=1) >= least) & first]
                if len(at):
                    yield x, at

    def members(g: pd.DataFrame) -> pd.DataFrame:
        wanted = np.zeros(len(g), bool)
        for x, at in near(g):
            wanted[x] = True
            wanted[at] = True
        return g[wanted]

    def links(g: pd.DataFrame) -> pd.DataFrame:
        ids, s = g["id"].to_numpy(), g["s"].tolist()
        out = []
        for x, at in near(g):
            for y in at.tolist():
                if similar(s[x], s[y], percent):
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    def together(rows: DataFrame, work, schema: str) -> DataFrame:
        """work on the rows of each (region, i, j), which come one after another; a group is at most two blocks."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for batch in batches:
                key = batch[["region", "i", "j"]].to_numpy()
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = batch.iloc[a:b]
                    if held and tuple(held[0][["region", "i", "j"]].iloc[0]) != tuple(key[a]):
                        yield work(pd.concat(held, ignore_index=True))
                        held = []
                    if len(part):
                        held.append(part)
            if held:
                yield work(pd.concat(held, ignore_index=True))

        dealt = rows.repartition(max(parts(rows.sparkSession), 1), "region", "i", "j").sortWithinPartitions("region", "i", "j", "id")
        return dealt.mapInPandas(tidy(run), schema)

    kinds = {f.name: f.dataType.simpleString() for f in r.schema}
    found = durable(together(r, members, ", ".join(f"{c} {kinds[c]}" for c in names)))
    sets = shingle_table(found.select("id").distinct(), docs, k)
    return durable(together(found.join(sets, "id"), links, f"a {kind}, b {kind}").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, region_rows: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text).

    Texts are linked when 100 * intersection >= percent * union of their k-word shingle sets.
    """
    texts = durable(sketch(docs, k, trees * depth))
    sets = texts.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    sets = durable(sets)
    nodes = texts.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").where("n_shingles > 0")
    nodes = nodes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig").dropDuplicates(["id"])
    regions = forest(nodes, trees, depth)
    links = confirm(neighbour_pairs(regions, percent, region_rows), docs, k, percent)
    roots = connected_components(links)
    more = links_across(regions, roots, nodes, docs, k, percent, trees, depth)
    if not more.isEmpty():
        # the first components stand for their links
        roots = connected_components(more.union(roots.select("node", "root")))
    found = sets.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    found = found.select("set_key", F.coalesce("root", "rep").alias("component"), "copies")
    frequent = max(2, texts.count() // 1000)
    out = spread_join(texts.select("doc_id", "n_shingles", "set_key"), found.drop("copies"), "set_key", found.where(F.col("copies") >= frequent).drop("copies"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, **limits) -> DataFrame:
    """docs with one document of each group of near duplicates; a doc_id that repeats stays once, rows with a null doc_id stay."""
    kept = near_duplicates(docs, **limits).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op7_lsh_forest_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
