"""Byte-balanced shards by histogram sort (operator 3). DataFrame functions only.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side. Candidate key boundaries (probes) split the key
range; one aggregation counts the exact bytes below every probe over all partitions; only the intervals that hold a wanted
splitter are probed again, ever more finely, until each splitter's error is within the tolerance. Probes are prefixes of the key, so a
round is one filter on the prefixes still open and one count by the prefixes below them, the same plan in every round. Then rows are
exchanged once, straight to their slice of a shard (a binary search in one array of boundaries). A group of equal texts larger than
the tolerance is split by doc_id, so no key is too large.

What comes to the driver is one row a probe: at most 2^bits a wanted splitter a round, whatever the input.

Nulls and edges: a null text has no bytes and the checksum of an empty one; repeated rows (same doc_id and text) count each, and
can only go to one side of a splitter together; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, table

SHARDS = 24
OVERHEAD = 8


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two-part key (k0: text hash, k1: doc_id), both as unsigned order in signed longs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k0"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k1"),
    )


def _count(keys: DataFrame, group: list[Column]) -> list:
    return keys.groupBy(*[g.alias(f"p{i}") for i, g in enumerate(group)]).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()


def _children(rows: list) -> dict:
    """parent -> its probed intervals (prefix, bytes, rows) in key order."""
    out: dict = {}
    for parent, prefix, size, n in rows:
        out.setdefault(parent, []).append((prefix, size, n))
    return {k: sorted(v) for k, v in out.items()}


def find_splitters(keys: DataFrame, targets: list[int], tolerance: int, bits: int = 12) -> list[tuple[int, int, int, int]]:
    """For each wanted number of bytes (ascending): (k0, k1, bytes below, rows below) of the boundary chosen.

    A splitter is settled when the interval holding its target has at most tolerance bytes, or one key; the nearer end is taken.
    """
    low, high = keys.agg(F.min("k1"), F.max("k1")).first()
    if low is None:
        return []
    # prefixes of k0 are of its 64 signed bits, those of k1 of its distance from the least one where a long can hold that
    base, wide = (low, max(1, (high - low).bit_length())) if (high - low).bit_length() < 63 else (0, 64)
    place = {t: (None, 0, 0) for t in targets}  # parent, bytes and rows below it
    done: dict[int, tuple] = {}
    deep: dict[int, tuple] = {}  # targets inside one k0
    last_key = ((1 << 63) - 1, high + 1)

    def settle(t: int, found: list, below: tuple, start, end) -> tuple | None:
        """The interval that holds the target, as (prefix, bytes below, rows below), or None where it is settled."""
        size, rows = below
        for i, (prefix, s, n) in enumerate(found):
            if size + s > t or i == len(found) - 1:
                break
            size, rows = size + s, rows + n
        if n > 1 and s > tolerance:
            return prefix, size, rows
        after = t - size > size + s - t
        done[t] = (*(end(prefix) if after else start(prefix)), *((size + s, rows + n) if after else (size, rows)))
        return None

    used = 0
    while place:
        step = min(bits, 64 - used)
        rest = 64 - used - step
        prefix = lambda n: F.shiftright("k0", n)
        inside = keys if used == 0 else keys.where(prefix(64 - used).isin(sorted({p for p, _, _ in place.values()})))
        children = _children([(None if used == 0 else r["p0"] >> step, *r) for r in _count(inside, [prefix(rest)])])
        used += step
        nxt = {}
        for t, (parent, size, rows) in place.items():
            end = lambda p: (p + 1 << rest, low) if p + 1 << rest < 1 << 63 else last_key  # noqa: B023, E731
            open_ = settle(t, children[parent], (size, rows), lambda p: (p << rest, low), end)  # noqa: B023
            if open_:
                (deep if used == 64 else nxt)[t] = open_
        place = nxt
    # groups of equal texts above the tolerance: by doc_id
    place2 = {t: (k0, None, size, rows) for t, (k0, size, rows) in deep.items()}
    used = 0
    while place2:
        step = min(bits, wide - used)
        rest = wide - used - step
        prefix = lambda n: F.shiftright(F.col("k1") - F.lit(base), n) if n < 64 else F.lit(0).cast("long")
        inside = keys.where(F.col("k0").isin(sorted({p[0] for p in place2.values()})))
        if used:
            name = lambda a, b: F.concat_ws(":", a, b)
            inside = inside.where(name(F.col("k0").cast("string"), prefix(wide - used).cast("string")).isin(sorted({f"{p[0]}:{p[1]}" for p in place2.values()})))
        children = _children([((r["p0"], None if used == 0 else r["p1"] >> step), r["p1"], r["s"], r["n"]) for r in _count(inside, [F.col("k0"), prefix(rest)])])
        used += step
        nxt2 = {}
        for t, (k0, parent, size, rows) in place2.items():
            start = lambda p: (k0, base + (p << rest))  # noqa: B023, E731
            open_ = settle(t, children[k0, parent], (size, rows), start, lambda p: start(p + 1))  # noqa: B023
            if open_ and used < wide:
                nxt2[t] = (k0, *open_)
            elif open_:
                # rows of one id and text can't be parted
                p, size, rows = open_
                s, n = next((s, n) for q, s, n in children[k0, parent] if q == p)
                after = t - size > size + s - t
                done[t] = (*start(p + after), size + s * after, rows + n * after)
        place2 = nxt2
    return [done[t] for t in targets]


def _constant(values: list, kind: str) -> Column:
    """A literal array, as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def piece_of(bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted boundaries are at or below the row's key: a binary search in one constant array."""
    if not bounds:
        return F.lit(0)
    keys = _constant([{"a": a, "b": b} for a, b in bounds], "array<struct<a:bigint,b:bigint>>")
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    row = F.struct(F.col("k0").alias("a"), F.col("k1").alias("b"))
    up = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(keys, at + step - 1) <= row), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), up)


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, slices: int = 8, tolerance: float = 0.002, bits: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard, in key order).

    Splitters are found for shards * slices equal pieces; every piece is one task of the exchange, and the exact row counts below
    the splitters give each piece's first slot, so no task holds a whole shard. tolerance: of a shard's mean bytes.
    """
    keys = durable(keyed(docs))
    total, n_rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    pieces = shards * slices
    targets = sorted({total * i // pieces for i in range(1, pieces)} - {0})
    edges = find_splitters(keys, targets, int(tolerance * total / shards), bits) if n_rows else []
    by_target = dict(zip(targets, edges, strict=True)) if edges else {}
    chosen = [by_target.get(total * i // pieces) for i in range(1, pieces)]
    # a boundary that no row lies below repeats the one before
    bounds, last = [], (-(1 << 63), -(1 << 63), 0, 0)
    for c in chosen:
        last = max(last, c) if c else last
        bounds.append(last)
    first_row = [0, *(x[3] for x in bounds)]
    shard_start = [first_row[p - p % slices] for p in range(pieces)]
    base = F.element_at(_constant([first_row[p] - shard_start[p] for p in range(pieces)], "array<bigint>"), F.col("piece") + 1)
    dealt = keys.withColumn("piece", piece_of([x[:2] for x in bounds])).repartitionById(pieces, F.col("piece"))
    order = Window.partitionBy("piece").orderBy("k0", "k1", "size")
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.floor(F.col("piece") / slices).cast("int").alias("shard"),
        (base + F.row_number().over(order) - 1).alias("slot"),
    )


def shard_of(bounds: list[tuple[int, int]], key: tuple[int, int]) -> int:
    """The piece of a key, as the exchange computes it (for tests)."""
    return bisect_right(bounds, key)


def op3_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
