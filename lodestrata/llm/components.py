"""Connected components of a link table that never leaves the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lookup, small_batches, tidy

#: So few links are joined in one task.
FEW = 1 << 18


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """By node below n: the smallest node of its component."""
    to = np.arange(n)
    while len(a):
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        a, b = to[a], to[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return to


def _in_one_task(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, to (the smallest node of its component)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            ends = pd.concat([x[c] for c in ("a", "b") for x in held], ignore_index=True)
            code, nodes = pd.factorize(ends, sort=True)
            half = len(code) // 2
            yield pd.DataFrame({"node": nodes, "to": nodes[smallest(code[:half], code[half:], len(nodes))]})

    small_batches(edges.sparkSession)
    kind = edges.schema["a"].dataType.simpleString()
    return durable(edges.coalesce(1).mapInPandas(tidy(run), f"node {kind}, to {kind}"))


def connected_components(links: DataFrame, few: int = FEW) -> DataFrame:
    """links(a, b) -> node, root: one row for each node of a link; root is the smallest node of its component.

    Each round, every node points to the neighbour of least priority (a hash, so that chains of rising ids shrink as fast as any)
    or to itself, pointers are followed once more, and links are redrawn between what they point to. Rounds go on until at most `few`
    links are left, however many there were; each at least halves the nodes of a component, about. The rest are joined in one task,
    which spares the driver the plans and jobs of rounds over little. Frequent nodes meet partial aggregation in the groupBy, and
    their rows are salted in joins, so that no task holds all of them.
    """
    kind = links.schema["a"].dataType.simpleString()
    edges = durable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while (left := edges.count()) > few:
        both = edges.union(edges.select("b", "a"))
        mine, other = F.xxhash64("a"), F.xxhash64("b")
        least = both.groupBy("a").agg(F.min(F.struct(other.alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(mine.alias("h"), F.col("a").alias("v"))
        hop = least.select(F.col("a").alias("node"), F.least(own, F.col("m"))["v"].alias("to"))
        second = hop.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        hop = durable(lookup(hop, "to", second, "node").select("node", F.col("to2").alias("to")))
        maps.append(hop)
        moved = lookup(edges, "a", hop.select(F.col("node").alias("a"), F.col("to").alias("ta")), "b")
        moved = lookup(moved, "b", hop.select(F.col("node").alias("b"), F.col("to").alias("tb")), "a").where("ta <> tb")
        edges = durable(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if left:
        maps.append(_in_one_task(edges))
    if not maps:
        return links.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    if left and len(maps) == 1:
        return maps[0].withColumnRenamed("to", "root")
    out = maps[-1]
    for m in reversed(maps[:-1]):
        # a node that no later round moved is where it was
        ends = out.select(F.col("node").alias("to"), F.col("to").alias("end")).unionByName(m.select("to").distinct().join(out.select(F.col("node").alias("to")), "to", "left_anti").withColumn("end", F.col("to")))
        out = durable(lookup(m, "to", ends, "node").select("node", F.col("end").alias("to")))
    least = out.groupBy("to").agg(F.min("node").alias("root"))
    return durable(lookup(out, "to", least, "node").select("node", "root"))
