"""Best-fit packing of tokenised documents into fixed-length sequences (operator 4).

A sequence is a bin with three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces are
taken by falling length; each goes to the open sequence, among all that can take it under every capacity, whose weighted
residual norm is smallest afterwards, else to a new sequence.

The token capacity is a sequence's length and the document capacity bounds the documents whose masks and positions a sequence holds;
both can exclude a sequence. Attention cost is at most the square of the tokens, so a capacity that a full piece alone needs (the
default) excludes no sequence that tokens allow; it weighs in the choice, which it takes away from sequences dear already. A smaller
one excludes too. On 11,562 pieces the default weights cost one sequence more than tokens alone (4939; 4936 is the bound).

Pieces that fill a sequence alone need no search. The others are dealt by a hash of their place in the input into groups of about
group_rows pieces, however often an id or a text repeats, and each group is packed by one task: memory is bounded by group_rows at any
input size, and what it costs is at most one part-filled sequence a group.

Nulls and edges: a null text counts as empty (one piece holding only the end id); equal rows are packed each for itself; an
empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, small_batches, spread, table, tidy

MAX_TOKENS, MAX_DOCS = 2048, 32
WEIGHTS = (1.0, 0.1, 0.1)  # of the residual tokens, documents and attention cost, each as a share of its capacity
END_ID = 0


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids of the byte-level BPE whose ranks are at path (None: the installed byte_bpe_50k vocabulary).

    The ids are those that the tokenizers library gives for the same vocabulary; tests hold the two against each other.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(enc.encode_ordinary(text), dtype=np.uint32)


def cut(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one, or full pieces after a first that takes the remainder."""
    if n <= max_tokens:
        return [(0, n)]
    first = n % max_tokens or max_tokens
    return [(0, first), *((s, max_tokens) for s in range(first, n, max_tokens))]


def tokenize_pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece of every document."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for i, (s, n) in enumerate(cut(len(ids), max_tokens)):
                    own = ids[s : s + n]
                    rows.append((doc_id, i, s, n, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    return spread(docs.select("doc_id", "text")).mapInPandas(tidy(run), schema)


def best_fit(lengths: list[int], max_tokens: int, max_docs: int, max_cost: int, weights: tuple[float, float, float]) -> list[int]:
    """The bin of each length; lengths are tried in the order given.

    Open bins lie by residual tokens, and within that by their other residuals. The search goes up from the tightest token
    residual and stops when the token term alone is no better than the best norm found, so it finds the least norm of all bins.
    """
    wt, wd, wc = weights
    by_left: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(max_tokens + 1)]
    filled, out, n_bins = 0, [], 0
    for n in lengths:
        cost = n * n
        best, where = None, None
        rest = filled >> n
        while rest:
            r = n + (rest & -rest).bit_length() - 1
            floor = wt * ((r - n) / max_tokens) ** 2
            if best is not None and floor >= best:
                break
            for d, c in by_left[r]:
                if d >= 1 and c >= cost:
                    norm = floor + wd * ((d - 1) / max_docs) ** 2 + wc * ((c - cost) / max_cost) ** 2
                    if best is None or norm < best:
                        best, where = norm, (r, d, c)
            rest &= rest - 1
        if where is None:
            r, d, c, b = max_tokens, max_docs, max_cost, n_bins
            n_bins += 1
        else:
            r, d, c = where
            same = by_left[r][d, c]
            b = same.pop()
            if not same:
                del by_left[r][d, c]
                if not by_left[r]:
                    filled &= ~(1 << r)
        out.append(b)
        left, key = r - n, (d - 1, c - cost)
        if left > 0 and key[0] > 0 and key[1] > 0:
            by_left[left].setdefault(key, []).append(b)
            filled |= 1 << left
    return out


def assign_sequences(
    pieces: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_docs: int = MAX_DOCS,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    group_rows: int = 4096,
) -> DataFrame:
    """pieces with sequence_id (unique numbers) and offset (place in the sequence, gapless from 0).

    max_cost None: the square of max_tokens. A piece whose own cost exceeds a smaller max_cost gets a sequence for itself.
    """
    most_cost = max_tokens**2 if max_cost is None else max_cost
    open_pieces = F.col("length") < max_tokens
    n = pieces.where(open_pieces).count()
    groups = max(1, -(-n // group_rows))
    dealt = pieces.withColumn("_g", F.when(open_pieces, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").drop(columns="_g")
        bins = np.array(best_fit(rows["length"].tolist(), max_tokens, max_docs, most_cost, weights), dtype=np.int64)
        rows["sequence_id"] = bins * groups + int(key[0])
        before = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        rows["offset"] = before.astype(np.int64)
        return rows

    packed = dealt.where(open_pieces).groupBy("_g").applyInPandas(pack, schema)
    # odd ids above those of the groups; a full piece needs no other id than its document and place
    top = F.lit(1 << 40)
    alone = dealt.where(~open_pieces).drop("_g")
    alone = alone.withColumn("sequence_id", top + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = True, **limits) -> DataFrame:
    """The pieces of all documents with the sequence and offset of each; limits as of assign_sequences."""
    own = {k: v for k, v in limits.items() if k == "max_tokens"}
    return assign_sequences(durable(tokenize_pieces(docs, vocabulary=vocabulary, keep_ids=keep_ids, **own)), **limits)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
