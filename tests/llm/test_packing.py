from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm.packing import MAX_DOCS, MAX_TOKENS, WEIGHTS, assign_sequences, best_fit, cut, encoder, pack_documents, tokenize_pieces


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_are_the_tokenizer_librarys():
    rng = random.Random(3)
    alphabet = ["a", "The", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "日", "🙂", "'s", "12", ".", "_", " ", " ", "\x1c", "\x85", "<|endoftext|>", "ñ", "A", "’"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["x" * 5000, ""]
    encode = encoder(None)
    for text, e in zip(texts, reference().encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == e.ids, repr(text)


def test_ids_of_the_test_tables(spark):
    """Every whole text of sf0.01."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encode = encoder(None)
    for text, e in zip(texts, reference().encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == e.ids


def test_no_group_holds_a_repeated_id(spark):
    """Rows without an id, or with one id, are dealt as evenly as others."""
    pieces = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(500).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    out = assign_sequences(pieces, group_rows=1000)
    groups = out.groupBy((F.col("sequence_id") % 20).alias("g")).count().collect()
    assert len(groups) == 20 and max(r["count"] for r in groups) < 1300
    assert out.select("sequence_id").distinct().count() <= 5000 + 20


def test_production_capacities_bind():
    """Many short pieces: the document capacity holds in every sequence."""
    rng = random.Random(9)
    n = sorted((rng.randint(1, 60) for _ in range(3000)), reverse=True)
    counts: dict = {}
    for b in best_fit(n, MAX_TOKENS, MAX_DOCS, MAX_TOKENS**2, WEIGHTS):
        counts[b] = counts.get(b, 0) + 1
    assert max(counts.values()) == MAX_DOCS


def test_round_trip(odd, none):
    """The pieces of a document, put together again by sequence and offset, are its ids."""
    out = pack_documents(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), max_tokens=64).collect()
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    t = reference()
    for d in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [x for r in pieces for x in r["ids"]] == ids
        assert [r["start"] for r in pieces] == [s for s, _ in cut(len(ids), 64)]
    places: dict = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for offset, n in sorted(p):
            assert offset == end
            end += n
        assert end <= 64
    assert pack_documents(none).count() == 0
    assert pack_documents(odd).groupBy("doc_id", "piece").count().where("doc_id = 1").first()["count"] == 2


def test_every_capacity_binds():
    rng = random.Random(1)
    n = sorted((rng.randint(1, 200) for _ in range(400)), reverse=True)
    for docs, cost in ((3, 10**9), (1000, 30_000), (4, 50_000)):
        bins: dict = {}
        for x, b in zip(n, best_fit(n, 256, docs, cost, (1.0, 1e-6, 1e-6)), strict=True):
            bins.setdefault(b, []).append(x)
        for b in bins.values():
            assert sum(b) <= 256 and len(b) <= docs and (sum(x * x for x in b) <= cost or len(b) == 1)


def test_least_norm_is_exact():
    """The pruned search opens and picks bins as a full search does."""
    rng = random.Random(2)
    n = sorted((rng.randint(1, 90) for _ in range(150)), reverse=True)
    w, cap, docs, cost = (1.0, 0.3, 0.2), 100, 6, 9000

    def full():
        bins, out = [], []
        for x in n:
            best = None
            for i, (r, d, c) in enumerate(bins):
                if r >= x and d >= 1 and c >= x * x:
                    norm = w[0] * ((r - x) / cap) ** 2 + w[1] * ((d - 1) / docs) ** 2 + w[2] * ((c - x * x) / cost) ** 2
                    if best is None or norm < best[0]:
                        best = (norm, i)
            i = len(bins) if best is None else best[1]
            if best is None:
                bins.append((cap, docs, cost))
            r, d, c = bins[i]
            bins[i] = (r - x, d - 1, c - x * x)
            out.append(i)
        return sorted(bins)

    got = best_fit(n, cap, docs, cost, w)
    left: dict = {}
    for x, b in zip(n, got, strict=True):
        r, d, c = left.get(b, (cap, docs, cost))
        left[b] = (r - x, d - 1, c - x * x)
    assert sorted(left.values()) == full()


def test_groups_are_bounded(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 900 + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    out = assign_sequences(pieces, group_rows=500)
    total = pieces.agg(F.sum("length")).first()[0]
    assert out.select("sequence_id").distinct().count() <= total / 2048 * 1.02 + 11
    assert tokenize_pieces(spark.createDataFrame([(1, None)], "doc_id long, text string"), keep_ids=False).first()["length"] == 1
