"""One function for each thing a user asks for; everything takes and gives DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import compress, cooccur, filters, housekeeping, index, lines, render, symbols, usage
from .operators import search as _search
from .operators.search import SearchOptions
from .sources import tables
from .streaming import watch

MODES = {
    "lines": _search.lines,
    "context": _search.with_context,
    "count": _search.counts,
    "files": _search.files,
    "ranges": _search.ranges,
    "stats": _search.stats,
}


def search(corpus: DataFrame, options: SearchOptions | str, mode: str = "lines", postings: DataFrame | None = None, neighbours: DataFrame | None = None, documents: int | None = None) -> DataFrame:
    """Search corpus(doc_id, path, text).

    mode: lines, context, count, files, ranges, stats, grouped, compact or json. With postings, documents are pruned by the index
    first (documents: how many there are, so that a useless plan is not followed); with neighbours, a plain word also finds the words that occur with it. options.top: the best documents by BM25.
    """
    from .functions.regexes import is_plain_word

    o = SearchOptions(options) if isinstance(options, str) else options
    if neighbours is not None and is_plain_word(o.pattern):
        o.expand = cooccur.expansion(neighbours, o.pattern)
    if postings is not None:
        corpus = index.pruned(corpus, postings, o, documents=documents)
    if o.top:
        return _search.bm25_topk(corpus, o, o.top)
    if mode in MODES:
        return MODES[mode](corpus, o)
    rows = _search.lines(corpus, o)
    return {"grouped": _search.grouped, "compact": _search.compact, "json": _search.json_lines}[mode](rows)


def respond(corpus: DataFrame, options: SearchOptions | str, mode: str = "lines", postings: DataFrame | None = None, most: int = 200) -> dict:
    """A search as one answer: results (at most `most` rows), total, candidates, search_ms and error (None: it went well)."""
    import time

    began = time.perf_counter()
    out = {"results": [], "total": 0, "candidates": 0, "error": None}
    try:
        o = SearchOptions(options) if isinstance(options, str) else options
        left = corpus if postings is None else index.pruned(corpus, postings, o)
        out["candidates"] = left.count()
        rows = search(left, o, mode)
        out["total"] = rows.count()
        out["results"] = [r.asDict(recursive=True) for r in rows.limit(most).collect()]
    except ValueError as e:  # the pattern is not one
        out["error"] = str(e)
    return out | {"search_ms": round((time.perf_counter() - began) * 1000, 3)}


def build_index(spark: SparkSession, corpus: DataFrame, folder: str, generation: int) -> str:
    """Folded postings, which serve searches that ignore case and those that don't."""
    return index.publish(spark, index.postings(corpus, folded=True), folder, generation)


def update_index(spark: SparkSession, old: DataFrame, new: DataFrame, base: DataFrame, folder: str, generation: int) -> str:
    """Postings after a change of snapshots(doc_id, path, text, hash): an overlay for few changes, else a rebuild; published whole."""
    diff = index.snapshot_diff(old, new)
    changed = diff.count()
    if index.maintenance(old.count(), changed, changed) == "rebuild":
        return build_index(spark, new, folder, generation)
    gone = old.join(diff, "path").select("doc_id")
    fresh = new.join(diff.where("status <> 'deleted'"), "path").select("doc_id", "text")
    return index.publish(spark, index.overlay(base, index.postings(fresh, folded=index.is_folded(base)), gone), folder, generation)


def index_status(postings: DataFrame) -> DataFrame:
    return index.stats(postings)


__all__ = [
    "SearchOptions", "build_index", "compress", "cooccur", "filters", "housekeeping", "index", "index_status", "lines", "render", "respond", "search",
    "symbols", "tables", "update_index", "usage", "watch",
]
