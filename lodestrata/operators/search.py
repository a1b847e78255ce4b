"""Regular-expression search over a corpus(doc_id, path, text): documents, counts, lines, context, ranges and capped output."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import line_local, search_pattern, to_java
from ..sources.tables import MAX_FILE_SIZE, excluded, extension, is_binary, matches_glob, of_type, size_within, under_paths
from .lines import split_lines


@dataclass
class SearchOptions:
    pattern: str
    ignore_case: bool = False
    fixed: bool = False
    word: bool = False
    before: int = 0
    after: int = 0
    context: int | None = None  # overrides before and after
    file_type: str | None = None
    glob: str | None = None
    paths: list[str] = field(default_factory=list)
    max_file_size: int = MAX_FILE_SIZE
    default_excludes: bool = True
    top: int | None = None
    expand: list[str] = field(default_factory=list)  # further words, any of which counts

    @property
    def java(self) -> str:
        p = search_pattern(self.pattern, self.fixed, self.word)
        if self.expand:
            words = "|".join(search_pattern(w, fixed=True) for w in [self.pattern, *self.expand])
            p = rf"\b(?:{words})\b"
        return to_java(p, self.ignore_case)


def eligible(corpus: DataFrame, o: SearchOptions) -> DataFrame:
    """Documents that path, type, glob, size and binary filters leave."""
    path = F.col("path")
    keep = under_paths(path, o.paths) & size_within(F.octet_length("text"), o.max_file_size) & ~is_binary(F.col("text"))
    if o.default_excludes:
        keep = keep & ~excluded(path)
    if o.file_type:
        keep = keep & of_type(path, o.file_type)
    if o.glob:
        keep = keep & matches_glob(path, o.glob)
    return corpus.where(keep)


def hit(text: Column, o: SearchOptions) -> Column:
    return F.rlike(text, F.lit(o.java))


def files(corpus: DataFrame, o: SearchOptions) -> DataFrame:
    """doc_id, path of documents that match."""
    return eligible(corpus, o).where(hit(F.col("text"), o)).select("doc_id", "path")


def counts(corpus: DataFrame, o: SearchOptions) -> DataFrame:
    """doc_id, path, match_count (matches, not lines) of documents that match."""
    n = F.regexp_count("text", F.lit(o.java)).cast("long")
    return eligible(corpus, o).where(hit(F.col("text"), o)).select("doc_id", "path", n.alias("match_count"))


#: Characters that no text should hold (Unicode keeps them for internal use): they mark where matches start and end.
_FROM, _TO, _INSTEAD = "\ufdd0", "\ufdd1", "\ufdd2"


def positions(found: DataFrame, o: SearchOptions, unit=F.char_length) -> DataFrame:
    """doc_id, path, n, line_no, start, end of every match in the whole text: its place in the line where it starts (from 0).

    Matches are marked in one pass, empty ones too, and the text is taken apart at the marks. A match starts where all pieces before
    it end; its line starts after the last line end before it. unit: char_length, or octet_length for bytes.
    """
    marked = F.regexp_replace(F.translate("text", _FROM + _TO, _INSTEAD * 2), F.lit(o.java), F.lit(f"{_FROM}$0{_TO}"))
    after = lambda x: F.element_at(F.split(x, _TO, -1), -1)
    before = lambda x: F.substring_index(x, _TO, 1)
    ends = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit("")))
    # how far into a piece its last line end reaches
    reach = lambda x: F.when(F.contains(x, F.lit("\n")), unit(x) - unit(F.substring_index(x, "\n", -1)))
    facts = lambda g, m: F.struct(unit(g).alias("g"), unit(m).alias("m"), ends(g).alias("ge"), ends(m).alias("me"), reach(g).alias("gr"), reach(m).alias("mr"))
    x = found.select("doc_id", "path", F.split(marked, _FROM, -1).alias("p")).where(F.size("p") > 1)
    both = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: facts(after(a), before(b)))
    x = x.select("doc_id", "path", F.posexplode(both).alias("n", "f")).select("doc_id", "path", "n", "f.*")
    w = Window.partitionBy("doc_id", "path").orderBy("n")
    x = x.withColumn("to", F.sum(F.col("g") + F.col("m")).over(w)).withColumn("from", F.col("to") - F.col("m"))
    x = x.withColumn("line_no", (F.sum(F.col("ge") + F.col("me")).over(w) - F.col("me") + 1).cast("int"))
    in_gap = F.max(F.col("from") - F.col("g") + F.col("gr")).over(w)
    in_match = F.max(F.col("from") + F.col("mr")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    line = F.coalesce(F.greatest(in_gap, in_match), F.lit(0))
    return x.select("doc_id", "path", "n", "line_no", (F.col("from") - line).cast("int").alias("start"), (F.col("to") - line).cast("int").alias("end"))


def _marked_lines(found: DataFrame, o: SearchOptions) -> DataFrame:
    """doc_id, path, line_no, line, n_ranges (0: no match starts here) of all lines of matching documents.

    Where no match can hold or look at a line end, lines are matched one by one, without a join; else matches are those of the whole
    text, and each counts for the line where it starts.
    """
    each = split_lines(found)
    if line_local(o.java):
        return each.withColumn("n_ranges", F.regexp_count("line", F.lit(o.java)).cast("long"))
    per = positions(found, o).groupBy("doc_id", "path", "line_no").agg(F.count("*").alias("n_ranges"))
    return each.join(per, ["doc_id", "path", "line_no"], "left").withColumn("n_ranges", F.coalesce("n_ranges", F.lit(0).cast("long")))


def lines(corpus: DataFrame, o: SearchOptions) -> DataFrame:
    """doc_id, path, line_no, line, n_ranges of the lines where matches start."""
    found = eligible(corpus, o).where(hit(F.col("text"), o)).select("doc_id", "path", "text")
    return _marked_lines(found, o).where(F.col("n_ranges") > 0).select("doc_id", "path", "line_no", "line", "n_ranges")


def with_context(corpus: DataFrame, o: SearchOptions) -> DataFrame:
    """doc_id, line_no, line, is_context: matching lines and those around them."""
    before, after = (o.context, o.context) if o.context is not None else (o.before, o.after)
    found = eligible(corpus, o).where(hit(F.col("text"), o)).select("doc_id", "path", "text")
    w = Window.partitionBy("doc_id", "path").orderBy("line_no").rowsBetween(-after, before)
    x = _marked_lines(found, o).withColumn("is_match", F.col("n_ranges") > 0).withColumn("near", F.max("is_match").over(w))
    return x.where("near").select("doc_id", "line_no", "line", (~F.col("is_match")).alias("is_context"))


def ranges(corpus: DataFrame, o: SearchOptions, in_bytes: bool = False) -> DataFrame:
    """doc_id, line_no, n, start, end (characters or bytes, from 0) of every match in the line where it starts."""
    found = eligible(corpus, o).where(hit(F.col("text"), o)).select("doc_id", "path", "text")
    x = positions(found, o, F.octet_length if in_bytes else F.char_length)
    w = Window.partitionBy("doc_id", "path", "line_no").orderBy("n")
    return x.select("doc_id", "line_no", F.row_number().over(w).alias("n"), "start", "end")


def grouped(matches: DataFrame, per_file: int = 10) -> DataFrame:
    """doc_id, path, body: `n:line` of a document's matches, at most per_file of them, then how many more."""
    w = Window.partitionBy("doc_id")
    x = matches.withColumn("rank", F.row_number().over(w.orderBy("line_no"))).withColumn("of", F.count("*").over(w))
    row = F.concat(F.col("line_no").cast("string"), F.lit(":"), "line")
    out = x.where(F.col("rank") <= per_file).groupBy("doc_id", "path").agg(F.sort_array(F.collect_list(F.struct("rank", row.alias("t")))).alias("rows"), F.max("of").alias("of"))
    more = F.when(F.col("of") > per_file, F.concat(F.lit("\n... +"), (F.col("of") - per_file).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return out.select("doc_id", "path", F.concat(F.array_join(F.transform("rows", lambda r: r["t"]), "\n"), more).alias("body"))


def capped(matches: DataFrame, per_file: int = 10, total: int = 200) -> DataFrame:
    """The first `total` rows in path and line order, at most per_file of a document."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_file).orderBy("path", "line_no").limit(total).drop("rank")


def compact(matches: DataFrame, max_files: int = 25, per_file: int = 5, width: int = 120) -> DataFrame:
    """file_rank, path, match_count, line_no, line: files by matches, their first lines, cut to a width."""
    per = matches.groupBy("doc_id", "path").agg(F.sum("n_ranges").alias("match_count")).orderBy(F.desc("match_count"), "path").limit(max_files)
    # at most max_files rows
    top = per.withColumn("file_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("match_count"), "path")))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    first = matches.join(F.broadcast(top.drop("path")), "doc_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_file)
    return first.select("file_rank", "path", "match_count", "line_no", F.left("line", F.lit(width)).alias("line"))


def json_lines(matches: DataFrame) -> DataFrame:
    return matches.select(F.to_json(F.struct(F.col("path").alias("file"), F.col("line_no").alias("line"), F.col("line").alias("text"))).alias("json"))


def stats(corpus: DataFrame, o: SearchOptions) -> DataFrame:
    """One row: documents, eligible ones, matching ones, matches."""
    fits = eligible(corpus, o).select("doc_id", F.lit(True).alias("fits"), F.regexp_count("text", F.lit(o.java)).cast("long").alias("n"))
    a = corpus.agg(F.count("*").alias("total"))
    b = fits.agg(F.count("*").alias("candidates"), F.count_if(F.col("n") > 0).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))
    return a.crossJoin(b)  # one row each


def file_list_aggregate(files_: DataFrame, most: int = 6) -> DataFrame:
    """kind, name, n: number of files, of directories, and the commonest extensions."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    totals = files_.agg(F.count("*").alias("files"), F.count_distinct(folder).alias("dirs"))
    totals = totals.select(F.explode(F.array(F.struct(F.lit("files").alias("kind"), F.lit("").alias("name"), F.col("files").alias("n")), F.struct(F.lit("dirs").alias("kind"), F.lit("").alias("name"), F.col("dirs").alias("n")))).alias("x")).select("x.*")
    ext = extension(F.col("path"))
    top = files_.groupBy(F.when(ext == "", "(none)").otherwise(ext).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)
    return totals.unionByName(top.select(F.lit("extension").alias("kind"), "name", "n"))


def bm25_topk(corpus: DataFrame, o: SearchOptions, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k documents of highest BM25 among those that match; statistics are of the matching documents, so idf is one constant."""
    m = counts_and_length(corpus, o)
    s = m.agg(F.count("*").alias("n"), F.avg("dl").alias("avdl"))
    idf = F.greatest(F.log((F.col("n") - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1), F.lit(0.01))
    tf = F.col("match_count").cast("double")
    score = idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avdl")))
    ranked = m.crossJoin(F.broadcast(s)).select("doc_id", "path", "match_count", F.round(score, 9).alias("score"))  # s: one row
    return ranked.orderBy(F.desc("score"), "path").limit(k)


def counts_and_length(corpus: DataFrame, o: SearchOptions) -> DataFrame:
    n = F.regexp_count("text", F.lit(o.java)).cast("long")
    return eligible(corpus, o).where(hit(F.col("text"), o)).select("doc_id", "path", n.alias("match_count"), F.greatest(F.octet_length("text"), F.lit(1)).cast("double").alias("dl"))
