"""Definitions in texts, their blocks, and summaries of files and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import to_java
from .lines import split_lines

#: What starts a definition, by file extension (written for this library).
DEFINITIONS = {
    "rs": r"^\s*(pub(\([a-z]+\))? )?(async |unsafe |const )*(fn|struct|enum|trait|impl|type|mod|static|macro_rules!) ?",
    "py": r"^\s*(async )?(def|class) ",
    "go": r"^(func|type|var|const) ",
    "ts": r"^\s*(export )?(default )?(async )?(abstract )?(function|class|interface|type|enum|const|let) ",
    "js": r"^\s*(export )?(default )?(async )?(function|class|const|let) ",
    "java": r"^\s*(public |private |protected )?(static |final |abstract )*(class|interface|enum|record|[A-Za-z<>\[\]]+ [a-z]\w*\()",
    "rb": r"^\s*(def|class|module) ",
    "php": r"^\s*(public |private |protected )?(static |abstract |final )*(function|class|interface|trait|enum) ",
}
#: Kinds, tried in this order on the start of a definition.
KINDS = [("function", r"\b(fn|def|func|function)\b|\("), ("struct", r"\bstruct\b"), ("class", r"\bclass\b"), ("enum", r"\benum\b"), ("trait", r"\b(trait|interface|module|mod)\b"), ("impl", r"\bimpl\b"), ("type", r"\b(type|record)\b"), ("constant", r"\b(const|static|let|var)\b"), ("macro", r"\bmacro")]
SIGNATURE = 120


def symbols(corpus: DataFrame, rules: dict[str, str] | None = None, kinds: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, line_no, kind, signature of lines that start a definition; corpus(doc_id, lang, text), rules by lang."""
    x = split_lines(corpus.select("doc_id", "lang", "text"), keep_final=False)
    hit = F.lit(False)
    found = F.lit("")
    for lang, p in (rules or DEFINITIONS).items():
        own = F.col("lang") == lang
        hit = hit | (own & F.rlike("line", F.lit(to_java(p))))
        found = F.when(own, F.regexp_extract("line", to_java(p), 0)).otherwise(found)
    kind = F.lit("other")
    for name, p in reversed(kinds or KINDS):
        kind = F.when(F.rlike("found", F.lit(to_java(p))), F.lit(name)).otherwise(kind)
    s = F.trim("line")
    cut = F.when(F.char_length(s) > SIGNATURE, F.concat(F.left(s, F.lit(SIGNATURE - 3)), F.lit("..."))).otherwise(s)
    return x.where(hit).withColumn("found", found).select("doc_id", "line_no", kind.alias("kind"), cut.alias("signature"))


def blocks_to_next(symbols_: DataFrame, lengths: DataFrame) -> DataFrame:
    """symbols with block_end: the line before the next definition of the text, or its last line. lengths(doc_id, n_lines)."""
    nxt = F.lead("line_no").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return symbols_.join(lengths, "doc_id").withColumn("block_end", F.coalesce(nxt - 1, F.col("n_lines"))).drop("n_lines")


def brace_depth(lines: DataFrame, opening: str = r"\{", closing: str = r"\}") -> DataFrame:
    """lines with depth: how many braces are open after each line."""
    d = F.regexp_count("line", F.lit(to_java(opening))) - F.regexp_count("line", F.lit(to_java(closing)))
    return lines.withColumn("depth", F.sum(d).over(Window.partitionBy("doc_id").orderBy("line_no")))


def block_ends(lines: DataFrame, starts: DataFrame, opening: str = r"\{", closing: str = r"\}") -> DataFrame:
    """doc_id, line_no, block_end: the first line at or after a start after which no more braces are open than before it.

    A line after which fewer braces are open closes the levels in between; a start opens the level above those open before it, and
    its block ends at the first line that closes that level. Windows are by level of a text, and a closing brace is one row.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = brace_depth(lines, opening, closing).withColumn("before", F.coalesce(F.lag("depth").over(w), F.lit(0)))
    closed = x.where("depth < before").select("doc_id", "line_no", F.explode(F.sequence(F.col("depth") + 1, F.col("before"))).alias("level"), F.lit(True).alias("closes"))
    opened = x.where("depth > before").join(starts.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi").select("doc_id", "line_no", (F.col("before") + 1).alias("level"), F.lit(False).alias("closes"))
    after = Window.partitionBy("doc_id", "level").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    end = F.first(F.when(F.col("closes"), F.col("line_no")), ignorenulls=True).over(after)
    return closed.unionByName(opened).withColumn("block_end", end).where(~F.col("closes")).select("doc_id", "line_no", "block_end")


STRIPE = 32  # lines


def enclosing(symbols_: DataFrame, targets: DataFrame, radius: int = 20) -> DataFrame:
    """doc_id, target, start, end: the last definition whose block holds the target line, else the lines around it.

    Blocks and targets meet by stripes of lines of a text, so a target is compared with the blocks of its stripe alone.
    """
    stripe = lambda c: F.floor(F.col(c) / STRIPE).cast("int")
    s = symbols_.where("block_end >= line_no").select("doc_id", F.col("line_no").alias("s"), F.col("block_end").alias("e"))
    s = s.withColumn("stripe", F.explode(F.sequence(stripe("s"), stripe("e"))))
    x = targets.select("doc_id", F.col("line_no").alias("target"), stripe("line_no").alias("stripe")).join(s, ["doc_id", "stripe"], "left")
    inside = (F.col("s") <= F.col("target")) & (F.col("target") <= F.col("e"))
    x = x.groupBy("doc_id", "target").agg(F.max(F.when(inside, F.struct("s", "e"))).alias("b"))
    return x.select("doc_id", "target", F.coalesce("b.s", F.greatest(F.col("target") - radius, F.lit(1))).alias("start"), F.coalesce("b.e", F.col("target") + radius).alias("end"))


def preceding_signature(lines: DataFrame, symbols_: DataFrame, changed: DataFrame) -> DataFrame:
    """doc_id, line_no, signature_line, signature: for each changed line the nearest definition at or above it (as-of join)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    s = symbols_.select("doc_id", "line_no", "signature")
    x = lines.select("doc_id", "line_no").join(s, ["doc_id", "line_no"], "left")
    at = F.when(F.col("signature").isNotNull(), F.struct(F.col("line_no").alias("signature_line"), "signature"))
    x = x.withColumn("a", F.last(at, ignorenulls=True).over(w))
    return x.join(changed.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi").select("doc_id", "line_no", "a.signature_line", "a.signature")


def delta_view(lines: DataFrame, changed: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, line_no, mark (> for changed lines), gap (lines left out before), line: changed lines and those around them."""
    near = changed.select("doc_id", F.explode(F.sequence(F.col("line_no") - radius, F.col("line_no") + radius)).alias("line_no")).distinct()
    mine = changed.select("doc_id", "line_no", F.lit(">").alias("mark")).distinct()
    x = lines.join(near, ["doc_id", "line_no"]).join(mine, ["doc_id", "line_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    gap = F.col("line_no") - F.coalesce(F.lag("line_no").over(w), F.lit(0)) - 1
    return x.select("doc_id", "line_no", F.coalesce("mark", F.lit(" ")).alias("mark"), gap.alias("gap"), "line")


ROLE_LINES, API_NAMES = 20, 5


def roles(corpus: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """doc_id, role, public_api: what the first lines say of a text (a comment before code), and its first definitions."""
    x = split_lines(corpus.select("doc_id", "lang", "text"), keep_final=False).where(F.col("line_no") <= ROLE_LINES)
    t = F.trim("line")
    rank = F.when(F.rlike(t, F.lit(r"^(///|//!|/\*\*)")), 1).when(F.rlike(t, F.lit(r'^("""|\'\'\')')), 2).when(F.rlike(t, F.lit(r"^#[^!]")), 3).when(t != "", 4)
    bare = F.trim(F.regexp_replace(t, r'^(///|//!|/\*\*|"""|\'\'\'|#)\s*', ""))
    role = x.withColumn("rank", rank).where("rank is not null").groupBy("doc_id").agg(F.min_by(F.left(bare, F.lit(80)), F.struct("rank", "line_no")).alias("role"))
    s = symbols(corpus, rules)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    first = s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= API_NAMES)
    api = first.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "signature"))), lambda v: v["signature"]), "; ").alias("public_api"))
    return corpus.select("doc_id").join(role, "doc_id", "left").join(api, "doc_id", "left").select("doc_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("public_api", F.lit("")).alias("public_api"))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def tree(paths: DataFrame, depth: int = 3) -> DataFrame:
    """prefix, level, n: how many paths lie under each folder to a depth (a rollup over path levels)."""
    s = _segments(F.col("path"))
    levels = F.sequence(F.lit(1), F.least(F.lit(depth), F.size(s) - 1))
    x = paths.where(F.size(s) > 1).select(F.explode(F.transform(levels, lambda i: F.struct(F.array_join(F.slice(s, F.lit(1), i), "/").alias("prefix"), i.alias("level")))).alias("p"))
    return x.groupBy("p.prefix", "p.level").agg(F.count("*").alias("n"))


def dir_aggregate(paths: DataFrame, top: int = 8) -> DataFrame:
    """dir, n, names: files under each first folder, its first names in order."""
    s = _segments(F.col("path"))
    x = paths.select(F.element_at(s, 1).alias("dir"), F.element_at(s, -1).alias("name"))
    # a filter on the row number lets each task drop all but its first rows before the exchange
    first = x.withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy("name"))).where(F.col("r") <= top)
    names = first.groupBy("dir").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))
    return x.groupBy("dir").agg(F.count("*").alias("n")).join(names, "dir", "left")


def stacks(paths: DataFrame, markers: dict[str, str], depth: int = 3) -> DataFrame:
    """One row of flags: whether a marker file of each stack lies within a depth."""
    s = _segments(F.col("path"))
    near = paths.where(F.size(s) <= depth).select(F.element_at(s, -1).alias("name"))
    return near.agg(*[F.coalesce(F.bool_or(F.col("name") == name), F.lit(False)).alias(stack) for stack, name in markers.items()])


def chunks(docs: DataFrame, size: int = 40, overlap: int = 5) -> DataFrame:
    """doc_id, start_line, end_line, text: windows of lines; the last one reaches the end."""
    lines = F.split("text", "\n", -1)
    flavour = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    x = docs.select("doc_id", flavour.alias("l")).where(F.size("l") > 0)
    stride = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size("l") - size) / stride).cast("int"))
    x = x.select("doc_id", "l", F.explode(F.sequence(F.lit(0), last)).alias("i")).withColumn("s", F.col("i") * stride)
    end = F.least(F.col("s") + size, F.size("l"))
    return x.select("doc_id", (F.col("s") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("l", F.col("s") + 1, F.lit(size)), "\n").alias("text"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(1)).cast("long")


def cosine_topk(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """vec_id, score: the k vectors of highest dot product with one query vector (vectors have unit length). query: one row, q; for
    more of them see nearest()."""
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x = vectors.crossJoin(F.broadcast(query))  # one row
    return x.select("vec_id", F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """query_id, vec_id, score, rank: for every query vector the k vectors of highest dot product. queries: query_id, q.

    Queries go to the executors in blocks of about `block`, one pass over the vectors for each; a task keeps k rows a query. Null
    vectors have no score and are left out.
    """
    import numpy as np
    import pandas as pd

    queries = queries.where("q IS NOT NULL")
    passes = max(1, -(-queries.count() // block))

    def scan(rows: list) -> DataFrame:
        ids, q = np.array([r["query_id"] for r in rows], np.int64), np.array([r["q"] for r in rows], np.float64)

        def run(batches):
            best, names = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
            for batch in batches if len(ids) else ():
                for at in range(0, len(batch), 512):
                    part = batch.iloc[at : at + 512]
                    dots = q @ np.array(part["embedding"].tolist(), np.float64).T
                    dots = np.copysign(np.floor(np.abs(dots) * 1e6 + 0.5) / 1e6, dots) + 0.0
                    best = np.hstack([best, dots])
                    names = np.hstack([names, np.broadcast_to(part["vec_id"].to_numpy(np.int64), dots.shape)])
                    first = np.lexsort((names, -best), axis=1)[:, :k]
                    best, names = np.take_along_axis(best, first, 1), np.take_along_axis(names, first, 1)
            yield pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "vec_id": names.ravel(), "score": best.ravel()})

        return vectors.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")

    found = None
    for b in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == b).select("query_id", "q").collect()
        if rows or found is None and b == passes - 1:
            found = scan(rows) if found is None else found.union(scan(rows))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def preview(lines: DataFrame, hits: DataFrame, most: int = 8, width: int = 160) -> DataFrame:
    """doc_id, start_line, line_no, line: the first lines of each hit(doc_id, start_line, end_line), cut to a width."""
    want = hits.select("doc_id", "start_line", F.explode(F.sequence("start_line", F.least(F.col("end_line"), F.col("start_line") + most - 1))).alias("line_no"))
    return want.join(lines, ["doc_id", "line_no"]).select("doc_id", "start_line", "line_no", F.left("line", F.lit(width)).alias("line"))


#: Line starts that set a file up rather than do its work (imports and their like).
PREAMBLE = r"^(import |from \S+ import|use |using |require[ (]|#include|package |namespace |extern crate|export \* from|mod \w+;)"
ROLES = ["blank", "import", "definition", "code"]


def preamble(line: Column) -> Column:
    return F.rlike(F.trim(line), F.lit(PREAMBLE))


def line_roles(corpus: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """doc_id, line_no, role of every line: blank, import, definition or code."""
    x = split_lines(corpus.select("doc_id", "lang", "text"), keep_final=False)
    hit = F.lit(False)
    for lang, p in (rules or DEFINITIONS).items():
        hit = hit | ((F.col("lang") == lang) & F.rlike("line", F.lit(to_java(p))))
    role = F.when(F.trim("line") == "", "blank").when(preamble(F.col("line")), "import").when(hit, "definition").otherwise("code")
    return x.select("doc_id", "line_no", role.alias("role"))


def read_signatures(corpus: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """doc_id, line_no, line: imports and definitions only, without an opening brace at the end."""
    roles_ = line_roles(corpus, rules).where("role in ('import', 'definition')")
    x = split_lines(corpus.select("doc_id", "lang", "text"), keep_final=False).join(roles_, ["doc_id", "line_no"])
    bare = F.when(F.col("role") == "definition", F.rtrim(F.regexp_replace(F.rtrim("line"), r"\{+$", ""))).otherwise(F.col("line"))
    return x.select("doc_id", "line_no", bare.alias("line"))


def symbol_name(signature: Column, char: str = r"[\p{L}\p{N}_]") -> Column:
    """The name after a definition's words, null where there is none; char: what names are made of."""
    words = r"(?:(?:pub(?:\([a-z]+\))?|export|default|async|abstract|public|private|protected|static|unsafe|final) )*"
    kinds = r"(?:fn|struct|enum|trait|impl|type|mod|const|static|function|class|interface|def|func) "
    name = F.regexp_extract(F.trim(signature), f"^{words}{kinds}({char}+)", 1)
    return F.when(name != "", name)


#: What a pack leaves out (written for this library), and the files that describe a project.
PACK_EXTENSIONS = ["lock", "min.js", "map", "snap", "svg", "png", "jpg", "ico", "woff2", "pdf", "zip"]
PACK_MARKS = [".d.ts", ".test.", ".spec."]
MANIFESTS = ["cargo.toml", "package.json", "go.mod", "pyproject.toml", "requirements.txt", "gemfile", "composer.json", "pom.xml", "build.gradle", "mix.exs", "pubspec.yaml", "makefile", "dockerfile", "cmakelists.txt", "tsconfig.json"]


def packable(path: Column) -> Column:
    test = F.lit(True)
    for e in PACK_EXTENSIONS:
        test = test & ~path.endswith(f".{e}")
    for m in PACK_MARKS:
        test = test & ~path.contains(m)
    return test


def manifests(paths: DataFrame, depth: int = 3, most: int = 10) -> DataFrame:
    """path: the first manifests by path, any case, near the root."""
    s = _segments(F.col("path"))
    return paths.where((F.size(s) <= depth) & F.lower(F.element_at(s, -1)).isin(MANIFESTS)).orderBy("path").limit(most)


def context_pack(corpus: DataFrame, rules: dict[str, str] | None = None, many: int = 10, shown: int = 8) -> DataFrame:
    """dir, n, summary of each first folder: a large one as its first definitions, a small one as its files' first definition each."""
    keep = corpus.where(packable(F.col("path")))
    s = symbols(keep.select("doc_id", "lang", "text"), rules)
    first = s.groupBy("doc_id").agg(F.min_by("signature", "line_no").alias("signature"))
    x = keep.select("doc_id", "path", F.element_at(_segments(F.col("path")), 1).alias("dir")).join(first, "doc_id", "left")
    n = x.groupBy("dir").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("dir").orderBy(F.col("signature").isNull(), "path"))
    # a filter on the row number lets each task drop all but its first rows before the exchange
    top = x.withColumn("r", r).where(F.col("r") <= max(many, shown)).join(n, "dir").where(F.col("r") <= F.when(F.col("n") > many, shown).otherwise(many))
    item = F.when(F.col("n") > many, F.col("signature")).otherwise(F.concat_ws(": ", "path", "signature"))
    found = top.where(item.isNotNull()).groupBy("dir").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", item.alias("t")))), lambda v: v["t"]), "; ").alias("summary"))
    return n.join(found, "dir", "left").select("dir", "n", F.coalesce("summary", F.lit("")).alias("summary"))
