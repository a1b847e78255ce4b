"""Lines of texts, and what is done to runs of lines. Every window is within one text, so no task holds more than a text's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import to_java
from ..sources.tables import spread


def split_lines(docs: DataFrame, keep_final: bool = True) -> DataFrame:
    """The columns of docs but text, with line_no (from 1) and line.

    keep_final False: the lines() flavour, which has no empty line after a final line end and strips a carriage return.
    """
    rest = [c for c in docs.columns if c != "text"]
    out = spread(docs).select(*rest, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"), F.size(F.split("text", "\n", -1)).alias("of"))
    out = out.withColumn("line_no", F.col("pos") + 1)
    if not keep_final:
        out = out.where((F.col("line_no") < F.col("of")) | (F.col("line") != "")).withColumn("line", F.regexp_replace("line", "\r$", ""))
    return out.select(*rest, "line_no", "line")


def line_offsets(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, byte_offset of each line start; none after a final line end."""
    text = F.col("text")
    sizes = F.transform(F.split(text, "\n", -1), lambda x: (F.octet_length(x) + 1).cast("long"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    out = docs.select("doc_id", F.posexplode(sizes).alias("pos", "n"), F.octet_length("text").cast("long").alias("total"))
    out = out.select("doc_id", (F.col("pos") + 1).alias("line_no"), "n", "total")
    out = out.withColumn("byte_offset", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))
    return out.where(F.col("byte_offset") < F.col("total")).select("doc_id", "line_no", "byte_offset")


def dedup_consecutive(lines: DataFrame) -> DataFrame:
    """Runs of equal lines become one `line  (×N)`."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    new = F.when(F.lag("line").over(w).eqNullSafe(F.col("line")), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    out = runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.first("line").alias("line"), F.count("*").alias("n"))
    text = F.when(F.col("n") > 1, F.concat("line", F.lit("  (×"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("line"))
    return out.select("doc_id", "line_no", text.alias("line"))


def collapse_blank(lines: DataFrame) -> DataFrame:
    """A blank line after a blank line goes."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    blank = F.trim("line") == ""
    return lines.withColumn("blank", blank).withColumn("before", F.lag("blank").over(w)).where(~(F.col("blank") & F.coalesce("before", F.lit(False)))).select("doc_id", "line_no", "line")


def numbered(lines: DataFrame) -> DataFrame:
    """seq (from 1) and total of each line in its text."""
    w = Window.partitionBy("doc_id")
    return lines.withColumn("seq", F.row_number().over(w.orderBy("line_no"))).withColumn("total", F.count("*").over(w))


def _omitted(n: Column) -> Column:
    return F.concat(F.lit("… ("), n.cast("string"), F.lit(" lines omitted)"))


def _window_of(lines: DataFrame, first: int, last: int) -> DataFrame:
    """The first and last lines of each text; the first line left out becomes a marker that tells how many are."""
    x = numbered(lines)
    inside = (F.col("total") <= first + last) | (F.col("seq") <= first) | (F.col("seq") > F.col("total") - last)
    text = F.when(inside, F.col("line")).otherwise(_omitted(F.col("total") - first - last))
    return x.where(inside | (F.col("seq") == first + 1)).select("doc_id", "line_no", text.alias("line"))


def head(lines: DataFrame, n: int) -> DataFrame:
    return _window_of(lines, n, 0)


def tail(lines: DataFrame, n: int) -> DataFrame:
    return _window_of(lines, 0, n)


def cap(lines: DataFrame, n: int) -> DataFrame:
    """At most n lines of a text: 60 % from its head, the rest from its tail, and a marker line between."""
    return _window_of(lines, n * 3 // 5, n - n * 3 // 5)


def keep_lines(lines: DataFrame, patterns: list[str]) -> DataFrame:
    return lines.where(_any(F.col("line"), patterns))


def drop_lines(lines: DataFrame, patterns: list[str]) -> DataFrame:
    return lines.where(~_any(F.col("line"), patterns))


def _any(line: Column, patterns: list[str]) -> Column:
    test = F.lit(False)
    for p in patterns:
        test = test | F.rlike(line, F.lit(to_java(p)))
    return test


def replace_lines(lines: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Replacements in order; lines that are empty afterwards go."""
    line = F.col("line")
    for pattern, by in rules:
        line = F.regexp_replace(line, F.lit(to_java(pattern)), F.lit(by))
    return lines.withColumn("line", line).where("line <> ''")


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, "\x1b\\[[0-9;]*[a-zA-Z]", "")


def truncate(line: Column, n: int) -> Column:
    """At most n characters, then an ellipsis."""
    return F.when(F.char_length(line) > n, F.concat(F.left(line, F.lit(n)), F.lit("…"))).otherwise(line)


ERRORS = r"(?i)(error|warning|fail|panic|exception|fatal|critical)"


def errors_only(lines: DataFrame) -> DataFrame:
    """Lines that speak of trouble; a text without any gets the line `[ok] No errors`."""
    hit = F.rlike("line", F.lit(ERRORS))
    x = lines.withColumn("hit", hit).withColumn("any", F.max("hit").over(Window.partitionBy("doc_id"))).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    line = F.when(F.col("hit"), F.col("line")).otherwise(F.lit("[ok] No errors"))
    return x.where(F.col("hit") | (~F.col("any") & (F.col("seq") == 1))).select("doc_id", "line_no", line.alias("line"))
