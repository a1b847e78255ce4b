"""Results as text, one row a line, ready to be written or shown; and records of what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matches_text(context: DataFrame) -> DataFrame:
    """doc_id, seq, text: context rows(doc_id, line_no, line, is_context) as `n:line` for matches and `n-line` around them, `--` between
    lines that don't follow each other."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = context.withColumn("gap", F.coalesce(F.col("line_no") - F.lag("line_no").over(w) > 1, F.lit(False)))
    own = F.concat(F.col("line_no").cast("string"), F.when(F.col("is_context"), "-").otherwise(":"), "line")
    x = x.select("doc_id", "line_no", F.posexplode(F.when(F.col("gap"), F.array(F.lit("--"), own)).otherwise(F.array(own))).alias("part", "text"))
    return x.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "part")).alias("seq"), "text")


def table_text(rows: DataFrame, order: list[str], width: int = 24) -> DataFrame:
    """seq, text: the columns of a small result (a report of a bounded number of rows) as text in columns, in the given order."""
    cell = lambda c: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), width, " ")
    x = rows.withColumn("seq", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return x.select("seq", F.rtrim(F.concat(*[cell(c) for c in rows.columns])).alias("text"))


def command_output(runs: DataFrame) -> DataFrame:
    """runs(stdout, stderr) with text: what a command wrote, its errors last."""
    return runs.withColumn("text", F.concat(F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))))


def write_manifest(entries: DataFrame, folder: str) -> None:
    """A registry of entries, a JSON object a line, replaced as a whole."""
    entries.write.mode("overwrite").json(folder)


def read_manifest(spark, folder: str, schema: str) -> DataFrame:
    """The entries of a manifest; lines that aren't JSON objects are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
