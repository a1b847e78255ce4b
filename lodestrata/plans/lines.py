"""Line and filter queries. The lines are those of the conversations' texts, each conversation turn one text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FI
from ..operators import lines as L
from ..sources import tables as T
from .registry import query

# the lines() flavour of documents
LINES = """(SELECT doc_id, line_no, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no, len(string_split(text, chr(10))) AS n,
  unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line_no < n OR line <> '')"""
NUM = f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq, count(*) OVER (PARTITION BY doc_id) AS total FROM {LINES})"


def _lines(spark, d):
    return L.split_lines(T.read(spark, d, "documents").select("doc_id", "text"), keep_final=False)


def _window(first: int, last: int) -> str:
    inside = f"(total <= {first + last} OR seq <= {first} OR seq > total - {last})"
    return f"SELECT doc_id, line_no, CASE WHEN {inside} THEN line ELSE '… (' || (total - {first + last}) || ' lines omitted)' END AS line FROM {NUM} WHERE {inside} OR seq = {first + 1}"


# lines rarely repeat one after another; whether they are long does
WORDS = f"(SELECT doc_id, line_no, CASE WHEN length(line) > 60 THEN 'long' ELSE 'short' END AS line FROM {LINES})"


@query(f"""SELECT doc_id, min(line_no)::INT AS line_no, CASE WHEN count(*) > 1 THEN first(line) || '  (×' || count(*) || ')' ELSE first(line) END AS line FROM (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (
    SELECT *, CASE WHEN lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) IS NOT DISTINCT FROM line THEN 0 ELSE 1 END AS new FROM {WORDS})) GROUP BY doc_id, run""")
def dedup_consecutive(spark, d):
    x = _lines(spark, d).withColumn("line", F.when(F.char_length("line") > 60, "long").otherwise("short"))
    return L.dedup_consecutive(x)


@query(f"""SELECT doc_id, line_no, line FROM (SELECT *, trim(line) = '' AS b, lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY line_no) AS p
  FROM (SELECT doc_id, line_no, CASE WHEN contains(line, 'th') THEN '' ELSE line END AS line FROM {LINES})) WHERE NOT (b AND coalesce(p, false))""")
def collapse_blank(spark, d):
    x = _lines(spark, d).withColumn("line", F.when(F.contains("line", F.lit("th")), "").otherwise(F.col("line")))
    return L.collapse_blank(x)


@query(_window(3, 0))
def head_lines(spark, d):
    return L.head(_lines(spark, d), 3)


@query(_window(0, 4))
def tail_lines(spark, d):
    return L.tail(_lines(spark, d), 4)


@query(_window(6, 4))
def head_tail_cap(spark, d):
    return L.cap(_lines(spark, d), 10)


@query(f"SELECT doc_id, line_no, line FROM {LINES} WHERE regexp_matches(line, 'ing\\.|tion') AND NOT regexp_matches(line, '^[A-M]')")
def keep_drop_lines(spark, d):
    return L.drop_lines(L.keep_lines(_lines(spark, d), [r"ing\.", "tion"]), ["^[A-M]"])


@query(f"SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '^(Th|An)[a-z]* ?', '', 'g') AS line FROM {LINES} WHERE regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '^(Th|An)[a-z]* ?', '', 'g') <> ''")
def replace_rules(spark, d):
    return L.replace_lines(_lines(spark, d), [("[0-9]+", "#"), ("^(Th|An)[a-z]* ?", "")])


@query(f"SELECT doc_id, line_no, CASE WHEN length(line) > 40 THEN left(line, 40) || '…' ELSE line END AS line FROM {LINES}")
def truncate_lines(spark, d):
    return _lines(spark, d).withColumn("line", L.truncate(F.col("line"), 40))


@query(f"""SELECT doc_id, line_no, CASE WHEN hit THEN line ELSE '[ok] No errors' END AS line FROM (
  SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM (
    SELECT doc_id, line_no, line, regexp_matches(line, '(?i)(error|warning|fail|panic|exception|fatal|critical)') AS hit FROM {LINES})) WHERE hit OR (NOT a AND seq = 1)""")
def errors_only(spark, d):
    return L.errors_only(_lines(spark, d))


_KEPT = f"(SELECT doc_id, line_no, CASE WHEN length(line) > 80 THEN left(line, 80) || '…' ELSE line END AS line FROM (SELECT doc_id, line_no, regexp_replace(line, 'the', 'THE', 'g') AS line FROM {LINES}) WHERE line <> '' AND regexp_matches(line, '[A-Z][a-z]+ing'))"


@query(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq, count(*) OVER (PARTITION BY doc_id) AS total FROM {_KEPT}),
c AS (SELECT doc_id, line_no, CASE WHEN total <= 5 OR seq <= 3 OR seq > total - 2 THEN line ELSE '… (' || (total - 5) || ' lines omitted)' END AS line FROM k WHERE total <= 5 OR seq <= 3 OR seq > total - 2 OR seq = 4)
SELECT doc_id, line_no, line FROM c UNION ALL SELECT DISTINCT doc_id, 1, 'nothing' FROM {LINES} WHERE doc_id NOT IN (SELECT doc_id FROM c)""")
def filter_pipeline(spark, d):
    spec = FI.FilterSpec("demo", ".*", strip_ansi=True, replace=[("the", "THE")], keep_lines="[A-Z][a-z]+ing", truncate_at=80, max_lines=5, on_empty="nothing")
    return spec.apply(_lines(spark, d))


_COMMANDS = """(SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'pytest -q tests' WHEN 1 THEN '/usr/bin/docker ps -a' WHEN 2 THEN 'cargo test' WHEN 3 THEN 'terraform plan' WHEN 4 THEN 'echo hi' ELSE 'git fetch origin' END AS command FROM orders)"""


@query(f"""SELECT command, CASE WHEN command LIKE 'pytest%' THEN 'unit-tests' WHEN command LIKE '%docker ps%' THEN 'container-list' WHEN command LIKE 'cargo test%' THEN 'cargo-test'
  WHEN command LIKE 'terraform%' THEN 'plans' WHEN command LIKE 'git fetch%' THEN 'git-sync' END AS filter, count(*) AS n FROM {_COMMANDS} GROUP BY ALL""")
def command_filter_join(spark, d):
    k = F.pmod("o_orderkey", F.lit(6))
    names = ["pytest -q tests", "/usr/bin/docker ps -a", "cargo test", "terraform plan", "echo hi", "git fetch origin"]
    command = F.element_at(F.array(*map(F.lit, names)), k.cast("int") + 1)
    orders = T.read(spark, d, "orders").select(command.alias("command"))
    return FI.match_commands(orders, FI.Registry()).groupBy("command", "filter").agg(F.count("*").alias("n"))
