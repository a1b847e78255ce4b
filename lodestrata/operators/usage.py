"""Usage analytics over history(ts, cmd, in_bytes, out_bytes, project) and session logs. `now` is a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USD_PER_MILLION, BYTES_PER_TOKEN, TURN_TOKENS = 3.0, 4, 400_000


def saved(inp: Column, out: Column) -> Column:
    return F.greatest(inp - out, F.lit(0)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """0 where there is nothing to compare with."""
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0)), 6)


def history_from_events(events: DataFrame) -> DataFrame:
    """ts, cmd, in_bytes, out_bytes, saved, project."""
    x = events.select("ts", F.col("event_type").alias("cmd"), F.floor(F.col("value") * 10).cast("long").alias("in_bytes"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("out_bytes"), F.col("user_id").alias("project"))
    return x.withColumn("saved", saved(F.col("in_bytes"), F.col("out_bytes")))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of past runs; lines that don't parse are skipped, missing numbers are 0."""
    raw = spark.read.schema("ts long, cmd string, `in` long, out long, saved long, pct double, project string, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    num = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return raw.where("_bad is null").select(F.timestamp_seconds(num("ts")).alias("ts"), F.coalesce("cmd", F.lit("")).alias("cmd"), num("in").alias("in_bytes"), num("out").alias("out_bytes"), num("saved").alias("saved"), F.coalesce("project", F.lit("")).alias("project"))


def append_history(history: DataFrame, path: str) -> None:
    """Appends runs as JSON lines, with what they saved and the percentage to one place."""
    s = saved(F.col("in_bytes"), F.col("out_bytes"))
    pct = F.round(percent(s, F.col("in_bytes")), 1)
    history.select(F.unix_timestamp("ts").alias("ts"), "cmd", F.col("in_bytes").alias("in"), F.col("out_bytes").alias("out"), s.alias("saved"), pct.alias("pct"), "project").write.mode("append").json(path)


def since(history: DataFrame, now: Column, days: int) -> DataFrame:
    return history.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))


def dashboard(history: DataFrame) -> DataFrame:
    x = history.agg(F.count("*").alias("commands"), F.coalesce(F.sum("in_bytes"), F.lit(0)).alias("in_bytes"), F.coalesce(F.sum("out_bytes"), F.lit(0)).alias("out_bytes"))
    s = saved(F.col("in_bytes"), F.col("out_bytes"))
    return x.withColumn("saved", s).withColumn("pct", percent(F.col("saved"), F.col("in_bytes")))


def by_key(history: DataFrame, key: Column, name: str) -> DataFrame:
    x = history.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.sum("in_bytes").alias("in_bytes"), F.sum("saved").alias("saved"))
    return x.withColumn("avg_pct", percent(F.col("saved"), F.col("in_bytes")))


def by_command(history: DataFrame, top: int = 20) -> DataFrame:
    return by_key(history, F.col("cmd"), "cmd").orderBy(F.desc("saved"), "cmd").limit(top)


def usage_only(history: DataFrame, top: int = 10) -> DataFrame:
    """Commands that never saved anything, most used first."""
    return by_key(history, F.col("cmd"), "cmd").where("saved = 0").select("cmd", "n").orderBy(F.desc("n"), "cmd").limit(top)


def bucketed(history: DataFrame, unit: str, newest: int = 30) -> DataFrame:
    """day, week (ISO) or month buckets, the newest ones."""
    ts = F.col("ts")
    key = {
        "day": F.date_format(ts, "yyyy-MM-dd"),
        "week": F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts)),
        "month": F.date_format(ts, "yyyy-MM"),
    }[unit]
    return by_key(history, key, "bucket").orderBy(F.desc("bucket")).limit(newest)


def daily_graph(history: DataFrame, now: DataFrame, days: int = 14) -> DataFrame:
    """day, saved of the last days, 0 where nothing happened. now: one row, column now."""
    day = now.select(F.explode(F.sequence(F.date_sub(F.to_date("now"), days - 1), F.to_date("now"))).alias("day"))
    sums = history.groupBy(F.to_date("ts").alias("day")).agg(F.sum("saved").alias("saved"))
    return day.join(sums, "day", "left").select("day", F.coalesce("saved", F.lit(0)).alias("saved"))


def quota(history: DataFrame, now: DataFrame, days: int = 30) -> DataFrame:
    """What a month would save at the pace of the last days: bytes, tokens, turns of a fixed size."""
    x = history.crossJoin(F.broadcast(now)).where(F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS"))  # now: one row
    span = F.greatest(F.lit(1.0), (F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))) - F.min(F.unix_timestamp(F.col("ts").cast("timestamp")))) / 86400.0)
    x = x.agg(F.sum("saved").alias("saved"), span.alias("span_days"))
    month = F.floor(F.col("saved") / F.col("span_days") * 30).cast("long")
    return x.select("saved", F.round("span_days", 6).alias("span_days"), month.alias("bytes_month"), F.floor(month / BYTES_PER_TOKEN).cast("long").alias("tokens_month"), F.round(month / BYTES_PER_TOKEN / TURN_TOKENS, 6).alias("turns"))


def compare(history: DataFrame, now: DataFrame, days: int = 7) -> DataFrame:
    """This period against the one before, and the differences."""
    h = history.crossJoin(F.broadcast(now))  # now: one row
    a = F.col("ts") > F.col("now") - F.expr(f"INTERVAL {days} DAYS")
    b = ~a & (F.col("ts") > F.col("now") - F.expr(f"INTERVAL {2 * days} DAYS"))
    x = h.agg(F.count_if(a).alias("n_this"), F.count_if(b).alias("n_last"), F.coalesce(F.sum(F.when(a, F.col("saved"))), F.lit(0)).alias("saved_this"), F.coalesce(F.sum(F.when(b, F.col("saved"))), F.lit(0)).alias("saved_last"))
    return x.withColumn("n_delta", F.col("n_this") - F.col("n_last")).withColumn("saved_delta", F.col("saved_this") - F.col("saved_last"))


def period(name: str, now: Column) -> tuple[Column, Column]:
    """Start and end (exclusive) of this-day, last-day, this-week, last-week, this-month or last-month, in seconds: a week is seven days
    that end today, a month thirty."""
    which, unit = name.split("-")
    days = {"day": 1, "week": 7, "month": 30}[unit]
    start = F.floor(now / 86400) * 86400 - (days - 1) * 86400
    return (start, now) if which == "this" else (start - days * 86400, start)


def compare_periods(history: DataFrame, now: DataFrame, a: str = "this-week", b: str = "last-week") -> DataFrame:
    """One row: count, bytes in, bytes out and saved of two named periods, and the differences of count and saved."""
    h = history.crossJoin(F.broadcast(now))  # now: one row
    t, at = F.unix_timestamp(F.col("ts").cast("timestamp")), F.unix_timestamp(F.col("now").cast("timestamp"))
    sums = []
    for label, name in (("a", a), ("b", b)):
        start, end = period(name, at)
        inside = (t >= start) & (t < end)
        total = lambda c: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0))  # noqa: B023, E731
        sums += [F.count_if(inside).alias(f"n_{label}"), *[total(c).alias(f"{c}_{label}") for c in ("in_bytes", "out_bytes", "saved")]]
    x = h.agg(*sums)
    return x.withColumn("n_delta", F.col("n_a") - F.col("n_b")).withColumn("saved_delta", F.col("saved_a") - F.col("saved_b"))


def economics(history: DataFrame) -> DataFrame:
    x = history.agg(F.coalesce(F.sum("in_bytes"), F.lit(0)).alias("i"), F.coalesce(F.sum("saved"), F.lit(0)).alias("s"))
    tokens = F.floor(F.col("s") / BYTES_PER_TOKEN).cast("long")
    return x.select(tokens.alias("tokens_saved"), F.round(tokens / 1e6 * USD_PER_MILLION, 6).alias("usd_saved"), percent(F.col("s"), F.col("i")).alias("pct"))


def recent(history: DataFrame, n: int = 50) -> DataFrame:
    return history.orderBy(F.desc("ts"), F.desc("project"), "cmd", "in_bytes").limit(n)


#: What a command could have been run as, by its first word (fixed values); `ls` only with a long listing.
REPLACEABLE = {"cat": "read", "head": "read", "tail": "read", "grep": "search", "rg": "search", "find": "files", "tree": "tree", "ls": "list", "wc": "count"}
LONG_LISTING = r"(^|\s)-(la|lah|al)(\s|$)"
#: Bytes that a command's output is taken to have (fixed values); git's by its second word; any other 200.
OUTPUT_BYTES = {"cat": 2000, "head": 2000, "tail": 2000, "grep": 3000, "egrep": 3000, "fgrep": 3000, "rg": 3000, "find": 500, "tree": 1000, "ls": 300, "wc": 100}
GIT_BYTES = {"status": 400, "log": 5000, "diff": 10000, "show": 5000}
#: First words that could be run through a filter, and those for which the second word decides (fixed values).
DISCOVERABLE = ["rg", "ls", "wc", "cargo", "pytest", "ruff", "mypy", "pip", "eslint", "tsc", "vitest", "prettier", "biome", "rspec", "rubocop", "rake", "golangci-lint", "npm", "npx", "pnpm", "curl", "wget", "aws"]
DISCOVERABLE_WITH = {"docker": ["ps", "images", "logs", "build"], "kubectl": ["get", "logs", "describe"], "go": ["test", "build"], "dotnet": ["build", "test"], "gh": ["pr", "issue", "run"]}


def _word(command: Column, i: int) -> Column:
    return F.coalesce(F.get(F.split(F.trim(command), r"\s+"), F.lit(i)), F.lit(""))


def missed_label(command: Column) -> Column:
    word = _word(command, 0)
    out = F.lit(None).cast("string")
    for w, label in reversed(REPLACEABLE.items()):
        test = word == w
        out = F.when(test & F.rlike(command, F.lit(LONG_LISTING)) if w == "ls" else test, F.lit(label)).otherwise(out)
    return out


def output_estimate(command: Column) -> Column:
    out = F.lit(200)
    for w, n in OUTPUT_BYTES.items():
        out = F.when(_word(command, 0) == w, n).otherwise(out)
    git = F.lit(200)
    for w, n in GIT_BYTES.items():
        git = F.when(_word(command, 1) == w, n).otherwise(git)
    return F.when(F.trim(command) == "", 0).when((_word(command, 0) == "git") & (_word(command, 1) != ""), git).otherwise(out).cast("long")


def first_command(command: Column) -> Column:
    """The command before the first pipe or chain."""
    return F.trim(F.regexp_extract(command, r"^\s*([^|;&]*)", 1))


def discoverable(command: Column) -> Column:
    """Whether the first command of a line is of a family that a filter or another command could serve."""
    c = first_command(command)
    one, two = _word(c, 0), _word(c, 1)
    test = one.isin(DISCOVERABLE) | (one.isin("grep", "egrep", "fgrep") & F.rlike(c, F.lit(r"\s[^-\s]"))) | (one.isin("cat", "head", "tail") & (two != ""))
    test = test | ((one == "find") & ~F.rlike(c, F.lit(r"\s-(exec|delete)(\s|$)")))
    for w, seconds in DISCOVERABLE_WITH.items():
        test = test | ((one == w) & two.isin(seconds))
    return test


def adoption(commands: DataFrame, own: Column, label: Column) -> DataFrame:
    """One row a label of commands that could have been run otherwise, and one with the totals."""
    x = commands.select(own.alias("own"), label.alias("label"))
    totals = x.agg(F.count("*").alias("total"), F.count_if("own").alias("own"), F.count_if(~F.col("own") & F.col("label").isNotNull()).alias("missed"))
    both = F.col("own") + F.col("missed")
    return totals.withColumn("adoption", F.round(F.when(both > 0, F.col("own") * 100.0 / both).otherwise(F.lit(100.0)), 6))


def missed(commands: DataFrame, own: Column, label: Column, top: int = 10) -> DataFrame:
    return commands.where(~own & label.isNotNull()).groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top)


#: Signs of failure in an output, and the classes tried in this order (fixed values).
SIGNALS = r"(?i)(error|not found|no such file|unknown flag|unexpected argument|permission denied|command not found|cannot find|fatal:|failed to|unrecognized option)"
CLASSES = [("Unknown flag", r"(?i)(unknown flag|unexpected argument|unrecognized option)"), ("Command not found", r"(?i)command not found"), ("Wrong path", r"(?i)(no such file|not found|cannot find)"), ("Permission denied", r"(?i)permission denied"), ("Syntax error", r"(?i)(syntax error|parse error)")]


def error_class(text: Column) -> Column:
    out = F.lit("Other error")
    for name, pattern in reversed(CLASSES):
        out = F.when(F.rlike(text, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def session_blocks(lines: DataFrame) -> DataFrame:
    """session, seq, role, kind, name, id, command, result, is_error of the blocks in JSON session lines(session, seq, value).

    Lines that don't parse, and messages whose content is no array, are skipped.
    """
    block = "struct<type:string,name:string,id:string,input:struct<command:string>,tool_use_id:string,content:string,is_error:boolean>"
    x = lines.select("session", "seq", F.from_json("value", f"role string, content array<{block}>").alias("m"))
    x = x.select("session", "seq", "m.role", F.posexplode("m.content").alias("n", "b"))
    return x.select("session", "seq", "n", "role", F.col("b.type").alias("kind"), "b.name", F.coalesce("b.id", "b.tool_use_id").alias("id"), F.col("b.input.command").alias("command"), F.col("b.content").alias("result"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))


def executions(blocks: DataFrame) -> DataFrame:
    """session, seq, command, failed, output: shell calls with their results; a call without a result has not failed."""
    calls = blocks.where("role = 'assistant' and kind = 'tool_use' and name = 'Bash' and command is not null").select("session", "seq", "n", "id", "command")
    results = blocks.where("role = 'user' and kind = 'tool_result'").groupBy("session", "id").agg(F.max_by(F.struct("is_error", "result"), F.struct("seq", "n")).alias("r"))
    x = calls.join(results, ["session", "id"], "left")
    output = F.coalesce("r.result", F.lit(""))
    return x.select("session", "seq", "n", "command", (F.coalesce("r.is_error", F.lit(False)) | F.rlike(output, F.lit(SIGNALS))).alias("failed"), output.alias("output"))


def corrections(runs: DataFrame) -> DataFrame:
    """error class, n, and the first example: a failed run directly followed by one that succeeds with the same first word."""
    w = Window.partitionBy("session").orderBy("seq", "n")
    x = runs.withColumn("next", F.lead(F.struct("command", "failed")).over(w))
    word = lambda c: F.split_part(F.trim(c), F.lit(" "), F.lit(1))
    x = x.where(F.col("failed") & F.col("next").isNotNull() & ~F.col("next.failed") & (word(F.col("command")) == word(F.col("next.command"))) & (F.col("command") != F.col("next.command")))
    first = F.min_by(F.struct(F.col("command").alias("wrong"), F.col("next.command").alias("right")), F.struct("session", "seq", "n"))
    x = x.groupBy(error_class(F.col("output")).alias("class")).agg(F.count("*").alias("n"), first.alias("e"))
    return x.select("class", "n", "e.wrong", "e.right")


def nested_commands(lines: DataFrame) -> DataFrame:
    """command, ts of shell calls in nested session JSON lines(value): assistant messages, and progress messages of subagents.

    Commands are trimmed, those of 500 bytes or more are left out; only a numeric timestamp counts (0 otherwise).
    """
    block = "struct<type:string,name:string,input:struct<command:string>>"
    inner = f"struct<content:array<{block}>>"
    x = lines.select(F.from_json("value", f"type string, timestamp string, message {inner}, data struct<message:struct<message:{inner}>>").alias("m"))
    content = F.when(F.col("m.type") == "assistant", F.col("m.message.content")).when(F.col("m.type") == "progress", F.col("m.data.message.message.content"))
    x = x.select(F.coalesce(F.try_to_number("m.timestamp", F.lit("9999999999999")).cast("long"), F.lit(0).cast("long")).alias("ts"), F.explode(content).alias("b"))
    x = x.where("b.type = 'tool_use' and b.name = 'Bash'").select(F.trim("b.input.command").alias("command"), "ts")
    return x.where((F.col("command") != "") & (F.octet_length("command") < 500))


def missed_savings_estimate(commands: DataFrame) -> DataFrame:
    """key, n, bytes: commands that could be served otherwise, with the output they are taken to have."""
    x = commands.where(discoverable(F.col("command"))).select(first_command(F.col("command")).alias("c"), output_estimate(F.col("command")).alias("b"))
    return x.groupBy(_word(F.col("c"), 0).alias("key")).agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))


def shell_history(lines: DataFrame) -> DataFrame:
    """command of shell history lines(value): blanks and comments left out, the time prefix of the extended form stripped."""
    x = lines.select(F.regexp_replace(F.trim("value"), r"^: \d+:\d+;", "").alias("command"))
    return x.where((F.col("command") != "") & ~F.col("command").startswith("#"))
