"""Usage queries: events stand for past runs, conversations for session logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from ..sources import tables as T
from .registry import query

H = """(SELECT ts, event_type AS cmd, i AS in_bytes, o AS out_bytes, project, greatest(i - o, 0) AS saved FROM (SELECT ts, event_type, floor(value * 10)::BIGINT AS i, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS o, user_id AS project FROM events))"""
NOW = "(SELECT max(ts) AS now FROM events)"
PCT = "round(CASE WHEN {1} > 0 THEN {0} * 100.0::DOUBLE / {1} ELSE 0 END, 6)"
KEYED = "SELECT {0} AS {1}, count(*) AS n, sum(in_bytes)::BIGINT AS in_bytes, sum(saved)::BIGINT AS saved, " + PCT.format("sum(saved)", "sum(in_bytes)") + " AS avg_pct FROM " + H + " GROUP BY ALL"


def _h(spark, d):
    return U.history_from_events(T.read(spark, d, "events"))


def _now(spark, d):
    return T.read(spark, d, "events").agg(F.max("ts").alias("now"))


@query(f"SELECT commands, in_bytes, out_bytes, greatest(in_bytes - out_bytes, 0) AS saved, {PCT.format('greatest(in_bytes - out_bytes, 0)', 'in_bytes')} AS pct FROM (SELECT count(*) AS commands, sum(in_bytes)::BIGINT AS in_bytes, sum(out_bytes)::BIGINT AS out_bytes FROM {H})")
def gain_dashboard(spark, d):
    return U.dashboard(_h(spark, d))


@query(KEYED.format("cmd", "cmd") + " ORDER BY saved DESC, cmd LIMIT 20")
def gain_by_command(spark, d):
    return U.by_command(_h(spark, d))


@query(KEYED.format("project", "project") + " ORDER BY saved DESC, project LIMIT 20")
def gain_by_project(spark, d):
    return U.by_key(_h(spark, d), F.col("project"), "project").orderBy(F.desc("saved"), "project").limit(20)


@query(f"SELECT cmd, n FROM (SELECT cmd || ':' || project AS cmd, count(*) AS n, sum(CASE WHEN project % 5 = 0 THEN 0 ELSE saved END) AS s FROM {H} GROUP BY 1) WHERE s = 0 ORDER BY n DESC, cmd LIMIT 10")
def gain_usage_only(spark, d):
    return U.usage_only(_h(spark, d).withColumn("saved", F.when(F.pmod("project", F.lit(5)) == 0, 0).otherwise(F.col("saved"))).withColumn("cmd", F.concat_ws(":", "cmd", F.col("project").cast("string"))))


@query(KEYED.format("strftime(ts, '%Y-%m-%d')", "bucket") + " ORDER BY bucket DESC LIMIT 30")
def gain_daily(spark, d):
    return U.bucketed(_h(spark, d), "day")


@query(KEYED.format("strftime(ts, '%G-W%V')", "bucket") + " ORDER BY bucket DESC LIMIT 30")
def gain_weekly(spark, d):
    return U.bucketed(_h(spark, d), "week")


@query(KEYED.format("strftime(ts, '%Y-%m')", "bucket") + " ORDER BY bucket DESC LIMIT 30")
def gain_monthly(spark, d):
    return U.bucketed(_h(spark, d), "month")


@query(f"SELECT day::DATE AS day, coalesce(s, 0)::BIGINT AS saved FROM (SELECT unnest(generate_series((now::DATE - 13)::TIMESTAMP, now::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM {NOW}) LEFT JOIN (SELECT ts::DATE AS dd, sum(saved) AS s FROM {H} WHERE cmd = 'purchase' GROUP BY 1) ON day = dd")
def gain_graph_dense(spark, d):
    return U.daily_graph(_h(spark, d).where("cmd = 'purchase'"), _now(spark, d))


@query(f"""SELECT s AS saved, round(span, 6) AS span_days, m AS bytes_month, (m // 4)::BIGINT AS tokens_month, round(m / 4 / 400000, 6) AS turns FROM (SELECT s, span, floor(s / span * 30)::BIGINT AS m FROM (
  SELECT sum(saved)::BIGINT AS s, greatest(1.0::DOUBLE, (floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400.0::DOUBLE) AS span FROM {H}, {NOW} WHERE ts >= now - INTERVAL 30 DAY))""")
def gain_quota(spark, d):
    return U.quota(_h(spark, d), _now(spark, d))


@query(f"""SELECT *, n_this - n_last AS n_delta, saved_this - saved_last AS saved_delta FROM (SELECT count(*) FILTER (a) AS n_this, count(*) FILTER (b) AS n_last, coalesce(sum(saved) FILTER (a), 0)::BIGINT AS saved_this, coalesce(sum(saved) FILTER (b), 0)::BIGINT AS saved_last
  FROM (SELECT saved, ts > now - INTERVAL 7 DAY AS a, ts <= now - INTERVAL 7 DAY AND ts > now - INTERVAL 14 DAY AS b FROM {H}, {NOW}))""")
def gain_compare(spark, d):
    return U.compare(_h(spark, d), _now(spark, d))


@query(f"SELECT (s // 4)::BIGINT AS tokens_saved, round((s // 4) / 1e6::DOUBLE * 3, 6) AS usd_saved, {PCT.format('s', 'i')} AS pct FROM (SELECT sum(in_bytes)::BIGINT AS i, sum(saved)::BIGINT AS s FROM {H})")
def economics(spark, d):
    return U.economics(_h(spark, d))


@query(f"SELECT ts, cmd, in_bytes, out_bytes, project, saved FROM {H} ORDER BY ts DESC, project DESC, cmd, in_bytes LIMIT 50")
def history_recent(spark, d):
    return U.recent(_h(spark, d))


# the first word of a turn decides which command it stands for
_WORDS = ["own", "cat", "grep", "ls", "make", "find"]
_CMD = "(SELECT conv_id, turn, ['own', 'cat', 'grep', 'ls', 'make', 'find'][(conv_id % 6) + 1] || ' x' || (turn % 3) AS command, text FROM conversations)"
_LABEL = "CASE split_part(command, ' ', 1) WHEN 'cat' THEN 'read' WHEN 'grep' THEN 'search' WHEN 'find' THEN 'files' END"


def _commands(spark, d):
    word = F.element_at(F.array(*map(F.lit, _WORDS)), F.pmod("conv_id", F.lit(6)).cast("int") + 1)
    command = F.concat(word, F.lit(" x"), F.pmod("turn", F.lit(3)).cast("string"))
    return T.read(spark, d, "conversations").select("conv_id", "turn", command.alias("command"), "text")




@query(f"""SELECT total, own, missed, round(CASE WHEN own + missed > 0 THEN own * 100.0::DOUBLE / (own + missed) ELSE 100 END, 6) AS adoption FROM (
  SELECT count(*) AS total, count(*) FILTER (command LIKE 'own %') AS own, count(*) FILTER (NOT command LIKE 'own %' AND {_LABEL} IS NOT NULL) AS missed FROM {_CMD})""")
def session_adoption(spark, d):
    return U.adoption(_commands(spark, d), F.col("command").startswith("own "), U.missed_label(F.col("command")))


@query(f"SELECT {_LABEL} AS label, count(*) AS n FROM {_CMD} WHERE NOT command LIKE 'own %' AND {_LABEL} IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 10")
def missed_savings(spark, d):
    return U.missed(_commands(spark, d), F.col("command").startswith("own "), U.missed_label(F.col("command")))


_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in U.CLASSES) + " ELSE 'Other error' END"


@query(f"SELECT conv_id, turn, {_CLASS} AS class FROM conversations")
def error_classes(spark, d):
    return T.read(spark, d, "conversations").select("conv_id", "turn", U.error_class(F.col("text")).alias("class"))


_RUNS = f"(SELECT conv_id AS session, turn AS seq, 0 AS n, command, length(text) % 3 = 0 AS failed, text AS output FROM {_CMD})"


@query(f"""SELECT class, count(*) AS n, arg_min(command, session * 100000 + seq) AS wrong, arg_min(nx, session * 100000 + seq) AS "right" FROM (
  SELECT *, {_CLASS.replace('(text,', '(output,')} AS class FROM (SELECT *, lead(command) OVER w AS nx, lead(failed) OVER w AS nf FROM {_RUNS} WINDOW w AS (PARTITION BY session ORDER BY seq))
  WHERE failed AND nx IS NOT NULL AND NOT nf AND split_part(command, ' ', 1) = split_part(nx, ' ', 1) AND command <> nx) GROUP BY class""")
def corrections(spark, d):
    runs = _commands(spark, d).select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.lit(0).alias("n"), "command", (F.pmod(F.char_length("text"), F.lit(3)) == 0).alias("failed"), F.col("text").alias("output"))
    return U.corrections(runs)


@query("""SELECT a.conv_id AS session, a.turn AS seq, 0 AS n, 'run ' || a.turn AS command, coalesce(u.turn % 2 = 1 OR regexp_matches(u.text, '(?i)(error|not found|no such file|unknown flag|unexpected argument|permission denied|command not found|cannot find|fatal:|failed to|unrecognized option)'), false) AS failed, coalesce(u.text, '') AS output
FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user' WHERE a.role = 'assistant'""")
def tool_result_join(spark, d):
    """Each assistant turn calls a tool; the user turn after it, if any, holds the result. The turns pass through session JSON."""
    c = T.read(spark, d, "conversations")
    call = F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.struct(F.concat(F.lit("run "), F.col("turn").cast("string")).alias("command")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")).alias("tool_use_id"), F.col("text").alias("content"), (F.pmod("turn", F.lit(2)) == 1).alias("is_error"))
    value = F.when(F.col("role") == "assistant", F.to_json(F.struct("role", F.array(call).alias("content")))).otherwise(F.to_json(F.struct("role", F.array(result).alias("content"))))
    lines = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), value.alias("value"))
    return U.executions(U.session_blocks(lines))


@query(f"""SELECT key, count(*) AS n, sum(b)::BIGINT AS bytes FROM (SELECT split_part(command, ' ', 1) AS key, CASE split_part(command, ' ', 1) WHEN 'cat' THEN 2000 WHEN 'grep' THEN 3000 WHEN 'ls' THEN 300 WHEN 'find' THEN 500 END AS b FROM {_CMD}) WHERE key IN ('cat', 'grep', 'ls', 'find') GROUP BY key""")
def missed_estimate(spark, d):
    return U.missed_savings_estimate(_commands(spark, d))


@query("SELECT conv_id AS ts, 'run ' || turn AS command FROM conversations WHERE role = 'assistant' UNION ALL SELECT 0, 'sub ' || turn FROM conversations WHERE role = 'user'")
def nested_session_commands(spark, d):
    """Assistant turns as messages with a numeric time, user turns as progress messages with a textual one."""
    c = T.read(spark, d, "conversations")
    call = lambda word: F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit(f" {word} "), F.col("turn").cast("string")).alias("command")).alias("input"))
    a = F.to_json(F.struct(F.lit("assistant").alias("type"), F.col("conv_id").alias("timestamp"), F.struct(F.array(call("run")).alias("content")).alias("message")))
    p = F.to_json(F.struct(F.lit("progress").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.struct(F.struct(F.struct(F.array(call("sub")).alias("content")).alias("message")).alias("message")).alias("data")))
    return U.nested_commands(c.select(F.when(F.col("role") == "assistant", a).when(F.col("role") == "user", p).otherwise(F.lit("not json")).alias("value")))


@query(f"""SELECT *, n_a - n_b AS n_delta, saved_a - saved_b AS saved_delta FROM (SELECT count(*) FILTER (a) AS n_a, coalesce(sum(in_bytes) FILTER (a), 0)::BIGINT AS in_bytes_a, coalesce(sum(out_bytes) FILTER (a), 0)::BIGINT AS out_bytes_a, coalesce(sum(saved) FILTER (a), 0)::BIGINT AS saved_a,
  count(*) FILTER (b) AS n_b, coalesce(sum(in_bytes) FILTER (b), 0)::BIGINT AS in_bytes_b, coalesce(sum(out_bytes) FILTER (b), 0)::BIGINT AS out_bytes_b, coalesce(sum(saved) FILTER (b), 0)::BIGINT AS saved_b
  FROM (SELECT *, ts >= now::DATE - 6 AND floor(epoch(ts)) < floor(epoch(now)) AS a, ts >= now::DATE - 13 AND ts < now::DATE - 6 AS b FROM {H}, {NOW}))""")
def gain_compare_calendar(spark, d):
    return U.compare_periods(_h(spark, d), _now(spark, d))
