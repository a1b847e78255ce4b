"""Housekeeping, formatting, command, JSON, difference and stream queries. Orders stand for cache entries and saved outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import housekeeping as H
from ..sources import tables as T
from ..streaming import watch as W
from .registry import query


def _cache(spark, d):
    return T.read(spark, d, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("dir"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("last_used"))


@query("""SELECT root, dir, size FROM (SELECT o_custkey AS root, o_orderkey AS dir, o_totalprice AS size, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total,
  coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) WHERE total - before > 1500000""")
def lru_prune(spark, d):
    return H.lru_prune(_cache(spark, d), F.lit(1_500_000.0), ["root"])


@query("""SELECT CASE WHEN c_custkey IS NULL THEN 'orphan' ELSE 'stale' END AS reason, count(*) AS n, round(sum(o_totalprice), 2) AS freed FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey
WHERE c_custkey IS NULL OR o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 400 DAY GROUP BY 1""")
def gc_report(spark, d):
    roots = T.read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("root"))
    cache = _cache(spark, d)
    now = cache.agg(F.max("last_used").alias("now"))
    return H.gc_report(cache.crossJoin(F.broadcast(now)), roots, F.col("now"), 400)  # now: one row


@query("SELECT name, modified FROM (SELECT o_orderkey AS name, o_orderdate AS modified FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 HOUR) ORDER BY modified DESC, name LIMIT 20")
def tee_rotation(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("modified"))
    now = o.agg(F.max("modified").alias("now"))
    return H.tee_rotation(o.crossJoin(F.broadcast(now)), F.col("now")).select("name", "modified")  # now: one row


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' AND l_extendedprice > 500 AND l_extendedprice > l_quantity * 1500 * 2")
def tee_keep(spark, d):
    x = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("exit"), F.col("l_extendedprice").alias("raw"), (F.col("l_quantity") * 1500).alias("shown"))
    return H.tee_keep(x).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN 'Untrusted' WHEN doc_id % 3 = 1 THEN 'Trusted' ELSE 'ContentChanged' END AS status FROM documents")
def trust_status(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.pmod("doc_id", F.lit(3)).alias("m"))
    trusted = docs.where("m > 0").select("path", F.sha2(F.when(F.col("m") == 1, F.col("content")).otherwise(F.concat("content", F.lit("x"))), 256).alias("sha256"))
    return H.trust_status(docs, trusted)


@query("SELECT name, CASE WHEN regexp_matches(name, '(?i)(KEY|SECRET|TOKEN|PASS|CREDENTIAL|AUTH)') THEN left(value, 4) || '****' ELSE value END AS value FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'API_KEY_' WHEN 1 THEN 'HOME_' ELSE 'db_password_' END || c_custkey AS name, c_name AS value FROM customer)")
def mask_sensitive(spark, d):
    prefix = F.element_at(F.array(F.lit("API_KEY_"), F.lit("HOME_"), F.lit("db_password_")), F.pmod("c_custkey", F.lit(3)).cast("int") + 1)
    return H.environment(T.read(spark, d, "customer").select(F.concat(prefix, F.col("c_custkey").cast("string")).alias("name"), F.col("c_name").alias("value")))


@query("SELECT split_part(p_type, ' ', 1) AS prefix, count(*) AS n FROM part GROUP BY 1")
def env_prefix_groups(spark, d):
    return H.prefix_groups(T.read(spark, d, "part").select(F.regexp_replace("p_type", " ", "_").alias("name")))


@query("""SELECT CASE WHEN n >= 1073741824 THEN ((n * 10 + 536870912) // 1073741824) // 10 || '.' || ((n * 10 + 536870912) // 1073741824) % 10 || ' GB' WHEN n >= 1048576 THEN ((n * 10 + 524288) // 1048576) // 10 || '.' || ((n * 10 + 524288) // 1048576) % 10 || ' MB' WHEN n >= 1024 THEN ((n * 10 + 512) // 1024) // 10 || '.' || ((n * 10 + 512) // 1024) % 10 || ' KB' ELSE n || ' B' END AS shown, o_orderkey
FROM (SELECT o_orderkey, (floor(o_totalprice) * (o_orderkey % 700))::BIGINT AS n FROM orders)""")
def format_bytes(spark, d):
    n = (F.floor("o_totalprice").cast("long") * F.pmod("o_orderkey", F.lit(700))).cast("long")
    return T.read(spark, d, "orders").select("o_orderkey", X.format_bytes(n).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000 THEN ((n * 10 + 500000) // 1000000) // 10 || '.' || ((n * 10 + 500000) // 1000000) % 10 || 'M' WHEN n >= 1000 THEN ((n * 10 + 500) // 1000) // 10 || '.' || ((n * 10 + 500) // 1000) % 10 || 'K' ELSE n::VARCHAR END AS shown, CASE WHEN n >= 86400 THEN (n // 86400) || 'd' WHEN n >= 3600 THEN (n // 3600) || 'h' WHEN n >= 60 THEN (n // 60) || 'm' ELSE n || 's' END AS age FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders)")
def format_number(spark, d):
    n = F.floor("o_totalprice").cast("long")
    return T.read(spark, d, "orders").select("o_orderkey", X.format_number(n).alias("shown"), X.format_age(n).alias("age"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 ELSE NULL END::BIGINT AS bytes FROM part")
def parse_size(spark, d):
    unit = F.element_at(F.array(F.lit(""), F.lit("KB"), F.lit(" m"), F.lit("X")), F.pmod("p_size", F.lit(4)) + 1)
    return T.read(spark, d, "part").select("p_partkey", X.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def iso_week(spark, d):
    return T.read(spark, d, "orders").select("o_orderkey", X.iso_week(F.col("o_orderdate")).alias("week"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("""SELECT page_id, CASE WHEN strlen(url) > 60 AND len(string_split(url, '/')) > 3 THEN string_split(url, '/')[1] || '/.../' || array_to_string(string_split(url, '/')[-2:], '/') ELSE url END AS short,
  rtrim(left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-') AS slug FROM pages""")
def elide_and_slug(spark, d):
    return T.read(spark, d, "pages").select("page_id", X.elide_path(F.col("url")).alias("short"), X.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, n, CASE WHEN length(s) > 60 THEN left(s, 39) || '…' || right(s, 20) ELSE s END AS short FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+', '') AS s FROM documents)")
def truncate_middle(spark, d):
    lines = T.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return lines.select("doc_id", (F.col("p") + 1).alias("n"), X.truncate_middle(F.col("line"), 60).alias("short"))


_STATUS = "(SELECT CASE doc_id % 5 WHEN 0 THEN ' M' WHEN 1 THEN 'A ' WHEN 2 THEN ' D' WHEN 3 THEN '??' ELSE 'R ' END AS c, 'f' || lpad(doc_id::VARCHAR, 6, '0') AS p FROM documents)"


@query(f"""SELECT status, n, CASE WHEN status = 'untracked' AND n > 5 THEN p3 || ' + ' || (n - 3) || ' more' ELSE p5 END AS names FROM (SELECT CASE trim(c) WHEN 'M' THEN 'modified' WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN '??' THEN 'untracked' ELSE 'other' END AS status, count(*) AS n,
  array_to_string(list_sort(list(p))[1:3], ', ') AS p3, array_to_string(list_sort(list(p))[1:5], ', ') AS p5 FROM {_STATUS} GROUP BY 1)""")
def git_status_groups(spark, d):
    code = F.element_at(F.array(*map(F.lit, [" M", "A ", " D", "??", "R "])), F.pmod("doc_id", F.lit(5)).cast("int") + 1)
    return H.status_groups(T.read(spark, d, "documents").select(F.concat(code, F.lit(" f"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("line")))


@query("SELECT DISTINCT source AS path, unnest(range(doc_id, doc_id + (doc_id % 4)))::INT AS line_no FROM documents")
def hunk_lines(spark, d):
    n = F.pmod("doc_id", F.lit(4)).cast("string")
    head = F.concat(F.lit("@@ -1,2 +"), F.col("doc_id").cast("string"), F.when(n == "1", "").otherwise(F.concat(F.lit(","), n)), F.lit(" @@ x"))
    return H.hunk_lines(T.read(spark, d, "documents").select(F.col("source").alias("path"), head.alias("line")))


@query("SELECT p_brand AS path, 'dependencies' AS section, 'lib' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN '1.' || p_size ELSE '2.' || p_size END AS version FROM part")
def manifest_dependencies(spark, d):
    part = T.read(spark, d, "part")
    name = F.concat(F.lit("lib"), F.col("p_partkey").cast("string"))
    plain = F.concat(name, F.lit(' = "1.'), F.col("p_size").cast("string"), F.lit('"'))
    table = F.concat(name, F.lit(' = { version = "2.'), F.col("p_size").cast("string"), F.lit('", optional = true }'))
    deps = part.select(F.col("p_brand").alias("path"), (F.col("p_partkey") + 10).alias("line_no"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, plain).otherwise(table).alias("line"))
    heads = part.select(F.col("p_brand").alias("path")).distinct()
    lines = deps.unionByName(heads.select("path", F.lit(1).cast("long").alias("line_no"), F.lit("[package]").alias("line"))).unionByName(heads.select("path", F.lit(2).cast("long").alias("line_no"), F.lit('name = "x"').alias("line"))).unionByName(heads.select("path", F.lit(3).cast("long").alias("line_no"), F.lit("[dependencies]").alias("line")))
    return H.manifest_dependencies(lines)


_COMMANDS = ["sudo rm -rf /", "git push origin main", "cat a.txt", "FOO=1 /usr/bin/grep -n x src", "ls | wc -l", "echo hi"]


@query("""SELECT class, key, count(*) AS n FROM (SELECT (CASE o_orderkey % 6 WHEN 0 THEN 'deny' WHEN 1 THEN 'ask' WHEN 2 THEN 'rewrite' WHEN 3 THEN 'rewrite' ELSE 'passthrough' END) AS class,
  (CASE o_orderkey % 6 WHEN 0 THEN 'sudo rm' WHEN 1 THEN 'git push' WHEN 2 THEN 'cat a' WHEN 3 THEN 'grep' WHEN 4 THEN 'ls' ELSE 'echo hi' END) AS key FROM orders) GROUP BY ALL""")
def classify_commands(spark, d):
    c = T.read(spark, d, "orders").select(F.element_at(F.array(*map(F.lit, _COMMANDS)), F.pmod("o_orderkey", F.lit(6)).cast("int") + 1).alias("c"))
    return c.select(H.classify_command(F.col("c")).alias("class"), H.command_key(F.col("c")).alias("key")).groupBy("class", "key").agg(F.count("*").alias("n"))


@query("SELECT event_id, '{\"k\":\"int\"}' AS shape FROM events")
def json_shape(spark, d):
    return H.json_schema(T.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("value"))).select(F.col("id").alias("event_id"), "shape")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json(props)::VARCHAR AS compact FROM events")
def json_access(spark, d):
    return T.read(spark, d, "events").select("event_id", H.json_pointer(F.col("props"), "$.k", "bigint").alias("k"), H.compact_json(F.col("props")).alias("compact"))


@query()
def line_diff(spark, d):
    docs = T.read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("old"), F.replace("text", F.lit(". "), F.lit(".\n")).alias("new"))
    return H.line_diff(docs)


# ---- streams, in their batch form ----

@query("""SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def debounce_sessions(spark, d):
    return W.debounce(T.read(spark, d, "events"), "user_id", "1 hour")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_daily(spark, d):
    return W.tumbling(T.read(spark, d, "events"), "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 6)) AS k) GROUP BY ALL")
def activity_sliding(spark, d):
    return W.activity(T.read(spark, d, "events"), "event_type", "6 hours", "1 hour")


@query("""SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE r = 1 OR event_type = 'error' OR p = 'error' OR p <> event_type""")
def content_change_dedup(spark, d):
    """The content of a user is the last event type; an error deletes it."""
    content = F.when(F.col("event_type") != "error", F.col("event_type"))
    return W.changed_content(T.read(spark, d, "events"), "user_id", content, ["ts", "event_id"]).select("event_id")


@query("""WITH e AS (SELECT user_id AS key, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'end' ELSE 'change' END AS kind, event_type AS path FROM events),
o AS (SELECT *, sum(CASE kind WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, seq) AS open FROM e)
SELECT DISTINCT key, path, CASE WHEN open > 0 THEN (SELECT min(x.ts) FROM o x WHERE x.key = o.key AND x.kind = 'end' AND x.open = 0 AND (x.ts > o.ts OR (x.ts = o.ts AND x.seq >= o.seq))) ELSE ts END AS released FROM o WHERE kind = 'change'""")
def session_hold(spark, d):
    kind = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "purchase", "end").otherwise("change")
    e = T.read(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("path"))
    return W.held(e)


@query("SELECT event_type, string_agg(user_id::VARCHAR, ',' ORDER BY r DESC) AS items FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id) AS r FROM (SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY ALL)) WHERE r <= 20 GROUP BY event_type")
def hot_files(spark, d):
    return W.hot_files(T.read(spark, d, "events"), "event_type", "user_id")


@query("SELECT user_id AS key, max(ts) AS last FROM events GROUP BY user_id HAVING sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) <= 0 AND max(ts) < (SELECT max(ts) FROM events) - INTERVAL 300 SECOND")
def idle_prune(spark, d):
    e = T.read(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "purchase", "end").otherwise("change")
    now = e.agg(F.max("ts").alias("now"))
    x = e.select(F.col("user_id").alias("key"), "ts", kind.alias("kind"))
    return W.idle(x, F.lit(now.first()[0]))


@query("SELECT page_id, regexp_matches(lower(split_part(url, '/', -1)), '^(4033\\.html|index\\.html)$') AS main FROM pages")
def page_names(spark, d):
    name = F.lower(F.element_at(F.split("url", "/"), -1))
    return T.read(spark, d, "pages").select("page_id", name.isin("4033.html", "index.html").alias("main"))
