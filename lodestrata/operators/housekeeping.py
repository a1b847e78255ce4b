"""Caches, saved outputs, trust, environments, manifests, and change lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_sensitive


def lru_prune(cache: DataFrame, most: Column, key: list[str]) -> DataFrame:
    """key, dir, size: the entries that go, least recently used first, until what is left of a key's entries fits."""
    w = Window.partitionBy(*key).orderBy("last_used", "dir")
    x = cache.withColumn("before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("total", F.sum("size").over(Window.partitionBy(*key)))
    return x.where(F.col("total") - F.col("before") > most).select(*key, "dir", "size")


def gc_report(cache: DataFrame, roots: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """reason, n, freed: orphans (their root is gone), and stale entries (unused for days)."""
    x = cache.join(roots.select("root", F.lit(True).alias("alive")), "root", "left")
    reason = F.when(F.col("alive").isNull(), "orphan").when(F.col("last_used") < now - F.expr(f"INTERVAL {days} DAYS"), "stale")
    return x.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum("size"), 2).alias("freed"))


def tee_keep(outputs: DataFrame, min_bytes: int = 500, ratio: float = 2.0) -> DataFrame:
    """Raw outputs worth saving: of failed runs, over a size, and shortened by more than a ratio."""
    return outputs.where((F.col("exit") != 0) & (F.col("raw") > min_bytes) & (F.col("raw") > F.col("shown") * ratio))


def tee_rotation(saved: DataFrame, now: Column, most: int = 20, hours: int = 24) -> DataFrame:
    """Saved outputs that stay: the newest ones, none older than a day."""
    fresh = saved.where(F.col("modified") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    return fresh.orderBy(F.desc("modified"), "name").limit(most)


def trust_status(files: DataFrame, trusted: DataFrame) -> DataFrame:
    """path, status: Trusted, Untrusted (unknown) or ContentChanged, by the sha256 of the content."""
    x = files.select("path", F.sha2("content", 256).alias("sha")).join(trusted.select("path", F.col("sha256").alias("known")), "path", "left")
    return x.select("path", F.when(F.col("known").isNull(), "Untrusted").when(F.col("known") == F.col("sha"), "Trusted").otherwise("ContentChanged").alias("status"))


def environment(env: DataFrame, name_filter: str = "") -> DataFrame:
    """name, value sorted, masked, whose names hold a text (any case)."""
    x = env.where(F.contains(F.lower("name"), F.lit(name_filter.lower())))
    return x.select("name", mask_sensitive(F.col("name"), F.col("value")).alias("value")).orderBy("name")


def prefix_groups(env: DataFrame) -> DataFrame:
    return env.groupBy(F.substring_index("name", "_", 1).alias("prefix")).agg(F.count("*").alias("n"))


STATUS = {"M": "modified", "A": "added", "D": "deleted", "??": "untracked"}


def status_groups(lines: DataFrame, shown: int = 3, most: int = 5) -> DataFrame:
    """status, n, names of porcelain status lines(line): long lists of untracked files are cut."""
    code = F.trim(F.substring("line", 1, 2))
    name = F.lit("other")
    for c, label in STATUS.items():
        name = F.when(code == c, F.lit(label)).otherwise(name)
    x = lines.select(name.alias("status"), F.substring("line", 4, 1 << 20).alias("path"))
    # a filter on the row number lets each task drop all but its first rows before the exchange
    first = x.withColumn("r", F.row_number().over(Window.partitionBy("status").orderBy("path"))).where(F.col("r") <= most)
    p = first.groupBy("status").agg(F.sort_array(F.collect_list("path")).alias("p"))
    x = x.groupBy("status").agg(F.count("*").alias("n")).join(p, "status")
    cut = F.concat(F.array_join(F.slice("p", 1, shown), ", "), F.lit(" + "), (F.col("n") - shown).cast("string"), F.lit(" more"))
    return x.select("status", "n", F.when((F.col("status") == "untracked") & (F.col("n") > most), cut).otherwise(F.array_join("p", ", ")).alias("names"))


def hunk_lines(diff: DataFrame) -> DataFrame:
    """path, line_no of lines changed on the new side of unified diff headers(path, line)."""
    m = lambda i: F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", i)
    x = diff.where(F.rlike("line", F.lit(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"))).select("path", m(1).cast("int").alias("c"), F.coalesce(F.when(m(2) != "", m(2).cast("int")), F.lit(1)).alias("d"))
    return x.where("d > 0").select("path", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("d") - 1)).alias("line_no")).distinct()


def manifest_dependencies(lines: DataFrame) -> DataFrame:
    """path, section, name, version of `name = "version"` lines under [section] headers(path, line_no, line)."""
    header = F.when(F.rlike("line", F.lit(r"^\[.*\]\s*$")), F.regexp_extract("line", r"^\[(.*)\]", 1))
    w = Window.partitionBy("path").orderBy("line_no")
    x = lines.withColumn("section", F.last(header, ignorenulls=True).over(w)).where(F.col("section").rlike("dependencies"))
    name, version = F.regexp_extract("line", r'^([A-Za-z0-9_-]+)\s*=', 1), F.regexp_extract("line", r'=\s*(?:"([^"]*)"|\{.*version\s*=\s*"([^"]*)".*\})', 1)
    inner = F.regexp_extract("line", r'version\s*=\s*"([^"]*)"', 1)
    return x.where(name != "").select("path", "section", name.alias("name"), F.when(version != "", version).otherwise(inner).alias("version"))


def dependencies(files: DataFrame) -> DataFrame:
    """path, section, name, version of the manifests among files(path, text), by file name: Cargo.toml and pyproject.toml (tables and
    arrays of dependencies), package.json, composer.json, go.mod, requirements.txt and Gemfile. version '' where none is named."""
    name = F.element_at(F.split("path", "/"), -1)
    x = files.select("path", "text", name.alias("file"))
    lines = x.select("path", "file", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    toml = manifest_dependencies(lines.where(F.col("file").isin("Cargo.toml", "pyproject.toml")).select("path", "line_no", "line"))
    # arrays of requirement strings: project.dependencies, and those of each extra
    arrays = x.where("file = 'pyproject.toml'").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^\s*dependencies\s*=\s*\[(.*?)\]\s*$"), F.lit(1))).alias("body"))
    quoted = arrays.select("path", F.lit("dependencies").alias("section"), F.explode(F.regexp_extract_all("body", F.lit("[\"']([^\"']+)[\"']"), F.lit(1))).alias("line"))
    plain = lines.where("file = 'requirements.txt'").select("path", F.lit("requirements").alias("section"), F.regexp_replace("line", r"\s+#.*$", "").alias("line"))
    wanted = quoted.unionByName(plain.where(~F.rlike("line", F.lit(r"^(#|-|$)"))))
    m = lambda i: F.regexp_extract("line", r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*([<>=!~^][^;]*)?", i)
    python = wanted.select("path", "section", m(1).alias("name"), F.trim(m(2)).alias("version")).where("name <> ''")
    sections = ["dependencies", "devDependencies", "peerDependencies", "require", "require-dev"]
    parsed = x.where(F.col("file").isin("package.json", "composer.json")).select("path", F.from_json("text", ", ".join(f"`{c}` map<string,string>" for c in sections)).alias("j"))

    def named(section: str) -> Column:
        one = F.transform(F.map_entries(F.col("j")[section]), lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("version")))
        return F.coalesce(one, F.array().cast("array<struct<section:string,name:string,version:string>>"))

    each = F.explode(F.flatten(F.array(*map(named, sections))))
    json_ = parsed.select("path", each.alias("d")).select("path", "d.*")
    go = lines.where("file = 'go.mod'")
    w = Window.partitionBy("path").orderBy("line_no")
    state = F.last(F.when(F.rlike("line", F.lit(r"^require\s*\($")), True).when(F.col("line") == ")", False), ignorenulls=True).over(w)
    go = go.withColumn("inside", F.coalesce(state, F.lit(False)))
    one = F.rlike("line", F.lit(r"^require\s+[^(\s]"))
    g = lambda i: F.regexp_extract("line", r"^(?:require\s+)?([^\s/(][^\s(]*)\s+(\S+)", i)
    go = go.where((F.col("inside") | one) & ~F.rlike("line", F.lit(r"^(//|\)|require\s*\()"))).select("path", F.lit("require").alias("section"), g(1).alias("name"), g(2).alias("version")).where("name <> ''")
    r = lambda i: F.regexp_extract("line", r"^gem\s+[\"']([^\"']+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?", i)
    ruby = lines.where("file = 'Gemfile'").select("path", F.lit("gems").alias("section"), r(1).alias("name"), r(2).alias("version")).where("name <> ''")
    return toml.unionByName(python).unionByName(json_).unionByName(go).unionByName(ruby)


DENY = r"(^|[;&|]\s*)(sudo\s+)?(rm\s+-[a-z]*r[a-z]*f|rm\s+-[a-z]*f[a-z]*r|mkfs|dd\s+if=|shutdown|reboot|chmod\s+-R\s+777\s+/)"
ASK = r"(^|[;&|]\s*)(sudo|rm|mv|kill|git\s+(push|reset|clean)|docker\s+(rm|rmi|system)|kubectl\s+delete|npm\s+publish)\b"
REWRITE = r"^(cat|head|tail|grep|rg|find|tree|ls|wc)\b"


def classify_command(command: Column) -> Column:
    """deny, ask, rewrite or passthrough; a piped or chained command isn't rewritten."""
    bare = F.regexp_replace(F.trim(command), r"^([A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", "")
    bare = F.regexp_replace(bare, r"^\S*/(?=\S)", "")
    joined = F.rlike(bare, F.lit(r"[|;&<>`]|\$\("))
    return F.when(F.rlike(bare, F.lit(DENY)), "deny").when(F.rlike(bare, F.lit(ASK)), "ask").when(F.rlike(bare, F.lit(REWRITE)) & ~joined, "rewrite").otherwise("passthrough")


def command_key(command: Column) -> Column:
    """The first word, and the second if it is no flag."""
    bare = F.regexp_replace(F.trim(command), r"^([A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", "")
    first = F.regexp_extract(bare, r"^(?:\S*/)?(\S+)", 1)
    second = F.regexp_extract(bare, r"^\S+\s+([A-Za-z][A-Za-z0-9:_-]*)", 1)
    return F.when(second != "", F.concat_ws(" ", first, second)).otherwise(first)


def rewrite_command(command: Column, tool: str = "ls2") -> Column:
    """What a rewritable command becomes: reading, searching and listing by one tool."""
    word = F.regexp_extract(command, r"^\s*(\S+)", 1)
    rest = F.trim(F.regexp_replace(F.trim(command), r"^\S+", ""))
    plain = F.trim(F.regexp_replace(rest, r"(^|\s)-[A-Za-z]+\b", " "))
    verb = F.when(word.isin("cat", "head", "tail"), "read").when(word.isin("grep", "rg"), "search").when(word == "ls", "ls").when(word == "tree", "tree").when(word == "find", "files").when(word == "wc", "count")
    return F.when(classify_command(command) == "rewrite", F.trim(F.concat_ws(" ", F.lit(tool), verb, plain))).otherwise(command)


def line_diff(pairs: DataFrame) -> DataFrame:
    """id, pos, op (same, added, removed), text of texts(id, old, new), by a longest common subsequence; ties go to additions.

    A table over two texts' lines, so Python, a text at a time; equal heads and tails are taken off first.
    """

    def diff(a: list[str], b: list[str]) -> list[tuple[str, str]]:
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        x, y = a[head : len(a) - tail], b[head : len(b) - tail]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        out = [("same", s) for s in a[:head]]
        i = j = 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                out.append(("same", x[i]))
                i, j = i + 1, j + 1
            elif i < len(x) and (j == len(y) or best[i + 1][j] >= best[i][j + 1]):
                out.append(("removed", x[i]))
                i += 1
            else:
                out.append(("added", y[j]))
                j += 1
        return out + [("same", s) for s in a[len(a) - tail :]]

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(k, n, op, t) for k, a, b in zip(batch["id"], batch["old"], batch["new"], strict=True) for n, (op, t) in enumerate(diff((a or "").splitlines(), (b or "").splitlines()))]
            yield pd.DataFrame(rows, columns=["id", "pos", "op", "text"])

    return pairs.select("id", "old", "new").mapInPandas(run, "id long, pos int, op string, text string")


def json_schema(rows: DataFrame) -> DataFrame:
    """id, shape of JSON values(id, value): names of types for values, arrays as their first element and a count; null if unparsable."""
    import json

    def shape(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "bool"
        if isinstance(v, int | float):
            return "int" if isinstance(v, int) else "float"
        if isinstance(v, str):
            return "string"
        if isinstance(v, list):
            return [shape(v[0]), f"({len(v)})"] if v else "[] (0)"
        return {k: shape(x) for k, x in v.items()}

    def one(text):
        try:
            return json.dumps(shape(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "shape": [one(v) for v in batch["value"]]})

    return rows.select("id", "value").mapInPandas(run, "id long, shape string")


def compact_json(value: Column) -> Column:
    return F.to_json(F.try_parse_json(value))


def json_pointer(value: Column, path: str, kind: str = "string") -> Column:
    """A value by path, null where there is none."""
    return F.try_variant_get(F.try_parse_json(value), path, kind)
