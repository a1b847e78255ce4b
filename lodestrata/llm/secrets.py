"""Secrets, judged by who owns them over the whole corpus (operator 8). DataFrame functions only.

Fixed patterns find assignments, access key ids and long hexadecimal strings. Besides them every token of 12 characters or more
with a letter and a digit is a candidate. The hash of each candidate value is aggregated over the corpus by owner and by
repository (here: a row's source, and the row itself): counts a (value, owner) first, then a value, so a value that a third of all
rows hold is pre-aggregated before it is shuffled. A value that `many_owners` owners or more hold is a copied example; one that
fewer hold, that is long and random enough and no placeholder, is live-looking.

Spans the method adds (kind `owned`): tokens outside the base spans that are live-looking and either are the value of a base
finding somewhere in the corpus, or are of 24 letters and digits or more, of both cases, with four digits and high entropy.

Positions come from the pieces between the matches: a match starts where the lengths of all pieces and matches before it end. Their
running totals are taken in blocks, and spans and verdicts are looked up by binary search, so a text of very many matches is no
square work.

Nulls and edges: a null text counts as empty; a null owner is one more owner; rows with a null doc_id get base spans only; repeated
rows get equal results and count as one repository; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, let, spread_join, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# the shortest accepted lengths stand in the pattern where a shorter run can't hide a longer one
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}+"
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your[_-]?|xxxx|12345678"
KINDS = ("assign", "access", "hex", "owned")
MANY_OWNERS = 3


def _running(values: Column) -> Column:
    """Running totals of a short array: every step copies what there is."""
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        return F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + v)).alias("out"))

    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def running_totals(values: Column) -> Column:
    """Running totals of an array of ints, in blocks of its length's square root, so that long arrays are no square work."""

    def blocks(v: Column, width: Column) -> Column:
        last = F.ceil(F.size(v) / width).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: _running(F.slice(v, i * width + 1, width)))

    def joined(inner: Column) -> Column:
        sums = _running(F.transform(inner, lambda x: F.get(x, F.size(x) - 1)))
        return F.flatten(F.zip_with(inner, sums, lambda x, end: let(end - F.get(x, F.size(x) - 1), lambda before: F.transform(x, lambda v: v + before))))

    total = lambda v: F.when(F.size(v) > 0, let(let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda w: blocks(v, w)), joined)).otherwise(F.array().cast("array<int>"))
    return let(values, total)


def _count_before(spans: Column, before) -> Column:
    """How many of the first elements of a sorted array are `before`: a binary search."""
    take = lambda at, step: F.when((at + step <= F.size(spans)) & before(F.get(spans, at + step - 1)), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(26, -1, -1)]), F.lit(0), take)


_ONE = "struct<start:int,kind:int,end:int,value:string>"


def _found(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """start, kind, end, value of every match, leftmost and non-overlapping, in code points."""
    item = lambda end, s: F.struct((end - s["n"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), s["v"].alias("value"))

    def spans(whole: Column) -> Column:
        named = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else whole
        ends = running_totals(F.zip_with(whole, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), lambda m, g: F.char_length(m) + F.char_length(g)))
        sizes = F.zip_with(whole, named, lambda m, v: F.struct(F.char_length(m).alias("n"), v.alias("v")))
        return F.zip_with(ends, sizes, item)

    return F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.array().cast(f"array<{_ONE}>"))


def candidates(docs: DataFrame, owner: str | None) -> DataFrame:
    """doc_id, owner, base and tokens: the spans of the fixed patterns, and other candidate tokens."""
    rows = docs.select("doc_id", (F.col(owner).cast("string") if owner else F.lit(None).cast("string")).alias("owner"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    assign = F.filter(_found(F.col("text"), ASSIGN, 0, 2), lambda x: F.char_length(x["value"]) >= 6)
    kinds = [assign, _found(F.col("text"), ACCESS, 1), _found(F.col("text"), HEX, 2)]
    tokens = F.filter(_found(F.col("text"), TOKEN, 3), lambda x: F.rlike(x["value"], F.lit("[0-9]")) & F.rlike(x["value"], F.lit("[A-Za-z]")))
    bare = lambda x: F.regexp_replace(x["value"], r"^[./=+-]+|[./=-]+$", "")
    lead = lambda x: F.char_length(x["value"]) - F.char_length(F.regexp_replace(x["value"], r"^[./=+-]+", ""))
    tokens = F.transform(tokens, lambda x: F.struct((x["start"] + lead(x)).alias("start"), x["kind"].alias("kind"), (x["start"] + lead(x) + F.char_length(bare(x))).alias("end"), bare(x).alias("value")))
    out = rows.select("doc_id", "owner", *[k.alias(f"k{i}") for i, k in enumerate(kinds)], tokens.alias("all"))

    def touched(t: Column, spans: str) -> Column:
        # matches of one kind don't overlap, so the last one that starts before the token's end reaches furthest
        last = F.get(F.col(spans), _count_before(F.col(spans), lambda x: x["start"] < t["end"]) - 1)
        return F.coalesce((F.size(spans) > 0) & (last["end"] > t["start"]), F.lit(False))

    free = F.filter("all", lambda t: (F.char_length(t["value"]) >= 12) & ~touched(t, "k0") & ~touched(t, "k1") & ~touched(t, "k2"))
    return out.select("doc_id", "owner", F.array_sort(F.concat("k0", "k1", "k2")).alias("base"), free.alias("tokens"))


def _hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 32)


def entropy(value: Column) -> Column:
    """Bits a character."""
    chars = F.split(value, "")
    n = F.char_length(value)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def ownership(found: DataFrame, many_owners: int = MANY_OWNERS) -> DataFrame:
    """h, value facts, owners, repositories and verdict (example, live or weak) of every candidate value."""
    one = lambda name, credential: F.transform(name, lambda x: F.struct(x["value"].alias("value"), F.lit(credential).alias("credential")))
    each = found.select("doc_id", "owner", F.explode(F.concat(one("base", True), one("tokens", False))).alias("c"))
    each = each.select("doc_id", F.coalesce("owner", F.lit("")).alias("owner"), _hash(F.col("c.value")).alias("h"), "c.value", "c.credential")
    by_owner = each.groupBy("h", "owner").agg(F.count_distinct("doc_id").alias("repositories"), F.max("credential").alias("credential"), F.min("value").alias("value"))
    by_value = by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("credential").alias("credential"), F.min("value").alias("value"))
    random = (entropy(F.col("value")) >= 3.0) & F.rlike("value", F.lit("[0-9]")) & ~F.rlike("value", F.lit(PLACEHOLDER)) & (F.char_length("value") >= 12)
    verdict = F.when(F.col("owners") >= many_owners, "example").when(random, "live").otherwise("weak")
    digits = F.char_length(F.regexp_replace("value", "[^0-9]", ""))
    strong = F.rlike("value", F.lit("^[A-Za-z0-9]{24,}$")) & F.rlike("value", F.lit("[A-Z]")) & F.rlike("value", F.lit("[a-z]")) & (digits >= 4) & (entropy(F.col("value")) >= 3.5)
    return by_value.select("h", "owners", "repositories", verdict.alias("verdict"), ((verdict == "live") & (F.col("credential") | strong)).alias("flag"))


def scan_secrets(docs: DataFrame, owner: str | None = "source", many_owners: int = MANY_OWNERS) -> DataFrame:
    """doc_id, base, owned: the base spans, each with its verdict, and the spans added by ownership."""
    found = durable(candidates(docs, owner))
    values = durable(ownership(found, many_owners))
    one = lambda name: F.transform(name, lambda x: _hash(x["value"]))
    wanted = found.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.array_distinct(F.concat(one("base"), one("tokens")))).alias("h")).distinct()
    facts = values.select("h", "verdict", "flag", "repositories")
    # the repositories of all values are the rows of wanted, so at most 1000 values are frequent
    frequent = max(2, (values.agg(F.sum("repositories")).first()[0] or 0) // 1000)
    answered = spread_join(wanted, facts.drop("repositories"), "h", facts.where(F.col("repositories") >= frequent).drop("repositories"), F.col("doc_id").cast("string"))
    by_doc = answered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("h", "verdict", "flag"))).alias("facts"))
    out = found.join(by_doc, "doc_id", "left")

    def fact(x: Column) -> Column:
        # hashes are sorted; what stands before the first that is not less is the one, if it is there
        own = lambda h: let(F.get(F.col("facts"), _count_before(F.col("facts"), lambda f: f["h"] <= h) - 1), lambda f: F.when(f["h"] == h, f))
        return let(_hash(x["value"]), own)

    judged = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.coalesce(fact(x)["verdict"], F.lit("weak")).alias("verdict")))
    owned = F.transform(F.filter("tokens", lambda x: F.coalesce(fact(x)["flag"], F.lit(False))), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit("live").alias("verdict")))
    return out.select("doc_id", judged.alias("base"), owned.alias("owned"))


def _is(k: int):
    return lambda x: x["kind"] == k


def op8_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    joined = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", kind(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda name, test: F.size(F.filter(name, test)).cast("long")
    return found.select(
        "doc_id",
        *[count("base", _is(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "owned"))).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
        count("base", lambda x: x["verdict"] == "live").alias("n_live"),
        count("base", lambda x: x["verdict"] == "example").alias("n_example"),
    )
