"""Personal data and what gives it away (operator 2).

Direct identifiers (e-mail addresses, IPv4 addresses, payment cards, international phone numbers) are found by fixed patterns.
Each distinct value is a protected entity. Terms that disclose an entity are then found from co-occurrence over the corpus. All four
numbers count the same thing, families of near copies: N families in all, n_c whose text holds the entity, n_t the term, and n_ct the
term within `window` words of the entity. A term is disclosive when

    PMI(c; t) = log(n_ct N / (n_c n_t))  >=  alpha * IC(c) = alpha * log(N / n_c)    and    n_ct >= support,

that is, when knowing the term yields at least the share alpha of the entity's information content. So a text that is copied does
not make each of its words disclosive. Every word outside identifiers is a candidate term, short ones, common ones and numbers too:
the threshold alone decides. Disclosive terms are generalised wherever they stand.

A family is a connected component of links between texts whose sets of word pairs are similar: texts that share a band of their
MinHash signatures (8 bands of 3 coordinates) are compared with the least text of the band, and linked when a third of all
coordinates agree. One text, the least by its hash, stands for the family in every count; equal texts are one text.

n_t takes a second pass over the documents. A term that stands near entities in more families already than any entity's threshold
allows can't be disclosive and is left out of it (most common words); the others go to the executors in blocks of `block_terms`,
one pass for each, and so do disclosive terms.

Nulls and edges: a null text counts as empty; a null doc_id stays null; repeated rows get equal results; an empty table gives an
empty result; extra columns are kept by sanitise() and ignored by the rest. All scans are linear in the text, runs of one
character class included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carry, durable, lookup, lower_az, small_batches, spread, table, tidy, words
from .components import connected_components
from .neardup import _coefficients, shingle_sets, signature

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA, SUPPORT, WINDOW = 0.9, 4, 8
BANDS, BAND, AGREE = 8, 3, 8
_STRIP = ".,;:!?\"'()[]<>"

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1 if start == at else max(free, start)
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        groups = list(_DIGITS.finditer(text, m.start(), m.end()))
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            if all(len(p := g.group().lstrip("0")) <= 3 and int(p or "0") <= 255 for g in four):
                yield four[0].start(), four[3].end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def find_base(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the direct identifiers, by start and kind."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(s, 1, e) for s, e in _ips(text)]
        out += [(s, 2, e) for s, e in _cards(text)]
        if "+" in text:
            out += [(s, 3, e) for s, e in _phones(text)]
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """Protected value: spelling variants of one identifier agree."""
    return f"{KINDS[kind]}:{lower_az(value) if kind == 0 else value if kind == 1 else ''.join(_DIGIT.findall(value))}"


def term_of(word: str) -> str:
    """The term a word stands for: the same rule where terms are found, counted and generalised."""
    return lower_az(word.strip(_STRIP))


def _tokens(text: str) -> set[str]:
    return set(words(lower_az(text)))


def _layout(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int]]]:
    """The words' bounds, which of them hold a part of an identifier, and the first and last word (exclusive) of each identifier."""
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    starts = np.array([a for a, _ in runs])
    taken = np.zeros(len(runs), bool)
    where = []
    for s, _, e in spans:
        a = max(0, int(np.searchsorted(starts, s, side="right")) - 1)
        b = int(np.searchsorted(starts, e, side="left"))
        taken[a:b] = True
        where.append((a, b))
    return runs, taken, where


def _contexts(text: str, spans: list[tuple[int, int, int]], window: int) -> set[tuple[str, str]]:
    """(entity, term) for the terms within so many words of an identifier, identifiers themselves left out."""
    runs, taken, where = _layout(text, spans)
    out = set()
    for (a, b), (s, kind, e) in zip(where, spans, strict=True):
        who = entity(kind, text[s:e])
        for i in (*range(max(0, a - window), a), *range(b, min(len(runs), b + window))):
            if not taken[i] and (t := term_of(text[slice(*runs[i])])):
                out.add((who, t))
    return out


_KEY = "xxhash64(coalesce(text, ''))"


def _sketches(docs: DataFrame, window: int) -> DataFrame:
    """key (a hash of the text), sig (MinHash of its word pairs), found (entities, each once with a null term, and their terms)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips, factors = _coefficients(BANDS * BAND)
        for batch in batches:
            sigs, found = [], []
            for text in batch["text"]:
                pairs = next(shingle_sets([text], 2))
                sigs.append(signature(pairs, flips, factors) if len(pairs) else None)
                spans = find_base(text)
                rows = [{"entity": who, "term": None} for who in sorted({entity(k, text[s:e]) for s, k, e in spans})]
                found.append(rows + [{"entity": who, "term": t} for who, t in sorted(_contexts(text, spans, window))] if spans else [])
            yield pd.DataFrame({"key": batch["key"], "sig": sigs, "found": found})

    return spread(docs.select("text", F.expr(_KEY).alias("key"))).mapInPandas(tidy(run), "key long, sig binary, found array<struct<entity:string,term:string>>")


def _copies(sketches: DataFrame) -> DataFrame:
    """key of every text for whose family another text stands."""
    texts = durable(sketches.groupBy("key").agg(F.first("sig").alias("sig")).where("sig is not null"))
    band = lambda i: F.xxhash64(F.lit(i), F.substring("sig", 2 * BAND * i + 1, 2 * BAND))
    rows = texts.select("key", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("band"))
    least = durable(rows.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1"))
    # at most 1000 bands hold a thousandth of all rows; their rows meet the least text without a shuffle
    often = max(2, texts.count() * BANDS // 1000)
    hot, cold = least.where(F.col("n") >= often).drop("n"), least.where(F.col("n") < often).drop("n")
    pairs = rows.join(F.broadcast(hot), "band").unionByName(rows.join(F.broadcast(hot.select("band")), "band", "left_anti").join(cold, "band"))
    pairs = durable(pairs.where("key <> least").select("key", "least").distinct())
    # a text has at most a pair a band, but many texts may have the same least one
    stand = texts.join(pairs.select(F.col("least").alias("key")).distinct(), "key").withColumnRenamed("key", "least")
    pairs = lookup(pairs.join(texts.withColumnRenamed("sig", "own"), "key"), "least", stand, "key")
    coordinate = lambda c, i: F.substring(c, 2 * i + 1, 2)
    agree = sum((coordinate("own", i) == coordinate("sig", i)).cast("int") for i in range(BANDS * BAND))
    links = pairs.where(agree >= AGREE).select(F.col("key").alias("a"), F.col("least").alias("b"))
    return connected_components(links).where("node <> root").select(F.col("node").alias("key"))


def _in_blocks(terms: DataFrame, size: int) -> Iterator[list]:
    """The rows of terms (one a term), on the driver at most about size at a time; no empty blocks."""
    passes = -(-terms.count() // size)
    for b in range(passes):
        if rows := terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == b).collect():
            yield rows


def _blocks(terms: DataFrame, size: int) -> list[frozenset[str]]:
    """The terms in sets of about size; one empty set where there are none."""
    return [frozenset(r[0] for r in rows) for rows in _in_blocks(terms, size)] or [frozenset()]


def _holders(docs: DataFrame, terms: frozenset[str]) -> DataFrame:
    """key, terms: the given terms that each text holds outside identifiers, texts that hold none left out; equal texts once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, held = [], []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                found = {t for w in _tokens(text) if (t := w.strip(_STRIP)) in terms} if text else set()
                if found and (spans := find_base(text)):
                    runs, taken, _ = _layout(text, spans)
                    found &= {term_of(text[a:b]) for (a, b), inside in zip(runs, taken, strict=True) if not inside}
                if found:
                    keys.append(key)
                    held.append(sorted(found))
            yield pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "terms": pd.Series(held, dtype=object)})

    rows = spread(docs.select("text", F.expr(_KEY).alias("key"))).mapInPandas(tidy(run), "key long, terms array<string>")
    return rows.groupBy("key").agg(F.first("terms").alias("terms"))


def disclosive_terms(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, window: int = WINDOW, block_terms: int = 200_000) -> DataFrame:
    """term, disclosure: terms over the threshold for some entity, with their largest PMI as a share of its information content."""
    small_batches(docs.sparkSession)
    sketches = durable(_sketches(docs, window))
    copies = _copies(sketches)
    n = float(sketches.select("key").distinct().count() - copies.count())
    found = sketches.where(F.size("found") > 0).select("key", F.explode("found").alias("f")).select("key", "f.entity", "f.term").distinct()
    found = durable(found.join(copies, "key", "left_anti"))
    of_entity = found.where("term is null").groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= support)
    joint = found.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= support)
    joint = lookup(joint, "entity", of_entity, "term")
    # the most families of a term that leave it over the threshold, and those known of before documents are read again
    most = joint.groupBy("term").agg(F.max(F.col("n_ct") * F.pow(n / F.col("n_c"), F.lit(1 - alpha))).alias("most"))
    near = found.where("term is not null").select("term", "key").distinct().groupBy("term").agg(F.count("*").alias("near"))
    terms = durable(most.join(near, "term").where("near <= most + 1e-6").select("term"))
    joint = durable(joint.join(terms, "term", "left_semi"))
    n_t = None
    for block in _in_blocks(terms, block_terms):
        held = _holders(docs, frozenset(r[0] for r in block)).join(copies, "key", "left_anti").select(F.explode("terms").alias("term"))
        part = held.groupBy("term").agg(F.count("*").alias("n_t"))
        n_t = part if n_t is None else n_t.union(part)
    if n_t is None:
        return docs.sparkSession.createDataFrame([], "term string, disclosure double")
    ic = F.log(n / F.col("n_c"))
    share = F.when(ic > 0, F.log(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t"))) / ic).otherwise(F.lit(0.0))
    scored = lookup(joint, "term", n_t, "entity").groupBy("term").agg(F.max(share).alias("disclosure"))
    return durable(scored.where(F.col("disclosure") >= alpha))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans_of(text: str | None, terms: frozenset[str], base: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind index, end): direct identifiers (if base) and the given terms outside them, by start and kind."""
    direct = find_base(text)
    spans = list(direct) if base else []
    if terms and text and any(w.strip(_STRIP) in terms for w in _tokens(text)):
        for m in _RUN.finditer(text):
            word = m.group()
            if term_of(word) in terms:
                a = m.start() + len(word) - len(word.lstrip(_STRIP))
                b = a + len(word.strip(_STRIP))
                if not any(s < b and a < e for s, _, e in direct):
                    spans.append((a, 4, b))
    return sorted(spans)


def find_spans(docs: DataFrame, block_terms: int = 200_000, **limits) -> DataFrame:
    """doc_id, found: the spans (start, kind index, end) of identifiers and disclosive terms of every text, by start and kind."""
    small_batches(docs.sparkSession)
    out = spread(docs.select("doc_id", "text")).withColumn("found", F.array().cast(_SPAN))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, found {_SPAN}"
    for i, block in enumerate(_blocks(disclosive_terms(docs.select("text"), block_terms=block_terms, **limits).select("term"), block_terms)):
        # only beyond block_terms disclosive terms: a row goes through one step a block, its spans with it

        def run(batches: Iterator[pd.DataFrame], block: frozenset[str] = block, base: bool = i == 0) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [sorted([*((x["start"], x["kind"], x["end"]) for x in old), *spans_of(t, block, base)]) for t, old in zip(batch["text"], batch["found"], strict=True)]
                yield batch.assign(found=[[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in found])

        out = out.mapInPandas(tidy(run), schema)
    return out.select("doc_id", "found")


def redact(text: str | None, spans: list) -> str | None:
    """Each span, or run of spans that overlap, becomes [KIND] of its first."""
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, block_terms: int = 200_000, **limits) -> DataFrame:
    """docs with every identifier and disclosive term in text replaced by its kind; n_chars, if there, follows."""
    terms = disclosive_terms(docs, block_terms=block_terms, **limits).select("term")
    out = docs
    for i, block in enumerate(_blocks(terms, block_terms)):

        def make(block: frozenset[str] = block, base: bool = i == 0):
            return lambda texts: (None, [redact(t, spans_of(t, block, base)) for t in texts])

        out = carry(out, make)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def op2_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    joined = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(joined(F.filter("found", lambda x: x["kind"] < 4)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count(4).alias("n_term"),
    )
