"""Index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as I
from ..operators.search import SearchOptions
from ..sources import tables as T
from .registry import query
from .search import PATH

GRAMS = """(SELECT doc_id, substring(line, p, 3) AS gram, p - 1 AS pos, substring(line, p + 3, 1) AS nx FROM (
  SELECT doc_id, line, unnest(range(1, length(line) - 1)) AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {0}) WHERE length(line) >= 3))"""
DOCS = GRAMS.format("documents")
SMALL = GRAMS.format("(SELECT item_id AS doc_id, text FROM benchmark)")
MASKS = """SELECT gram, doc_id, bit_or(1::BIGINT << (pos % 8)) AS loc_mask, bit_or(CASE WHEN nx = '' THEN 0 ELSE 1::BIGINT << ((unicode(nx) * 31) % 8) END)::BIGINT AS next_mask,
  bit_or(1::BIGINT << least(pos, 31)) AS zone_mask FROM {0} GROUP BY ALL"""


def _docs(spark, d):
    return T.read(spark, d, "documents").select("doc_id", "text")


def _items(spark, d):
    return T.read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


@query(f"SELECT gram, count(DISTINCT doc_id) AS df FROM {DOCS} GROUP BY gram")
def gram_df(spark, d):
    return I.document_frequency(_docs(spark, d))


@query(f"SELECT DISTINCT doc_id, gram FROM {DOCS}")
def gram_postings(spark, d):
    return I.postings(_docs(spark, d)).select("doc_id", "gram")


@query(MASKS.format(SMALL))
def gram_masks(spark, d):
    return I.postings(_items(spark, d))


@query(MASKS.format(DOCS))
def gram_masks_documents(spark, d):
    return I.postings(_docs(spark, d))


@query(f"SELECT count(*) AS postings, count(DISTINCT gram) AS grams, count(DISTINCT doc_id) AS documents FROM (SELECT DISTINCT gram, doc_id FROM {DOCS})")
def index_stats(spark, d):
    return I.stats(I.published(spark, _docs(spark, d)))


@query(f"""SELECT gram, df, row_number() OVER (ORDER BY df DESC, gram)::INT AS rank FROM (SELECT gram, count(DISTINCT doc_id) AS df FROM {DOCS} GROUP BY gram ORDER BY df DESC, gram LIMIT 20)""")
def top_grams(spark, d):
    return I.top_grams(I.document_frequency(_docs(spark, d)))


@query("""SELECT bg, df, CASE WHEN r > .5 THEN .25 WHEN r > .2 THEN .5 WHEN r < .01 THEN 3 WHEN r < .05 THEN 2 ELSE 1 END::DOUBLE AS weight FROM (
  SELECT bg, count(DISTINCT doc_id) AS df, count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS r FROM (
    SELECT doc_id, substring(line, p, 2) AS bg FROM (SELECT doc_id, line, unnest(range(1, length(line))) AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 2)) GROUP BY bg)""")
def bigram_df_idf(spark, d):
    docs = _docs(spark, d)
    df = I.document_frequency(docs, 2)
    total = docs.agg(F.count("*").alias("total"))
    return df.crossJoin(F.broadcast(total)).select(F.col("gram").alias("bg"), "df", I.idf_weight(F.col("df"), F.col("total")).alias("weight"))  # total: one row


@query("SELECT doc_id FROM (SELECT doc_id, bool_or(contains(line, 'ers')) AND bool_or(contains(line, 'tio')) AND bool_or(contains(line, 'ing')) AS ok FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id) WHERE ok")
def index_and(spark, d):
    return I.candidates(I.published(spark, _docs(spark, d)), I.Plan((("ers", "tio", "ing"),)))


@query("SELECT doc_id FROM documents WHERE contains(text, 'ung') OR contains(text, 'eau')")
def index_or(spark, d):
    return I.candidates(I.published(spark, _docs(spark, d)), I.Plan((("ung",), ("eau",))))


@query("SELECT doc_id FROM documents WHERE contains(text, 'ung') INTERSECT SELECT doc_id FROM documents WHERE contains(text, 'keit') EXCEPT SELECT doc_id FROM documents WHERE contains(text, 'heitst')")
def index_set_ops(spark, d):
    p = I.published(spark, _docs(spark, d))
    one = lambda *g: I.candidates(p, I.Plan((g,)))
    text = _docs(spark, d)
    has = lambda s: text.where(F.contains("text", F.lit(s))).select("doc_id")
    # grams of longer literals only prune, so those are verified
    return one("ung").intersect(one("kei", "eit").join(has("keit"), "doc_id", "left_semi")).exceptAll(one("hei", "its", "tst").join(has("heitst"), "doc_id", "left_semi"))


@query(f"SELECT doc_id, {PATH} AS path, len(regexp_extract_all(text, 'erhing|theron[a-z]+'))::BIGINT AS match_count FROM documents WHERE regexp_matches(text, 'erhing|theron[a-z]+')")
def index_search_verified(spark, d):
    return I.search(T.corpus(spark, d), I.published(spark, _docs(spark, d)), SearchOptions("erhing|theron[a-z]+"))


@query(f"SELECT doc_id, {PATH} AS path, len(regexp_extract_all(text, '(?i)stanre'))::BIGINT AS match_count FROM documents WHERE regexp_matches(text, '(?i)stanre')")
def index_search_folded(spark, d):
    return I.search(T.corpus(spark, d), I.published(spark, _docs(spark, d), folded=True), SearchOptions("stanre", ignore_case=True))


@query("""SELECT doc_id FROM documents WHERE doc_id % 10 <> 3 AND contains(text, 'eron') UNION SELECT doc_id FROM documents WHERE doc_id % 10 = 3 AND contains(replace(text, 'the', 'eron'), 'eron')""")
def overlay_search(spark, d):
    """Every tenth document was changed: its old postings are shadowed, its new text is indexed in the delta."""
    docs = _docs(spark, d)
    changed = docs.where(F.pmod("doc_id", F.lit(10)) == 3)
    new = changed.select("doc_id", F.replace("text", F.lit("the"), F.lit("eron")).alias("text"))
    texts = docs.where(F.pmod("doc_id", F.lit(10)) != 3).unionByName(new)
    found = I.live_candidates(I.published(spark, docs), I.postings(new), changed, I.Plan((I.covering("eron"),)))
    return texts.join(found, "doc_id", "left_semi").where(F.contains("text", F.lit("eron"))).select("doc_id")


@query(f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM
  (SELECT {PATH} AS path, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN
  (SELECT {PATH} AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def changed_files(spark, d):
    """Two snapshots: some documents are only in the first, some only in the second, some were edited."""
    c = T.corpus(spark, d)
    old = c.where(F.pmod("doc_id", F.lit(7)) != 0).select("path", F.md5("text").alias("hash"))
    edited = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = c.where(F.pmod("doc_id", F.lit(11)) != 0).select("path", F.md5(edited).alias("hash"))
    return I.snapshot_diff(old, new)


@query()
def sparse_grams(spark, d):
    return I.sparse_grams(_docs(spark, d))


@query("""WITH g AS (SELECT DISTINCT doc_id, gram FROM {0} WHERE gram IN ('ero', 'ron', 'onn')), c AS (SELECT doc_id FROM g GROUP BY doc_id HAVING bool_or(gram = 'ero') AND bool_or(gram = 'onn'))
SELECT (SELECT count(*) FROM g WHERE gram <> 'ron') AS raw, (SELECT count(DISTINCT gram) FROM g WHERE gram <> 'ron') AS leaves, count(*) AS after_intersection, count(*) FILTER (contains(text, 'eronn')) AS matched, count(*) FILTER (NOT contains(text, 'eronn')) AS rejected
FROM documents JOIN c USING (doc_id)""".replace("{0}", DOCS))
def resolve_stats(spark, d):
    return I.resolve_stats(T.corpus(spark, d), I.published(spark, _docs(spark, d)), "eronn")


@query(f"SELECT doc_id, {PATH} AS path, len(regexp_extract_all(text, 'anont'))::BIGINT AS match_count FROM documents WHERE contains(text, 'anont')")
def api_search(spark, d):
    from .. import api

    return api.search(T.corpus(spark, d), "anont", "count", postings=I.published(spark, _docs(spark, d)))
