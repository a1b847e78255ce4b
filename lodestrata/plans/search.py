"""Search queries."""

from __future__ import annotations

from ..operators import search as S
from ..operators.lines import line_offsets as offsets_of
from ..operators.search import SearchOptions
from ..sources import tables as T
from .registry import query

PATH = "source || '/' || doc_id || '.' || lang"
LINES = "SELECT doc_id, {0} AS path, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents".format(PATH)


def _count(p: str, col: str = "text") -> str:
    return f"len(regexp_extract_all({col}, '{p}'))::BIGINT"


@query(rf"SELECT doc_id, {PATH} AS path FROM documents WHERE regexp_matches(text, 'thing(s|ly)')")
def search_files(spark, d):
    return S.files(T.corpus(spark, d), SearchOptions("thing(s|ly)"))


@query(f"SELECT doc_id, {PATH} AS path, {_count('er[a-z]+ing')} AS match_count FROM documents WHERE regexp_matches(text, 'er[a-z]+ing')")
def search_count(spark, d):
    return S.counts(T.corpus(spark, d), SearchOptions("er[a-z]+ing"))


@query(f"SELECT doc_id, path, line_no, line, {_count('onthe[a-z]*', 'line')} AS n_ranges FROM ({LINES}) WHERE regexp_matches(line, 'onthe[a-z]*')")
def search_lines(spark, d):
    return S.lines(T.corpus(spark, d), SearchOptions("onthe[a-z]*"))


@query(f"""SELECT doc_id, line_no, line, NOT m AS is_context FROM (
  SELECT *, max(m) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near
  FROM (SELECT doc_id, line_no, line, regexp_matches(line, 'ondthe|lyti') AS m FROM ({LINES}))) WHERE near""")
def search_context(spark, d):
    return S.with_context(T.corpus(spark, d), SearchOptions("ondthe|lyti", before=1, after=2))


@query(f"SELECT doc_id, {PATH} AS path, {_count('(?i)ing the')} AS match_count FROM documents WHERE regexp_matches(text, '(?i)ing the')")
def search_ignore_case(spark, d):
    return S.counts(T.corpus(spark, d), SearchOptions("ing the", ignore_case=True))


@query(f"SELECT doc_id, {PATH} AS path, ((length(text) - length(replace(text, 'e. ', ''))) // 3)::BIGINT AS match_count FROM documents WHERE contains(text, 'e. ')")
def search_fixed(spark, d):
    return S.counts(T.corpus(spark, d), SearchOptions("e. ", fixed=True))


@query(rf"SELECT doc_id, {PATH} AS path, {_count(chr(92) + 'b(?:er)' + chr(92) + 'b')} AS match_count FROM documents WHERE regexp_matches(text, '\b(?:er)\b')")
def search_word(spark, d):
    return S.counts(T.corpus(spark, d), SearchOptions("er", word=True))


@query(f"SELECT doc_id, {PATH} AS path, {_count('ung')} AS match_count FROM documents WHERE lang = 'de' AND regexp_matches(text, 'ung')")
def search_type_filter(spark, d):
    return S.counts(T.corpus(spark, d), SearchOptions("ung", file_type="de"))


@query(f"SELECT doc_id, {PATH} AS path FROM documents WHERE (source = 'src3' OR {PATH} = 'src4/4.en') AND contains(text, 'the')")
def search_path_filter(spark, d):
    return S.files(T.corpus(spark, d), SearchOptions("the", paths=["src3/", "src4/4.en"]))


@query(f"SELECT doc_id, {PATH} AS path FROM documents WHERE lang = 'fr' AND contains(text, 'eau')")
def search_glob_filter(spark, d):
    return S.files(T.corpus(spark, d), SearchOptions("eau", glob="*.fr"))


@query(f"SELECT doc_id, {PATH} AS path FROM documents WHERE strlen(text) <= 1500 AND contains(text, 'ion')")
def search_size_filter(spark, d):
    return S.files(T.corpus(spark, d), SearchOptions("ion", max_file_size=1500))


@query(f"""WITH m AS (SELECT doc_id, path, line_no, line, {_count('tion the', 'line')} AS n FROM ({LINES}) WHERE regexp_matches(line, 'tion the')),
f AS (SELECT *, row_number() OVER (ORDER BY match_count DESC, path)::INT AS file_rank FROM (SELECT doc_id, path, sum(n)::BIGINT AS match_count FROM m GROUP BY ALL)),
r AS (SELECT m.*, match_count, file_rank, row_number() OVER (PARTITION BY m.doc_id ORDER BY line_no) AS k FROM m JOIN f USING (doc_id) WHERE file_rank <= 25)
SELECT file_rank, path, match_count, line_no, left(line, 120) AS line FROM r WHERE k <= 5""")
def search_compact(spark, d):
    return S.compact(S.lines(T.corpus(spark, d), SearchOptions("tion the")))


@query(f"""WITH m AS (SELECT doc_id, path, line_no, line, {_count('hea', 'line')} AS n_ranges, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM ({LINES}) WHERE contains(line, 'hea'))
SELECT doc_id, path, line_no, line, n_ranges FROM m WHERE k <= 10 ORDER BY path, line_no LIMIT 200""")
def search_capped(spark, d):
    return S.capped(S.lines(T.corpus(spark, d), SearchOptions("hea")))


@query(f"""WITH m AS (SELECT doc_id, path, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM ({LINES}) WHERE contains(line, 'hea'))
SELECT doc_id, path, string_agg(line_no || ':' || line, chr(10) ORDER BY line_no) FILTER (k <= 10) || CASE WHEN max(n) > 10 THEN chr(10) || '... +' || (max(n) - 10) || ' more' ELSE '' END AS body FROM m GROUP BY ALL""")
def search_grouped(spark, d):
    return S.grouped(S.lines(T.corpus(spark, d), SearchOptions("hea")))


@query(f"""SELECT '{{"file":' || to_json(path) || ',"line":' || line_no || ',"text":' || to_json(line) || '}}' AS json FROM ({LINES}) WHERE contains(line, 'whou')""")
def search_json_lines(spark, d):
    return S.json_lines(S.lines(T.corpus(spark, d), SearchOptions("whou")))


@query(f"""SELECT doc_id, line_no, k::INT AS n, (list_sum(g[1:k]) + list_sum(list_transform(m[1:k], lambda x: length(x))) - length(m[k]))::INT AS start,
  (list_sum(g[1:k]) + list_sum(list_transform(m[1:k], lambda x: length(x))))::INT AS "end" FROM (
  SELECT doc_id, line_no, m, list_transform(regexp_split_to_array(line, 'eaa[a-z]*'), lambda x: length(x)) AS g, unnest(range(1, len(m) + 1)) AS k
  FROM (SELECT doc_id, line_no, line, regexp_extract_all(line, 'eaa[a-z]*') AS m FROM ({LINES})) WHERE len(m) > 0)""")
def match_ranges(spark, d):
    return S.ranges(T.corpus(spark, d), SearchOptions("eaa[a-z]*"))


@query("""SELECT (SELECT count(*) FROM documents) AS total, count(*) AS candidates, count(*) FILTER (n > 0) AS files, sum(n)::BIGINT AS matches
FROM (SELECT len(regexp_extract_all(text, 'ness|ment'))::BIGINT AS n FROM documents WHERE lang = 'fr')""")
def search_stats(spark, d):
    return S.stats(T.corpus(spark, d), SearchOptions("ness|ment", file_type="fr"))


@query(f"""WITH f AS (SELECT source, lang FROM documents WHERE contains(text, 'on'))
SELECT 'files' AS kind, '' AS name, count(*) AS n FROM f UNION ALL SELECT 'dirs', '', count(DISTINCT source) FROM f
UNION ALL (SELECT 'extension', lang, count(*) AS n FROM f GROUP BY lang ORDER BY n DESC, lang LIMIT 6)""")
def file_list_aggregate(spark, d):
    return S.file_list_aggregate(S.files(T.corpus(spark, d), SearchOptions("on")))


@query(f"SELECT doc_id, contains(left(text, 8192), chr(0)) AS is_binary FROM documents")
def binary_sniff(spark, d):
    return T.read(spark, d, "documents").select("doc_id", T.is_binary(T.F.col("text")).alias("is_binary"))


@query("""SELECT doc_id, line_no, byte_offset FROM (SELECT doc_id, line_no, strlen(text) AS total,
  (coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS byte_offset
  FROM (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE byte_offset < total""")
def line_offsets(spark, d):
    return offsets_of(T.read(spark, d, "documents").select("doc_id", "text"))


_BM25 = f"""WITH m AS (SELECT doc_id, {PATH} AS path, len(regexp_extract_all(text, '\\b(?:the)\\b'))::BIGINT AS match_count, greatest(strlen(text), 1)::DOUBLE AS dl FROM documents WHERE regexp_matches(text, '\\b(?:the)\\b')),
s AS (SELECT count(*) AS n, avg(dl) AS avdl FROM m)
SELECT doc_id, path, match_count, round(greatest(ln(0.5 / (n + 0.5) + 1), 0.01::DOUBLE) * (match_count * 2.5) / (match_count + 1.5 * (1 - 0.75 + 0.75 * dl / avdl)), 9) AS score
FROM m, s ORDER BY score DESC, path LIMIT 10"""


@query(_BM25)
def bm25_topk(spark, d):
    return S.bm25_topk(T.corpus(spark, d), SearchOptions("the", word=True))


@query(rf"SELECT doc_id, {PATH} AS path FROM documents WHERE regexp_matches(text, 'th\.$')")
def search_anchor_end(spark, d):
    return S.files(T.corpus(spark, d), SearchOptions(r"th\.$"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+ the'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '(?m)^[A-Z][a-z]+ the')")
def search_multiline(spark, d):
    return S.counts(T.corpus(spark, d), SearchOptions("(?m)^[A-Z][a-z]+ the")).selectExpr("doc_id", "match_count AS n")


@query("""SELECT page_id, url FROM pages WHERE len(list_intersect(string_split(url, '/')[:-2], ['tag', 'en', 'category'])) = 0""")
def default_excludes(spark, d):
    pages = T.read(spark, d, "pages")
    return pages.where(~T.excluded(T.F.col("url"), ["tag", "en", "category"])).select("page_id", "url")


@query(f"SELECT doc_id, {PATH} AS path, 1 AS line_no, string_split(text, chr(10))[1] AS line, 1::BIGINT AS n_ranges FROM documents WHERE regexp_matches(text, '^The')")
def search_lines_start(spark, d):
    """An anchor means the text's start, not each line's."""
    return S.lines(T.corpus(spark, d), SearchOptions("^The"))


@query(rf"SELECT doc_id, {PATH} AS path, len(string_split(text, chr(10)))::INT AS line_no, string_split(text, chr(10))[-1] AS line, 1::BIGINT AS n_ranges FROM documents WHERE regexp_matches(text, '[a-z]+ion\.$')")
def search_lines_end(spark, d):
    return S.lines(T.corpus(spark, d), SearchOptions(r"[a-z]+ion\.$"))


ACROSS = f"""(SELECT doc_id, path, line_no, line, regexp_matches(line, '[a-z]+[.]$') AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), '^[A-Z]'), false) AS m FROM ({LINES}))"""


@query(f"SELECT doc_id, path, line_no, line, 1::BIGINT AS n_ranges FROM {ACROSS} WHERE m")
def search_lines_across(spark, d):
    """A match that crosses a line end counts for the line where it starts."""
    return S.lines(T.corpus(spark, d), SearchOptions(r"[a-z]+[.]\n[A-Z]"))


@query(f"""SELECT doc_id, line_no, line, NOT m AS is_context FROM (SELECT *, max(m) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM {ACROSS}) WHERE near""")
def search_context_across(spark, d):
    return S.with_context(T.corpus(spark, d), SearchOptions(r"[a-z]+[.]\n[A-Z]", context=1))


@query(f"""SELECT doc_id, line_no, 1 AS n, (strlen(line) - strlen(regexp_extract(line, '[a-z]+[.]$')))::INT AS start, (strlen(line) + 2)::INT AS "end" FROM {ACROSS} WHERE m""")
def match_ranges_bytes(spark, d):
    return S.ranges(T.corpus(spark, d), SearchOptions(r"[a-z]+[.]\n[A-Z]"), in_bytes=True)
