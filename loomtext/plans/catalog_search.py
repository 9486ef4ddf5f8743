"""Queries over documents as files: search, shaping and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import ranking as R
from loomtext.operators import search as S
from loomtext.registry import query
from loomtext.sources import corpus as C

#: The corpus and its lines, for the SQL side.
CORPUS = "corpus AS (SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS language, text AS content FROM documents)"
LINES = CORPUS + ", cut AS (SELECT file_id, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM corpus)"


def overlapping(text: str, literal: str) -> str:
    """SQL: overlapping occurrences of a short literal."""
    n = len(literal)
    return f"(SELECT count(*) FROM range(1, length({text}) - {n} + 2) r(i) WHERE {text}[CAST(i AS INT):CAST(i AS INT) + {n - 1}] = '{literal}')"


@query(f"""WITH {CORPUS} SELECT path, len(regexp_extract_all(content, 'tion')) AS n_matches FROM corpus WHERE contains(content, 'tion') AND NOT regexp_matches(content, '(?m)^\\s*//') ORDER BY n_matches DESC, path LIMIT 20""")
def search_top_files(spark, sf_dir):
    rows = S.top_files(C.files(spark, sf_dir), "tion", 20)
    return rows.select("path", "n_matches")


@query(f"WITH {LINES} SELECT path, line, text FROM cut WHERE contains(text, 'theon') AND NOT starts_with(ltrim(text, ' '), '//')")
def search_literal_lines(spark, sf_dir):
    return S.matching_lines(C.files(spark, sf_dir), "theon", S.Options(per_file=None)).select("path", "line", "text")


@query(f"WITH {LINES} SELECT path, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(text, 'an')))  AS BIGINT) AS n_matches FROM cut WHERE contains(text, 'an') AND NOT starts_with(ltrim(text, ' '), '//') GROUP BY path")
def search_count_per_file(spark, sf_dir):
    return S.count_per_file(C.files(spark, sf_dir), "an", S.Options(per_file=None))


@query(f"WITH {LINES} SELECT path, CAST(sum(len(regexp_extract_all(text, '\\b(the|and)\\b'))) AS BIGINT) AS n FROM cut WHERE regexp_matches(text, '\\b(the|and)\\b') GROUP BY path")
def search_whole_word_regex(spark, sf_dir):
    # plain spaces and ASCII letters surround these words, so both dialects' word boundaries agree
    rows = S.matching_lines(C.files(spark, sf_dir), "the|and", S.Options(regex=True, whole_word=True, per_file=None))
    return rows.groupBy("path").agg(F.sum("n").cast("long").alias("n"))


@query(f"WITH {LINES} SELECT path, line FROM cut WHERE NOT contains(text, 'e')")
def search_inverted(spark, sf_dir):
    return S.matching_lines(C.files(spark, sf_dir), "e", S.Options(invert=True, per_file=None)).select("path", "line")


@query(f"WITH {LINES}, hit AS (SELECT path, file_id, line, row_number() OVER (PARTITION BY file_id ORDER BY line) AS r FROM cut WHERE contains(text, 'er') AND NOT starts_with(ltrim(text, ' '), '//')) SELECT path, line FROM hit WHERE r <= 2")
def search_first_per_file(spark, sf_dir):
    return S.matching_lines(C.files(spark, sf_dir), "er", S.Options(per_file=2)).select("path", "line")


@query(f"WITH {LINES} SELECT path, line, CASE WHEN contains(text, 'leau') THEN 'leau' WHEN contains(text, 'der') THEN 'der' ELSE 'que' END AS pattern FROM cut WHERE contains(text, 'leau') OR contains(text, 'der') OR contains(text, 'que')")
def search_multi_pattern(spark, sf_dir):
    return S.first_pattern(C.files(spark, sf_dir), ["leau", "der", "que"])


@query(f"WITH {LINES}, hit AS (SELECT *, parse_dirpath(path) AS dir, len(regexp_extract_all(text, 'ing')) AS n FROM cut WHERE contains(text, 'ing') AND NOT starts_with(ltrim(text, ' '), '//')) SELECT CAST(sum(n) AS BIGINT) AS n_matches, count(*) AS n_lines, count(DISTINCT path) AS n_files, count(DISTINCT dir) AS n_dirs, count(*) FILTER (starts_with(ltrim(text, ' '), '//')) AS n_comment_lines, count(*) FILTER (regexp_matches(lower(path), '_test\\.|\\.test\\.|\\.spec\\.|test_|/test/|/tests/|/__tests__/|/spec/')) AS n_test_lines FROM hit")
def search_stats(spark, sf_dir):
    return S.stats(C.files(spark, sf_dir), "ing")


@query(f"WITH {CORPUS}, has AS (SELECT file_id, unnest(['the', 'der', 'que', 'tion']) AS p, content FROM corpus), hit AS (SELECT file_id, p FROM has WHERE contains(content, p)) SELECT x.p AS a, y.p AS b, count(*) AS n_files FROM hit x JOIN hit y ON x.file_id = y.file_id AND x.p <> y.p GROUP BY ALL")
def search_co_occurrence(spark, sf_dir):
    return S.co_occurrence(C.files(spark, sf_dir), ["the", "der", "que", "tion"])


@query(f"WITH {CORPUS} SELECT file_id, path FROM corpus WHERE contains(content, 'the') AND contains(content, 'tion') AND contains(content, 'ing')")
def search_files_with_all(spark, sf_dir):
    return S.files_with_all(C.files(spark, sf_dir), ["the", "tion", "ing"])


@query(f"""WITH {LINES}, hit AS (SELECT path, line, text, unnest(range(1, length(text) - 1)) AS i FROM cut WHERE contains(text, 'and') AND NOT starts_with(ltrim(text, ' '), '//'))
SELECT path, line, CAST(i - 1 AS INTEGER) AS "column", CAST(strlen(text[1:CAST(i AS INT) - 1]) AS INTEGER) AS byte_column,
  NOT (regexp_matches(text[CAST(i AS INT) - 1:CAST(i AS INT) - 1], '[A-Za-z0-9_]') AND i > 1) AND NOT regexp_matches(text[CAST(i AS INT) + 3:CAST(i AS INT) + 3], '[A-Za-z0-9_]') AS exact
FROM hit WHERE text[CAST(i AS INT):CAST(i AS INT) + 2] = 'and'""")
def search_positions(spark, sf_dir):
    o = S.Options(per_file=None)
    rows = S.positions(S.matching_lines(C.files(spark, sf_dir), "and", o), "and", o)
    return rows.select("path", "line", "column", "byte_column", "exact")


@query(f"WITH {LINES} SELECT path, line, text FROM cut WHERE contains(text, 'eau') AND path LIKE 'src1%'")
def search_path_filtered(spark, sf_dir):
    return S.matching_lines(C.files(spark, sf_dir), "eau", S.Options(include=("^src1",), skip_comments=False, per_file=None)).select("path", "line", "text")


@query(f"WITH {LINES} SELECT path, line FROM cut WHERE regexp_matches(text, '(leau|keit)[a-z]+, ')")
def search_hybrid_regex(spark, sf_dir):
    return S.matching_lines(C.files(spark, sf_dir), "(leau|keit)[a-z]+, ", S.Options(regex=True, per_file=None)).select("path", "line")


@query(f"""WITH {LINES}, hit AS (SELECT file_id, path, line, text FROM cut WHERE contains(text, 'leau') AND NOT starts_with(ltrim(text, ' '), '//'))
SELECT path, line, round(10.0 + CASE WHEN regexp_matches(' ' || text || ' ', '[^A-Za-z0-9_]leau[^A-Za-z0-9_]') THEN 100 ELSE 0 END + 1.0 - 0.5 * 2 - 20 - 30, 6) AS score
FROM hit ORDER BY score DESC, path, line LIMIT 50""")
def search_ranked(spark, sf_dir):
    rows = S.matching_lines(C.files(spark, sf_dir), "leau", S.Options(per_file=None))
    return R.rank(R.scored(rows, "leau"), 50).select("path", "line", "score")


@query(f"""WITH {LINES}, hit AS (SELECT file_id, line FROM cut WHERE contains(text, 'leau')),
near AS (SELECT DISTINCT c.file_id, c.path, c.line, c.text FROM cut c JOIN hit h ON c.file_id = h.file_id AND c.line BETWEEN h.line - 2 AND h.line + 2) SELECT path, line, text FROM near""")
def search_context_lines(spark, sf_dir):
    corpus = C.files(spark, sf_dir)
    hits = S.matching_lines(corpus, "leau", S.Options(skip_comments=False, per_file=None))
    return R.context_lines(C.lines(corpus), hits, 2).select("path", "line", "text")


@query(f"""WITH {LINES}, hit AS (SELECT file_id, path, greatest(line - 2, 1) AS a, line + 2 AS b FROM cut WHERE contains(text, 'leau')),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM hit),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT path, min(a) AS start_line, max(b) AS end_line, count(*) AS n_matches FROM islands GROUP BY file_id, path, island""")
def search_merged_ranges(spark, sf_dir):
    hits = S.matching_lines(C.files(spark, sf_dir), "leau", S.Options(skip_comments=False, per_file=None))
    return R.merged_ranges(hits, 2).select("path", "start_line", "end_line", "n_matches")


@query(f"""WITH {LINES}, hit AS (SELECT path, line, text, 'eder' AS p FROM cut WHERE contains(text, 'eder') UNION ALL SELECT path, line, text, 'leau' FROM cut WHERE contains(text, 'leau')),
best AS (SELECT path, line, count(*) AS n FROM hit GROUP BY ALL) SELECT path, line, n AS n_patterns, round(10.0 * (1 + least(0.15 * (n - 1), 0.5)), 6) AS score FROM best""")
def search_multi_boost(spark, sf_dir):
    corpus, o = C.files(spark, sf_dir), S.Options(skip_comments=False, per_file=None)
    rows = None
    for p in ("eder", "leau"):
        one = S.matching_lines(corpus, p, o).select("path", "line", F.lit(10.0).alias("score"))
        rows = one if rows is None else rows.union(one)
    return R.boosted(rows, ["path", "line"])


@query(f"""WITH {LINES}, t AS (SELECT path, line, (length(text) + 3) // 4 AS tokens FROM cut WHERE contains(text, 'leau')),
s AS (SELECT *, sum(tokens) OVER (ORDER BY path, line ROWS UNBOUNDED PRECEDING) AS upto FROM t) SELECT path, line, CAST(upto AS BIGINT) AS tokens_so_far FROM s WHERE upto <= 2000""")
def search_token_budget(spark, sf_dir):
    rows = S.matching_lines(C.files(spark, sf_dir), "leau", S.Options(skip_comments=False, per_file=None))
    return R.within_budget(rows.withColumn("tokens", R.token_estimate(F.col("text"))), "tokens", ["path", "line"], 2000).select("path", "line", F.col("so_far").alias("tokens_so_far"))


@query(f"WITH {LINES}, t AS (SELECT path, line FROM cut WHERE contains(text, 'leau')) SELECT path, line, (SELECT count(*) FROM t) AS total FROM t ORDER BY path, line LIMIT 25 OFFSET 10")
def search_page(spark, sf_dir):
    rows = S.matching_lines(C.files(spark, sf_dir), "leau", S.Options(skip_comments=False, per_file=None)).select("path", "line")
    return R.page(rows, ["path", "line"], 10, 25)
