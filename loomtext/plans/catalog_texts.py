"""Queries of duplicates, assembly and HTML fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import duplicates as D
from loomtext.plans.catalog_search import LINES
from loomtext.registry import query
from loomtext.runtime import table
from loomtext.sources import corpus as C

_NORMAL = "array_to_string(list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in string_split(text, chr(10))], lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '#')), chr(10))"


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query("SELECT md5(trim(text, ' ')) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_clusters(spark, sf_dir):
    return D.clusters(texts(spark, sf_dir), D.exact_hash(F.col("text")))


@query(f"SELECT md5({_NORMAL}) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_normalised(spark, sf_dir):
    return D.clusters(texts(spark, sf_dir), F.md5(D.normalised(F.col("text"))))


@query("SELECT md5('func ID(ID) {' || chr(10) || 'return ID + ' || (p_partkey % 5) || chr(10) || '}') AS hash, count(*) AS n, min(p_partkey) AS first, count(DISTINCT p_size % 3) AS n_exact FROM part GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT p_size % 3) > 1")
def duplicate_structural(spark, sf_dir):
    text = F.concat(F.lit("// note\n  func f(a"), (F.col("p_size") % 3).cast("string"), F.lit(") {\n\n\treturn b_"), (F.col("p_size") % 3).cast("string"), F.lit(" + "), (F.col("p_partkey") % 5).cast("string"), F.lit("\n}\n"))
    return D.structural_only(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")))


@query("WITH g AS (SELECT count(*) AS n FROM documents GROUP BY md5(trim(text, ' ')) HAVING count(*) > 1) SELECT count(*) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS n_copies, round(1 / (1 + sum(n - 1) / 10.0), 6) AS maintainability FROM g")
def duplicate_impact(spark, sf_dir):
    return D.impact(D.clusters(texts(spark, sf_dir), D.exact_hash(F.col("text"))))


@query("""WITH b AS (SELECT md5(trim(text, ' ')) AS hash, source || '/' || lang AS path, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines, n_chars % 40 AS cc, CASE WHEN n_chars % 3 = 0 THEN 'class' ELSE 'function' END AS kind FROM documents),
g AS (SELECT hash, count(*) AS n, CAST(sum(n_lines) AS BIGINT) AS n_lines, count(DISTINCT path) AS n_files, CAST(sum(cc) AS BIGINT) AS cc, bool_and(kind = 'function' AND cc <= 15) AS refactorable FROM b WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1)
SELECT hash, n, n_lines, n_files, CASE WHEN n_lines > 200 OR n_files > 5 THEN 'critical' WHEN n_lines > 100 OR n_files > 3 THEN 'high' WHEN n_lines > 50 OR n_files > 2 THEN 'medium' ELSE 'low' END AS severity, round(1 / (1 + (cc // n) / 10.0 + n_lines / 1000.0), 6)::DOUBLE AS maintainability, refactorable FROM g""")
def duplicate_group_impact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n_lines = F.size(F.split("text", "\n")).cast("long")
    kind = F.when(F.col("n_chars") % 3 == 0, "class").otherwise("function")
    blocks = docs.select(D.exact_hash(F.col("text")).alias("hash"), F.concat("source", F.lit("/"), "lang").alias("path"), n_lines.alias("n_lines"), (F.col("n_chars") % 40).alias("cc"), kind.alias("kind"))
    return D.group_impact(blocks)


@query("WITH t AS (SELECT item_id AS id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM benchmark) SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.t, y.t)) * 1.0 / greatest(1, len(list_distinct(x.t || y.t))), 6) AS similarity FROM t x JOIN t y ON y.id = x.id + 1")
def token_jaccard(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), D.tokens(F.col("text")).alias("ta"))
    after = rows.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("ta").alias("tb"))
    return rows.join(after, "a").select("a", "b", D.jaccard(F.col("ta"), F.col("tb")).alias("similarity"))


@query(f"""WITH t AS (SELECT doc_id, {_NORMAL} AS n FROM documents), w AS (SELECT doc_id, n, list_distinct(regexp_extract_all(n, '[A-Za-z0-9_]+')) AS t FROM t),
p AS (SELECT a.doc_id AS new_id, b.doc_id AS old_id, a.n = b.n AS same, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS s FROM w a JOIN w b ON a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 AND len(a.t) * 1.0 >= 0.8 * len(b.t) AND len(b.t) * 1.0 >= 0.8 * len(a.t))
SELECT new_id, old_id, CASE WHEN same THEN 1.0 ELSE round(i * 1.0 / greatest(1, s - i), 6) END::DOUBLE AS similarity FROM p WHERE same OR i * 1.0 / greatest(1, s - i) >= 0.8 ORDER BY similarity DESC, new_id, old_id LIMIT 20""")
def duplicate_new_against_old(spark, sf_dir):
    rows = texts(spark, sf_dir)
    # even documents stand for the new snapshot, odd ones for the old: every document is in one of them
    return D.new_against_old(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), k=20)


_TARGET = "ation_leau/ment-keit"
_FRAGMENTS = D.fragments_of(_TARGET)


@query(f"WITH {LINES}, f AS (SELECT unnest([{', '.join(repr(x) for x in _FRAGMENTS)}]) AS fragment), h AS (SELECT path, fragment, min(line) AS line FROM cut, f WHERE contains(text, fragment) GROUP BY ALL), p AS (SELECT path, count(*) AS n_fragments, least(1.0, sum(length(fragment)) / {len(_TARGET)}.0) AS coverage, max(line) - min(line) AS span FROM h GROUP BY path) SELECT path, CAST(n_fragments AS INTEGER) AS n_fragments, round(coverage, 6) AS coverage, span, round(coverage * 100 * CASE WHEN span <= 5 THEN 2 WHEN span <= 10 THEN 1.5 WHEN span <= 20 THEN 1.2 ELSE 1 END * CASE WHEN n_fragments > 5 THEN 0.8 ELSE 1 END, 6) AS score FROM p WHERE coverage >= 0.2")
def assembly_search(spark, sf_dir):
    return D.assembly(C.lines(C.files(spark, sf_dir)), _FRAGMENTS, len(_TARGET), 0.2)


@query("""WITH f AS (SELECT url, 'text' AS kind, trim(unnest(regexp_extract_all(html, '>([^<>]+)<', 1)), ' ') AS fragment FROM pages UNION ALL SELECT url, 'attribute', unnest(regexp_extract_all(html, '[a-z-]+="([^"<>]+)"', 1)) FROM pages UNION ALL SELECT url, 'tag', unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) FROM pages) SELECT url, kind, count(*) AS n, count(DISTINCT fragment) AS n_distinct FROM f WHERE fragment <> '' OR kind <> 'text' GROUP BY url, kind""")
def html_fragments(spark, sf_dir):
    return D.html_fragments(table(spark, sf_dir, "pages")).groupBy("url", "kind").agg(F.count("*").alias("n"), F.count_distinct("fragment").alias("n_distinct"))
