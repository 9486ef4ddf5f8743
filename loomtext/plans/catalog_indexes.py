"""Queries over derived tables: lines, trigrams, postings, paths, file search, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import paths as P
from loomtext.operators import filesearch as X
from loomtext.operators import index as I
from loomtext.operators import search as S
from loomtext.plans.catalog_search import CORPUS, LINES
from loomtext.registry import query
from loomtext.sources import corpus as C

CODE_SQL, DOC_SQL, CONFIG_SQL = (", ".join(f"'{x}'" for x in v) for v in (P.CODE, P.DOCS, P.CONFIG))
#: Paths of every kind, made from keys of a table (parts).
_KINDS = ("src/app_{k}.go", "pkg/test_{k}.py", "docs/guide{k}.md", "conf/app{k}.yaml", "img/logo{k}.png", "a/__tests__/x{k}.spec.ts", ".hidden/f{k}.js", "Makefile{k}")
PATHS = "paths AS (SELECT p_partkey AS file_id, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{k.split('{k}')[0]}' || p_partkey || '{k.split('{k}')[1]}'" for i, k in enumerate(_KINDS)) + " END AS path FROM part)"


def made_paths(spark, sf_dir):
    from loomtext.runtime import table

    kind = F.pmod("p_partkey", F.lit(8))
    path = F.coalesce(*[F.when(kind == i, F.concat(F.lit(k.split("{k}")[0]), F.col("p_partkey").cast("string"), F.lit(k.split("{k}")[1]))) for i, k in enumerate(_KINDS)])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), path.alias("path"))


@query(f"WITH {LINES} SELECT file_id, line, text, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM cut")
def index_lines(spark, sf_dir):
    return C.with_offsets(C.lines(C.files(spark, sf_dir))).select("file_id", "line", "text", "offset")


@query(f"WITH {CORPUS} SELECT file_id, CAST(strlen(content) AS BIGINT) AS n_bytes, sha256(content) AS sha256 FROM corpus")
def index_content_hash(spark, sf_dir):
    return C.hashes(C.files(spark, sf_dir)).select("file_id", "n_bytes", "sha256")


@query(f"WITH {CORPUS}, low AS (SELECT file_id, string_split(lower(content), '') AS c FROM corpus), g AS (SELECT file_id, unnest(list_distinct([c[i] || c[i + 1] || c[i + 2] for i in range(1, len(c) - 1)])) AS trigram FROM low) SELECT trigram, count(*) AS n_files FROM g WHERE regexp_matches(trigram, '[A-Za-z0-9_]') GROUP BY trigram")
def index_trigrams(spark, sf_dir):
    return I.trigrams(C.files(spark, sf_dir)).groupBy("trigram").agg(F.count("*").alias("n_files"))


@query(f"WITH {CORPUS} SELECT file_id FROM corpus WHERE contains(lower(content), 'tht') AND contains(lower(content), 'hti') AND contains(lower(content), 'tio') AND contains(lower(content), 'ion')")
def index_trigram_candidates(spark, sf_dir):
    return I.candidates(I.trigrams(C.files(spark, sf_dir)), "thtion")


@query(f"WITH {LINES} SELECT path, line FROM cut WHERE contains(text, 'thtion')")
def index_trigram_search(spark, sf_dir):
    corpus = C.files(spark, sf_dir)
    return S.by_trigrams(corpus, I.trigrams(corpus), "thtion", S.Options(skip_comments=False, per_file=None)).select("path", "line")


@query(f"WITH {CORPUS}, t AS (SELECT file_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{{3,}}')) AS token, generate_subscripts(regexp_extract_all(lower(content), '[a-z0-9_]{{3,}}'), 1) - 1 AS k FROM corpus) SELECT token, file_id, count(*) AS n, CAST(min(k) AS INTEGER) AS first_at FROM t GROUP BY token, file_id")
def index_postings(spark, sf_dir):
    return I.postings(C.files(spark, sf_dir))


@query(f"WITH {CORPUS}, t AS (SELECT file_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{{3,}}')) AS token FROM corpus) SELECT file_id, count(*) AS n FROM t WHERE token = 'tion' GROUP BY file_id")
def index_find_token(spark, sf_dir):
    return I.find_token(I.postings(C.files(spark, sf_dir)), "Tion").select("file_id", "n")


@query(f"WITH {CORPUS}, t AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{{3,}}')) AS token FROM corpus) SELECT token, count(*) AS n_files FROM t WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY token ORDER BY n_files DESC, token LIMIT 100")
def index_top_tokens_live(spark, sf_dir):
    from loomtext.runtime import table

    gone = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("file_id"))
    live = I.without(I.postings(C.files(spark, sf_dir)), gone)
    return live.groupBy("token").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "token").limit(100)


@query(f"WITH {PATHS} SELECT file_id, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]*)$', 1)) AS ext, CAST(len(string_split(path, '/')) AS INTEGER) AS depth, CASE WHEN regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '_test\\.|\\.test\\.|\\.spec\\.|^test_') THEN 'test' WHEN regexp_extract(path, '\\.([^./]*)$', 1) IN ({CODE_SQL}) THEN 'code' WHEN regexp_extract(path, '\\.([^./]*)$', 1) IN ({DOC_SQL}) THEN 'doc' WHEN regexp_extract(path, '\\.([^./]*)$', 1) IN ({CONFIG_SQL}) THEN 'config' ELSE 'unknown' END AS category FROM paths")
def index_paths(spark, sf_dir):
    return I.path_index(made_paths(spark, sf_dir))


@query(f"WITH {PATHS} SELECT file_id, path, regexp_matches(lower(path), '_test\\.|\\.test\\.|\\.spec\\.|test_|/test/|/tests/|/__tests__/|/spec/') AS is_test, regexp_matches(path, '\\.png$') AS is_binary, regexp_matches(path, '(^|/)\\.[^/.]') AS is_hidden, CASE regexp_extract(path, '\\.([^./]*)$', 1) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' ELSE '' END AS language FROM paths")
def file_predicates(spark, sf_dir):
    p = F.col("path")
    return made_paths(spark, sf_dir).select("file_id", "path", P.is_test(p).alias("is_test"), P.is_binary_name(p).alias("is_binary"), P.is_hidden(p).alias("is_hidden"), P.language(p).alias("language"))


@query(f"WITH {PATHS} SELECT file_id, path FROM paths WHERE NOT regexp_matches(path, '\\.png$') AND NOT regexp_matches(path, '(^|/)\\.[^/.]') AND NOT regexp_matches(path, '^docs/') AND NOT (regexp_matches(path, '^(.*/)?test_[^/]*\\.py(/.*)?$'))")
def file_admission(spark, sf_dir):
    return made_paths(spark, sf_dir).where(C.admitted(F.col("path"), F.lit(10), exclude=["docs/**"], ignore_lines=["# tests", "test_*.py", "*.log", "!keep.log"])).select("file_id", "path")


@query(f"WITH {PATHS} SELECT path FROM paths WHERE regexp_matches(path, '^src/(.*/)?[^/]*\\.go$') AND NOT contains(path, '_1') ORDER BY path LIMIT 100")
def file_search_glob(spark, sf_dir):
    return X.search(made_paths(spark, sf_dir), "src/**/*.go", exclude=["_1"])


@query(f"WITH {PATHS} SELECT path FROM paths WHERE regexp_matches(path, 'app_?[0-9]+') AND regexp_extract(path, '\\.([^./]*)$', 1) IN ('go', 'yaml') AND (starts_with(path, 'src/') OR contains(path, '/src/')) ORDER BY path LIMIT 100")
def file_search_regex(spark, sf_dir):
    return X.search(made_paths(spark, sf_dir), "app_?[0-9]+", kind="regex", extensions=["go", "yaml"], directories=["src"])


@query(f"WITH {PATHS}, r AS (SELECT path, lower(path) AS p, lower(regexp_extract(path, '([^/]*)$', 1)) AS b FROM paths), s AS (SELECT path, CASE WHEN p = 'guide10.md' THEN 1.0 WHEN b = 'guide10.md' THEN 0.95 WHEN regexp_replace(b, '\\.[^.]*$', '') = 'guide10.md' THEN 0.93 WHEN contains(p, 'guide10.md') THEN 0.8 - 0.2 * (instr(p, 'guide10.md') - 1) / length(p) WHEN jaro_winkler_similarity(b, 'guide10.md') >= 0.7 THEN 0.7 * jaro_winkler_similarity(b, 'guide10.md') WHEN list_contains(string_split(p, '/'), 'guide10.md') THEN 0.6 ELSE 0 END AS s FROM r) SELECT path, round(s, 6) AS score FROM s WHERE s > 0 ORDER BY round(s, 6) DESC, path LIMIT 50")
def file_search_ranked(spark, sf_dir):
    return X.ranked(made_paths(spark, sf_dir), "guide10.md", 50)


@query(f"WITH {CORPUS}, p AS (SELECT path, unnest([regexp_extract(path, '^([^/]*)', 1), regexp_extract(path, '^([^/]*/[^/]*)', 1)]) AS dir FROM corpus) SELECT dir, count(*) AS n_files FROM p GROUP BY dir")
def structure_rollup(spark, sf_dir):
    return X.directory_counts(C.files(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT language, count(*) AS n_files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS n_lines, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM corpus GROUP BY language")
def language_distribution(spark, sf_dir):
    return X.language_distribution(C.files(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT CASE WHEN strlen(content) < 1024 THEN 'under 1 KB' WHEN strlen(content) < 10240 THEN '1-10 KB' WHEN strlen(content) < 102400 THEN '10-100 KB' ELSE 'over 100 KB' END AS bucket, count(*) AS n_files FROM corpus GROUP BY bucket")
def file_size_distribution(spark, sf_dir):
    return X.size_distribution(C.files(spark, sf_dir))


@query("SELECT count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents")
def count_files(spark, sf_dir):
    return C.files(spark, sf_dir).agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


@query("WITH b AS (SELECT doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT CAST(coalesce(b.path, a.path) AS VARCHAR) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM b FULL JOIN a ON a.path = b.path WHERE b.h IS DISTINCT FROM a.h")
def changed_files(spark, sf_dir):
    rows = C.files(spark, sf_dir).select("file_id", F.col("file_id").cast("string").alias("path"), "content")
    edited = F.when(F.col("file_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    # the two snapshots differ by rule: files removed, added and edited
    return C.changed_files(rows.where("file_id % 7 != 0"), rows.where("file_id % 11 != 0").select("path", edited.alias("content")))
