"""Queries of the planner, sources, sinks and scalars that other catalogs leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import names as N
from loomtext.functions import paths as P
from loomtext.operators import exploration as E
from loomtext.operators import filesearch as FS
from loomtext.operators import history as H
from loomtext.operators import index as I
from loomtext.operators import namematch as X
from loomtext.operators import ranking as R
from loomtext.operators import rules as U
from loomtext.operators import search as S
from loomtext.operators import vocabulary as V
from loomtext.plans import planner
from loomtext.plans.catalog_names import NAMES, made_names
from loomtext.plans.catalog_search import CORPUS, LINES
from loomtext.registry import query
from loomtext.runtime import Scratch, table
from loomtext.sources import config as K
from loomtext.sources import corpus as C
from loomtext.streaming import events as T

# searches by query text


@query(f"WITH {LINES} SELECT path, line, text FROM cut WHERE contains(text, 'ment') AND starts_with(path, 'src1/') AND NOT starts_with(ltrim(text, ' '), '//')")
def plan_scan(spark, sf_dir):
    return planner.run(C.files(spark, sf_dir), "ment dir:src1 ext:txt").select("path", "line", "text")


def kept_trigrams(spark, corpus, pattern):
    """A trigram table written by buckets and read back for a pattern."""
    place = f"{Scratch(spark, 'trigrams').root}/table"
    I.write_trigrams(I.trigrams(corpus), place, 16)
    return I.read_trigrams(spark, place, pattern, 16)


@query(f"WITH {LINES} SELECT path, line FROM cut WHERE contains(text, 'leau') AND NOT starts_with(ltrim(text, ' '), '//')")
def plan_index(spark, sf_dir):
    corpus = C.files(spark, sf_dir)
    return planner.run(corpus, "leau", trigrams=kept_trigrams(spark, corpus, "leau")).select("path", "line")


def _indexed(spark, sf_dir, pattern, **options):
    """A regex search that reads the buckets of the pattern's trigrams from a written table."""
    corpus, place = C.files(spark, sf_dir), f"{Scratch(spark, 'trigrams').root}/table"
    I.write_trigrams(I.trigrams(corpus), place, 16)
    return planner.run(corpus, pattern, S.Options(regex=True, **options), place, 16).select("path", "line")


@query(f"WITH {LINES} SELECT path, line FROM cut WHERE regexp_matches(text, 'leau|keit[a-z]+')")
def plan_index_regex(spark, sf_dir):
    return _indexed(spark, sf_dir, "leau|keit[a-z]+")


@query(f"WITH {LINES} SELECT path, line FROM cut WHERE regexp_matches(text, '(men|ver)(tre|tie|ten)')")
def plan_index_alternatives(spark, sf_dir):
    return _indexed(spark, sf_dir, "(men|ver)(tre|tie|ten)")


@query(f"WITH {LINES} SELECT path, line FROM cut WHERE regexp_matches(text, 'the[^.]*LEAU|KEIT', 'i')")
def plan_index_ignore_case(spark, sf_dir):
    return _indexed(spark, sf_dir, "(?i)the[^.]*LEAU|\\QKEIT\\E")


@query(f"WITH {LINES} SELECT path, line FROM cut WHERE contains(text, 'ment') AND NOT starts_with(path, 'src1/') AND NOT starts_with(ltrim(text, ' '), '//')")
def search_path_excluded(spark, sf_dir):
    return S.matching_lines(C.files(spark, sf_dir), "ment", S.Options(exclude=("src1/**",))).select("path", "line")


#: Of each part's name a pattern of one of eight forms, and whether it is literal, looks like a regex and is simple.
_FORMS = (("{w}", True, False, True), ("{w}.*{w}", False, True, True), ("{w}|x{w}", False, True, True), ("({w})(b)\\1", False, True, False), ("(?={w})y", False, True, False), ("[a-z]+{w}", False, True, True), ("^{w}$", False, True, True), ("{w}(a(b(c(d(e(f))))))", False, True, False))
_FORM_ROWS = ", ".join(f"({i}, '{f}', {a}, {b}, {c})" for i, (f, a, b, c) in enumerate(_FORMS))


@query(f"SELECT p_partkey AS id, replace(form, '{{w}}', split_part(p_name, ' ', 1)) AS pattern, literal, looks_like_regex, simple FROM part JOIN (VALUES {_FORM_ROWS}) v(i, form, literal, looks_like_regex, simple) ON p_partkey % 8 = i")
def pattern_analysis(spark, sf_dir):
    forms = F.element_at(F.array(*[F.lit(f) for f, *_ in _FORMS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(forms, F.lit("{w}"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("pattern"))
    return rows.select("id", "pattern", S.literal_pattern(F.col("pattern")).alias("literal"), S.regex_like(F.col("pattern")).alias("looks_like_regex"), S.simple_pattern(F.col("pattern")).alias("simple"))


#: Query texts with fields, and what they mean in SQL.
_ASKED = {"ment dir:src1 ext:txt": "contains(text, 'ment') AND starts_with(path, 'src1/')", "leau path:**/fr/*": "contains(text, 'leau') AND contains(path, '/fr/')", "heit ext:go": "false", "keit dir:de": "contains(text, 'keit') AND contains(path, '/de/')"}
_COUNTS = " UNION ALL ".join(f"SELECT '{q}' AS asked, count(*) AS n_lines FROM cut WHERE {w} AND NOT starts_with(ltrim(text, ' '), '//')" for q, w in _ASKED.items())


@query(f"WITH {LINES} {_COUNTS}")
def plan_options(spark, sf_dir):
    """How many lines each query text finds, its fields having become path filters."""
    corpus = C.files(spark, sf_dir)
    rows = [planner.run(corpus, q).agg(F.lit(q).alias("asked"), F.count("*").alias("n_lines")) for q in _ASKED]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(f"WITH {LINES}, a AS (SELECT path, line, text FROM cut WHERE contains(text, 'leau')), b AS (SELECT path, line, text FROM cut WHERE regexp_matches(text, 'l.au')) SELECT path, line, text, 10.0::DOUBLE AS score FROM a UNION ALL SELECT path, line, text, 5.0 FROM b WHERE NOT contains(text, 'leau')")
def search_merged_fallback(spark, sf_dir):
    corpus = C.files(spark, sf_dir)
    rows = lambda p, o: S.matching_lines(corpus, p, o).select("path", "line", "text", F.lit(10.0).alias("score")).distinct()
    return S.merged(rows("leau", S.Options(skip_comments=False)), rows("l.au", S.Options(regex=True)))


@query(f"WITH {CORPUS} SELECT greatest(0, count(DISTINCT file_id) - 1) AS n_refs FROM corpus WHERE contains(content, 'leau')")
def reference_guess(spark, sf_dir):
    return S.files_less_one(C.files(spark, sf_dir), "leau")


@query("SELECT doc_id, length(text[1:100]) - length(replace(text[1:100], chr(10), '')) + 1 AS line, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS flat FROM documents")
def text_scalars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.line_of_offset(F.col("text"), F.lit(100)).cast("long").alias("line"), S.one_line(F.col("text")).alias("flat"))


@query("SELECT p_partkey AS id, CASE WHEN p_size >= 40 THEN 'full' WHEN p_size >= 25 THEN 'context' ELSE 'single' END AS size, CASE WHEN length(p_type) > 5 THEN p_type[1:5] || '...' ELSE p_type END AS short, length(p_type) + 2 * len(regexp_extract_all(p_type, '[a-z][A-Z]')) + len(regexp_extract_all(p_type, '_')) + len(regexp_extract_all(p_type, '[0-9]')) AS complexity FROM part")
def result_scalars(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), R.output_size(F.lit("full"), F.col("p_size") / 50.0).alias("size"), R.truncated(F.col("p_type"), 5).alias("short"), R.pattern_complexity(F.col("p_type")).cast("long").alias("complexity"))


_POSITION = "instr(text, 'en')"


@query(f"SELECT doc_id, 100.0 + CASE WHEN NOT regexp_matches(text[{_POSITION} - 1:{_POSITION} - 1], '[A-Za-z0-9_]') AND NOT regexp_matches(text[{_POSITION} + 2:{_POSITION} + 2], '[A-Za-z0-9_]') OR ({_POSITION} = 1 AND NOT regexp_matches(text[3:3], '[A-Za-z0-9_]')) THEN 50 ELSE 0 END + CASE WHEN {_POSITION} = 1 THEN 25 ELSE 0 END + 20.0 AS quality FROM documents WHERE contains(text, 'en')")
def match_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("en")))
    return rows.select("doc_id", R.match_quality(F.col("text"), F.instr("text", "en") - 1, "en").alias("quality"))


_SCORED = "r AS (SELECT p_brand AS path, p_size * 1.0 AS score FROM part)"


@query(f"WITH {_SCORED} SELECT path, count(*) AS n, max(score)::DOUBLE AS best FROM r GROUP BY path")
def results_grouped(spark, sf_dir):
    return R.grouped(_scores(spark, sf_dir), "path").select("path", "n", "best")


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_size").cast("double").alias("score"))


@query(f"WITH {_SCORED} SELECT path FROM (SELECT path, max(score) AS b FROM r GROUP BY path) ORDER BY b DESC, path LIMIT 10")
def results_unique_files(spark, sf_dir):
    return R.unique_files(_scores(spark, sf_dir), 10)


@query(f"WITH {_SCORED} SELECT count(*) AS n, round(avg(score), 6)::DOUBLE AS avg, median(score)::DOUBLE AS median, min(score)::DOUBLE AS min, max(score)::DOUBLE AS max FROM r")
def score_distribution(spark, sf_dir):
    return R.score_distribution(_scores(spark, sf_dir))


@query("SELECT p_partkey AS id, CAST(greatest(1, least(500, p_partkey * 10 // greatest(1, p_size % 7))) AS INTEGER) AS size FROM part")
def page_sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), R.page_sizes(F.col("p_partkey") * 10, F.col("p_size") % 7).alias("size"))


# sources

_LOG = "c AS (SELECT event_id AS k, user_id AS u, epoch(date_trunc('second', ts))::BIGINT AS t FROM events)"


def log_lines(spark, sf_dir):
    """A commit with two changed files for each event, as lines of a log."""
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id"))
    head = F.concat(F.lpad(F.hex("k"), 8, "0"), F.lit("|u"), F.col("user_id").cast("string"), F.lit("|u@x|"), F.unix_timestamp("ts").cast("string"), F.lit("|fix a|b"))
    one = F.concat((F.col("k") % 9).cast("string"), F.lit("\t1\tsrc/{old => new}/f"), F.col("k").cast("string"), F.lit(".go"))
    rows = F.array(F.lower(head), F.lit(""), one, F.lit("-\t-\timg.png"))
    return e.select("k", F.posexplode(rows).alias("i", "value")).select((F.col("k") * 4 + F.col("i")).alias("no"), "value")


@query(f"WITH {_LOG} SELECT lower(lpad(printf('%X', k), 8, '0')) AS hash, 'u' || u AS author, t AS at, 'fix a|b' AS message, 2 AS n_changes, k % 9 AS added, 'src/new/f' || k || '.go' AS first_path, 'src/old/f' || k || '.go' AS first_old FROM c")
def commit_log(spark, sf_dir):
    rows = C.commit_log(log_lines(spark, sf_dir))
    first = F.element_at("changes", 1)
    return rows.select("hash", "author", F.unix_timestamp("ts").alias("at"), "message", F.size("changes").alias("n_changes"), F.aggregate("changes", F.lit(0), lambda a, c: a + c["added"]).alias("added"), first["path"].alias("first_path"), first["old_path"].alias("first_old"))


@query("SELECT event_id AS id, ['added', 'modified', 'deleted', 'renamed', 'unknown'][event_id % 5 + 1] AS status, CASE WHEN event_id % 5 = 3 THEN 'new' || event_id ELSE 'f' || event_id END AS path, CASE WHEN event_id % 5 = 3 THEN 'f' || event_id ELSE '' END AS old_path FROM events")
def name_status(spark, sf_dir):
    k, i = F.col("event_id").cast("string"), F.col("event_id") % 5
    code = F.element_at(F.array(*map(F.lit, ("A", "M", "D", "R087", "X"))), (i + 1).cast("int"))
    value = F.concat(code, F.lit("\tf"), k, F.when(i == 3, F.concat(F.lit("\tnew"), k)).otherwise(""))
    rows = C.name_status(table(spark, sf_dir, "events").select(value.alias("value")))
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("id"), "status", "path", F.coalesce("old_path", F.lit("")).alias("old_path"))


@query("SELECT event_type AS change_set, count(DISTINCT user_id) AS n_files, CAST(sum(event_id % 9) AS BIGINT) AS n_added, count(*) AS n_deleted, CASE WHEN count(DISTINCT user_id) < 10 THEN 'small' WHEN count(DISTINCT user_id) <= 50 THEN 'medium' ELSE 'large' END AS size FROM events GROUP BY 1")
def diff_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("change_set"), F.col("user_id").alias("path"), (F.col("event_id") % 9).alias("added"), F.lit(1).alias("deleted"))
    return C.diff_stats(rows, "change_set")


@query(f"WITH {LINES}, s AS (SELECT file_id, line, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cut) SELECT file_id, line, CAST(o AS BIGINT) AS \"offset\" FROM s")
def line_offsets(spark, sf_dir):
    return C.with_offsets(C.lines(C.files(spark, sf_dir))).select("file_id", "line", "offset")


_NAMES = ("src/main.go", "conf/app.yaml", "README.md", "pkg/x_test.go", "img/logo.png", ".git/config", "vendor/lib/a.js", "build/out.bin")


def _paths(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("path"))


@query("SELECT p_partkey AS id, [0, 1, 2, 3, 4, 4, 0, 4][p_partkey % 8 + 1] AS priority, p_partkey % 8 IN (5, 6) AS ignored FROM part")
def scan_priority(spark, sf_dir):
    rules = ["# comment", "vendor/", ".git", "*.md", "!README.md"]
    return _paths(spark, sf_dir).select("id", P.priority(F.col("path")).alias("priority"), P.ignored(F.col("path"), rules).alias("ignored"))


@query("SELECT p_partkey AS id, p_partkey % 6 < 5 AS is_binary FROM part")
def binary_content(spark, sf_dir):
    head = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("89504E470D0A", "FFD8FFE0", "504B0304", "1F8B08", "61620063", "7061636B616765")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), P.is_binary_content(head).alias("is_binary"))


_SETTINGS = " UNION ALL ".join(["SELECT p_partkey AS id, 'project.index.max_file_size' AS key, p_size::VARCHAR AS value FROM part WHERE p_partkey % 5 <> 4", "SELECT p_partkey, 'project.exclude', p_name || ',' || p_type FROM part WHERE p_partkey % 5 <> 4", "SELECT p_partkey, 'ratio', '0.5' FROM part WHERE p_partkey % 5 <> 4", "SELECT p_partkey, 'exclude', 'base,c,d e' FROM part WHERE p_partkey % 5 <> 4", "SELECT p_partkey, 'search.max_results', CASE WHEN p_partkey % 5 = 1 THEN '5' ELSE '100' END FROM part WHERE p_partkey % 5 <> 4", "SELECT p_partkey, 'search.context', '0' FROM part WHERE p_partkey % 5 <> 4", "SELECT p_partkey, NULL, 'a brace is not closed' FROM part WHERE p_partkey % 5 = 4"])


@query(_SETTINGS)
def config_nodes(spark, sf_dir):
    """Settings of one configuration file for each part, over a project's defaults; every fifth can't be read."""
    own = F.concat(F.lit('project "x" {\n  index { max_file_size '), F.col("p_size").cast("string"), F.lit(' }\n  exclude "'), "p_name", F.lit('" "'), "p_type", F.lit('"\n}\nratio 0.5 // half\nexclude "c"\nexclude "d e"\n'), F.when(F.col("p_partkey") % 5 == 1, "search { max_results 5 }\n").when(F.col("p_partkey") % 5 == 4, "open {\n").otherwise(""))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), own.alias("content"))
    return K.settings(files, {"search": {"max_results": 100, "context": 0}, "exclude": ["base"]})


_RULES = "r AS (SELECT 'r' || (p_partkey // 2 * 2 + CASE WHEN p_partkey % 10 = 1 THEN 0 ELSE p_partkey % 2 END) AS label, ['reachability', 'max', 'odd'][p_size % 3 + 1] AS mode, p_size / 40.0 AS decay, p_size % 4 - 1 AS max_hops FROM part)"


@query(f"WITH {_RULES} SELECT label, label || ': unknown mode odd' AS problem FROM r WHERE mode = 'odd' UNION ALL SELECT label, label || ': decay is not in 0..1' FROM r WHERE NOT (decay > 0 AND decay <= 1) UNION ALL SELECT label, label || ': max_hops is negative' FROM r WHERE max_hops < 0 UNION ALL SELECT label, label || ': a label has two rules' FROM r GROUP BY label HAVING count(*) > 1")
def config_problems(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    label = F.concat(F.lit("r"), (k - k % 2 + F.when(k % 10 == 1, 0).otherwise(k % 2)).cast("string"))
    mode = F.element_at(F.array(*map(F.lit, ("reachability", "max", "odd"))), size % 3 + 1)
    return K.rule_problems(table(spark, sf_dir, "part").select(label.alias("label"), mode.alias("mode"), F.lit("upstream").alias("direction"), (size / 40.0).alias("decay"), (size % 4 - 1).alias("max_hops")))


# literals, file search, names


@query("SELECT p_partkey AS id, p_partkey % 4 = 0 AS sql, p_partkey % 4 = 1 AS graphql, CASE WHEN p_partkey % 4 = 2 THEN 'gql' ELSE '' END AS tag FROM part")
def content_literals(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("select a from t", "query Q($x: Int) { user }", "const q = gql`{ user }`", "plain words"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("path"), text.alias("content"))
    tags = U.tagged_templates(rows).select(F.col("path").cast("long").alias("id"), "tag")
    return rows.select("id", U.looks_like_sql(F.col("content")).alias("sql"), U.looks_like_graphql(F.col("content")).alias("graphql")).join(tags, "id", "left").na.fill("", ["tag"])


_TREE = "t AS (SELECT DISTINCT 'src/' || p_brand || '/' || p_type || ['.go', '.ts', '.md', ''][p_size % 4 + 1] AS path FROM part)"


def tree(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".go", ".ts", ".md", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_type", ext).alias("path")).distinct()


@query(f"WITH {_TREE} SELECT path FROM t WHERE path = (SELECT min(path) FROM t)")
def file_search_exact(spark, sf_dir):
    files = tree(spark, sf_dir)
    return FS.search(files, files.agg(F.min("path")).first()[0], kind="exact")


@query(f"WITH {_TREE} SELECT path FROM t WHERE (path LIKE '%.go' OR path LIKE '%.ts') AND NOT contains(path, '#1') AND starts_with(path, 'src/') ORDER BY path LIMIT 40")
def file_search_filtered(spark, sf_dir):
    return FS.search(tree(spark, sf_dir), "**", exclude=["#1"], extensions=[".go", "ts"], directories=["src"], hidden=False, limit=40)


@query(f"WITH {_TREE}, n AS (SELECT path, lower(path) AS l, lower(string_split(path, '/')[3]) AS b FROM t), s AS (SELECT path, CASE WHEN contains(l, 'brand') THEN 0.8 - 0.2 * (instr(l, 'brand') - 1) / length(l) ELSE 0 END AS a, CASE WHEN b = 'zz' THEN 0.95 WHEN contains(l, '.go') THEN 0.8 - 0.2 * (instr(l, '.go') - 1) / length(l) ELSE 0 END AS c FROM n), g AS (SELECT path, greatest(a, c) * (1 + CASE WHEN a > 0 AND c > 0 THEN 0.15 ELSE 0 END) AS s FROM s WHERE a + c > 0) SELECT path, round(least(s, 1.0), 6)::DOUBLE AS score FROM g ORDER BY score DESC, path LIMIT 30")
def file_search_multi(spark, sf_dir):
    return FS.ranked_multi(tree(spark, sf_dir), ["brand", ".go"], 30)


@query("WITH t AS (SELECT item_id, text FROM benchmark WHERE text IS NOT NULL) SELECT item_id, len(list_distinct([text] || list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: length(w) > 2))) AS n, text AS first FROM t")
def file_search_patterns(spark, sf_dir):
    """How many patterns a benchmark text is searched by, the whole text first."""
    rows = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", FS.pattern_list(F.col("text")).alias("p"))
    return rows.select("item_id", F.size("p").cast("long").alias("n"), F.element_at("p", 1).alias("first"))


@query(f"WITH {NAMES} SELECT name, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(name, '(\\p{{Ll}}|[0-9])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), ' '), lambda w: w <> ''), '|') AS words FROM names")
def name_camel(spark, sf_dir):
    return made_names(spark, sf_dir).select("name", F.array_join(N.camel(F.col("name")), "|").alias("words"))


_KINDS = {"func": ("function", "alias"), " FN ": ("function", "alias"), "meth": ("method", "alias"), "struc": ("struct", "prefix"), "clas": ("class", "prefix"), "Interface": ("interface", "exact"), "functoin": ("function", "fuzzy"), "xyz": ("", "none")}
_KIND_ROWS = ", ".join(f"({i}, '{a}', '{k}', '{h}')" for i, (a, (k, h)) in enumerate(_KINDS.items()))


@query(f"SELECT p_partkey AS id, asked, kind, how FROM part JOIN (VALUES {_KIND_ROWS}) v(i, asked, kind, how) ON p_partkey % 8 = i")
def kind_resolution(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), asked.alias("asked"))
    return rows.select("id", "asked", X.resolved_kind(F.col("asked"), E.KINDS).alias("r")).select("id", "asked", F.coalesce("r.kind", F.lit("")).alias("kind"), "r.how")


@query("SELECT p_partkey AS id, round(least(1.0, greatest(0.1, 0.4 * 0.9 + 0.25 * log10(p_size + 1) / log10(11) + 0.2 * log10(p_partkey % 50 + 1) / log10(101) + 0.15 * least(1.0, 10 * (p_size / 500.0)))), 6)::DOUBLE AS confidence FROM part")
def domain_confidence(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), V.confidence(F.lit(0.9), F.col("p_size"), F.col("p_partkey") % 50, F.col("p_size") / 500.0).alias("confidence"))


@query("WITH t AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS term FROM part) SELECT id, term, CASE term WHEN 'small' THEN 'little,small,tiny' WHEN 'blue' THEN 'azure,blue,green,red' WHEN 'red' THEN 'blue,green,red' ELSE term END AS forms FROM t")
def term_expansion(spark, sf_dir):
    """Long forms and domain peers of the first word of each part's name."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term"))
    forms = N.expand(F.col("term"), {"small": ["little", "tiny"], "blue": ["azure"]}, {"colours": ["red", "green", "blue"]})
    return rows.select("id", "term", F.array_join(F.sort_array(forms), ",").alias("forms"))


# history


@query("SELECT p_partkey AS id, p_partkey % 8 NOT IN (6) AND p_partkey % 3 <> 0 AS kept FROM part")
def churn_exclusion(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, "a/yarn.lock").otherwise(F.col("path")).alias("path"))
    return rows.select("id", H.churn_kept(F.col("path")).alias("kept"))


@query("WITH w AS (SELECT user_id, event_type || '/f' || (event_id % 20) AS path FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS AND ts <= TIMESTAMP '2024-01-31'), c AS (SELECT user_id::VARCHAR AS key, count(*)::DOUBLE AS value FROM w GROUP BY 1 ORDER BY value DESC, key LIMIT 20), p AS (SELECT path AS module, user_id, count(*) AS n FROM (SELECT user_id, string_split(path, '/')[1] AS path FROM w) GROUP BY ALL), o AS (SELECT module AS key, round(max(n) * 1.0 / sum(n), 6)::DOUBLE AS value FROM p GROUP BY 1 ORDER BY value DESC, key LIMIT 20) SELECT 'contributors' AS section, * FROM c UNION ALL SELECT 'ownership', * FROM o")
def frequency_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/f"), (F.col("event_id") % 20).cast("string")).alias("path"), F.col("user_id").alias("author"), "ts", F.col("value").alias("lines"))
    return H.frequency_report(rows, "2024-01-31 00:00:00", k=20).where("section in ('contributors', 'ownership')")


@query("WITH f AS (SELECT o_orderkey AS id, o_orderkey % 27 AS cc FROM orders), m AS (SELECT 'complexity' AS finding, CASE WHEN cc > 20 THEN 'critical' ELSE 'warning' END AS severity FROM f WHERE cc > 10), n AS (SELECT 'naming' AS finding, 'info' AS severity FROM f WHERE id % 5 = 0), d AS (SELECT 'duplicate', CASE WHEN p_size / 50.0 >= 0.95 THEN 'critical' ELSE 'warning' END FROM part WHERE p_size / 50.0 >= 0.8) SELECT finding, severity, count(*) AS n FROM (SELECT * FROM m UNION ALL SELECT * FROM n UNION ALL SELECT * FROM d) GROUP BY ALL")
def change_analysis(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 5 == 0, "odd_name").otherwise("usualName")
    after = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), name.alias("name"), F.lit("function").alias("kind"), (F.col("o_orderkey") % 27).alias("cc"), F.lit(10).alias("n_lines"), F.lit(1).alias("nesting"), F.lit(1).alias("purity"))
    copies = table(spark, sf_dir, "part").where("p_size / 50.0 >= 0.8").select(F.col("p_partkey").alias("new_id"), F.lit(0).alias("old_id"), (F.col("p_size") / 50.0).alias("similarity"))
    return H.analyse_change(after, after, copies, N.case_style(F.col("name")))


# incremental tables


@query("WITH s AS (SELECT 'f' || doc_id AS path, text AS content FROM documents), b AS (SELECT 'f' || doc_id AS path, ['write', 'remove', 'create'][doc_id % 3 + 1] AS type, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'new' END AS content FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'g' || doc_id, 'create', 'new' FROM documents WHERE doc_id % 7 = 0) SELECT path, md5(content) AS hash FROM s WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT path, md5(content) FROM b WHERE type <> 'remove'")
def incremental_applied(spark, sf_dir):
    state, batch = _batch(spark, sf_dir)
    return T.applied(state, batch).select("path", F.md5("content").alias("hash"))


def _batch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("write", "remove", "create"))), (F.col("doc_id") % 3 + 1).cast("int"))
    at = F.timestamp_seconds(F.lit(0))
    one = docs.where("doc_id % 5 = 0").select(F.concat(F.lit("f"), key).alias("path"), kind.alias("type"), at.alias("ts"), F.col("doc_id").alias("event_id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("new").alias("content"))
    two = docs.where("doc_id % 7 = 0").select(F.concat(F.lit("g"), key), F.lit("create"), at, F.col("doc_id"), F.lit("new"))
    return docs.select(F.concat(F.lit("f"), key).alias("path"), F.col("text").alias("content")), one.union(two)


@query("SELECT 'f' || doc_id AS path FROM documents WHERE doc_id % 5 = 0 AND (doc_id % 3 = 1 OR (doc_id % 2 = 1 AND text <> 'new')) UNION ALL SELECT 'g' || doc_id FROM documents WHERE doc_id % 7 = 0")
def incremental_changed(spark, sf_dir):
    state, batch = _batch(spark, sf_dir)
    return T.changed_only(state, batch).select("path")


@query("SELECT 'f' || doc_id AS path, ['write', 'remove', 'create'][doc_id % 3 + 1] AS type, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'new' END) AS hash FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 1")
def incremental_maintained(spark, sf_dir):
    """A stream of changes kept as a table: written as files, read as a stream, and maintained to the end."""
    scratch = Scratch(spark, "maintain")
    _, batch = _batch(spark, sf_dir)
    rows = scratch.write(batch.where("path like 'f%'"), "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{scratch.root}/events")
    T.maintain(stream, f"{scratch.root}/table", f"{scratch.root}/checkpoint", once=True).awaitTermination()
    last = rows.select("path", "type")
    return T.current(spark, f"{scratch.root}/table").join(last, "path").select("path", "type", F.md5("content").alias("hash"))
