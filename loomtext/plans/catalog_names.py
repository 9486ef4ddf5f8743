"""Queries over names (parts and customers): splitting, similarity, layers, phrases, ids, vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import matching as M
from loomtext.functions import names as N
from loomtext.operators import namematch as X
from loomtext.operators import vocabulary as V
from loomtext.registry import query
from loomtext.runtime import table

#: Names of every style, made from part types and keys.
NAMES = """names AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'parse' || initcap_(p_brand) || 'HTTPResponse' WHEN 1 THEN 'user_' || lower(p_brand) || '_cfg' WHEN 2 THEN 'HTTPServer' || p_size WHEN 3 THEN 'get-' || lower(p_type) || '-msg' WHEN 4 THEN 'MAX_' || upper(p_type) ELSE p_name END AS name FROM part)""".replace("initcap_(p_brand)", "replace(p_brand, '#', '')")


def made_names(spark, sf_dir):
    k = F.pmod("p_partkey", F.lit(6))
    name = (
        F.when(k == 0, F.concat(F.lit("parse"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("HTTPResponse")))
        .when(k == 1, F.concat(F.lit("user_"), F.lower("p_brand"), F.lit("_cfg")))
        .when(k == 2, F.concat(F.lit("HTTPServer"), F.col("p_size").cast("string")))
        .when(k == 3, F.concat(F.lit("get-"), F.lower("p_type"), F.lit("-msg")))
        .when(k == 4, F.concat(F.lit("MAX_"), F.upper("p_type")))
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct()


def _sql_split(c: str) -> str:
    for a, b in ((r"[_\-./\s]+", " "), (r"(\p{Ll})(\p{Lu})", r"\1 \2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"), (r"(\p{L})([0-9])", r"\1 \2"), (r"([0-9])(\p{L})", r"\1 \2")):
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return f"list_filter(string_split(lower({c}), ' '), lambda w: w <> '')"


SPLIT = _sql_split("name")
_PHONETIC = "substr(lower(name), 2)"
for _d, _letters in N.SOUNDS.items():
    _PHONETIC = f"regexp_replace({_PHONETIC}, '[{_letters}]', '{_d}', 'g')"
_RUNS = f"regexp_replace({_PHONETIC}, '[^1-6]', '0', 'g')"
for _d in N.SOUNDS:
    _RUNS = f"regexp_replace({_RUNS}, '{_d}+', '{_d}', 'g')"


@query(f"WITH {NAMES} SELECT name, array_to_string({SPLIT}, ' ') AS words FROM names")
def name_split(spark, sf_dir):
    return made_names(spark, sf_dir).select("name", F.array_join(N.split(F.col("name")), " ").alias("words"))


@query(f"WITH {NAMES}, w AS (SELECT unnest(list_filter({SPLIT}, lambda x: length(x) >= 3)) AS term FROM names) SELECT term, count(*) AS n FROM w GROUP BY term")
def name_terms(spark, sf_dir):
    return made_names(spark, sf_dir).select(F.explode(N.terms(F.col("name"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"""WITH {NAMES}, s AS (SELECT CASE WHEN regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' WHEN regexp_matches(name, '^[A-Z0-9]+(_[A-Z0-9]+)+$') THEN 'screaming' WHEN regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab' WHEN regexp_matches(name, '^[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*$') THEN 'pascal' WHEN regexp_matches(name, '^[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*$') THEN 'camel' ELSE 'unknown' END AS style FROM names) SELECT style, count(*) AS n FROM s GROUP BY style""")
def name_case_styles(spark, sf_dir):
    return made_names(spark, sf_dir).groupBy(N.case_style(F.col("name")).alias("style")).agg(F.count("*").alias("n"))


@query(f"WITH {NAMES} SELECT name, rpad(substr(lower(name), 1, 1) || substr(replace({_RUNS}, '0', ''), 1, 3), 4, '0') AS code FROM names")
def name_phonetic(spark, sf_dir):
    return made_names(spark, sf_dir).select("name", N.phonetic(F.col("name")).alias("code"))


@query(f"WITH {NAMES} SELECT name, round(jaro_winkler_similarity(name, 'HTTPServer'), 6) AS similarity FROM names")
def name_jaro_winkler(spark, sf_dir):
    return made_names(spark, sf_dir).select("name", F.round(M.jaro_winkler(F.col("name"), F.lit("HTTPServer")), 6).alias("similarity"))


@query(f"WITH {NAMES} SELECT name, round(CASE WHEN name = 'HTTPServer' THEN 1.0 ELSE 1.0 - levenshtein(name, 'HTTPServer') * 1.0 / greatest(length(name), 10) END, 6) AS similarity FROM names")
def name_levenshtein(spark, sf_dir):
    return made_names(spark, sf_dir).select("name", F.round(N.levenshtein_similarity(F.col("name"), F.lit("HTTPServer")), 6).alias("similarity"))


@query(f"WITH {NAMES}, b AS (SELECT name, list_distinct([name[i:i+1] for i in range(1, length(name))]) AS x, list_distinct(['HTTPServer'[i:i+1] for i in range(1, 10)]) AS y FROM names) SELECT name, round(len(list_intersect(x, y)) / sqrt(len(x) * len(y)), 6) AS similarity FROM b")
def name_bigram_cosine(spark, sf_dir):
    return made_names(spark, sf_dir).select("name", F.round(N.bigram_cosine(F.col("name"), F.lit("HTTPServer")), 6).alias("similarity"))


@query(f"WITH {NAMES}, s AS (SELECT name, jaro_winkler_similarity(name, 'getUserConfig') AS s FROM names) SELECT name, round(s, 6) AS similarity FROM s WHERE s >= 0.5 ORDER BY similarity DESC, name LIMIT 20")
def name_fuzzy_matches(spark, sf_dir):
    return X.fuzzy_matches(made_names(spark, sf_dir), "getUserConfig", 0.5, 20)


@query(f"WITH {NAMES}, s AS (SELECT name, jaro_winkler_similarity(name, 'getUserConfig') AS s, least(1.0, length(name) / 40.0) AS w FROM names) SELECT name, round(0.7 * s + 0.3 * w, 6) AS score FROM s WHERE s >= 0.5")
def name_fuzzy_weighted(spark, sf_dir):
    return X.fuzzy_weighted(made_names(spark, sf_dir).withColumn("weight", F.least(F.lit(1.0), F.char_length("name") / 40.0)), "getUserConfig", 0.5)


@query()
def name_stems(spark, sf_dir):
    words = made_names(spark, sf_dir).select(F.explode(N.terms(F.col("name"))).alias("word")).distinct()
    return words.select("word", M.stem(F.col("word")).alias("stem"))


@query()
def name_layer_scores(spark, sf_dir):
    return X.rank_symbols(made_names(spark, sf_dir), "user config", 50)


@query()
def name_phrase_scores(spark, sf_dir):
    match = M.phrase_matcher(["user", "config"], N.ABBREVIATIONS, N.DOMAINS)
    return made_names(spark, sf_dir).select("name", match(N.split(F.col("name"))).alias("score")).where("score > 0").orderBy(F.desc("score"), "name")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CAST(p_partkey AS UBIGINT) + (CAST(p_size AS UBIGINT) << 32) AS v FROM part), d AS (SELECT id, v, 0 AS i, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_', CAST(v % 63 AS INT) + 1, 1) AS s, v // 63 AS rest FROM n UNION ALL SELECT id, v, i + 1, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_', CAST(rest % 63 AS INT) + 1, 1) || s, rest // 63 FROM d WHERE rest > 0) SELECT id, s AS code, CAST(v AS BIGINT) AS decoded FROM d WHERE rest = 0""")
def object_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.composite_id(F.col("p_partkey"), F.col("p_size")).alias("code"))
    return ids.withColumn("decoded", N.decode63(F.col("code")))


_ABBR = " UNION ALL ".join(f"SELECT '{k}' AS k, '{w}' AS w, {i} AS i" for k, v in N.ABBREVIATIONS.items() for i, w in enumerate(v))


@query(f"WITH {NAMES}, abbr AS ({_ABBR}), w AS (SELECT DISTINCT unnest({SPLIT}) AS word FROM names) SELECT word, word AS expansion FROM w UNION SELECT word, abbr.w FROM w JOIN abbr ON k = word")
def name_abbreviations(spark, sf_dir):
    return X.abbreviation_pairs(made_names(spark, sf_dir))


_DOMAIN = " UNION ALL ".join(f"SELECT '{d}' AS domain, '{w}' AS w" for d, v in N.DOMAINS.items() for w in v)


@query(f"WITH {NAMES}, dom AS (SELECT DISTINCT * FROM ({_DOMAIN})), w AS (SELECT DISTINCT name, unnest({SPLIT}) AS w FROM names) SELECT domain, count(DISTINCT name) AS n_symbols, count(DISTINCT w.w) AS n_terms FROM w JOIN dom USING (w) GROUP BY domain")
def vocabulary_domains(spark, sf_dir):
    return V.domain_occurrences(made_names(spark, sf_dir))


@query(f"WITH {NAMES}, dom AS (SELECT DISTINCT w FROM ({_DOMAIN})), w AS (SELECT unnest(list_filter({SPLIT}, lambda x: length(x) >= 3)) AS term FROM names) SELECT term, count(*) AS n FROM w WHERE term NOT IN (SELECT w FROM dom) GROUP BY term ORDER BY n DESC, term LIMIT 50")
def vocabulary_unique_terms(spark, sf_dir):
    return V.unique_terms(made_names(spark, sf_dir), 50)


@query(f"WITH {NAMES}, dom AS (SELECT DISTINCT w FROM ({_DOMAIN})), w AS (SELECT unnest(list_filter({SPLIT}, lambda x: length(x) >= 3)) AS term FROM names) SELECT term, count(*) AS n FROM w WHERE term IN (SELECT w FROM dom) GROUP BY term HAVING count(*) >= 2")
def vocabulary_common_terms(spark, sf_dir):
    return V.common_terms(made_names(spark, sf_dir))


@query(f"WITH {NAMES}, dom AS (SELECT DISTINCT * FROM ({_DOMAIN})), w AS (SELECT DISTINCT unnest({SPLIT}) AS w FROM names) SELECT DISTINCT domain FROM dom EXCEPT SELECT DISTINCT domain FROM dom JOIN w USING (w)")
def vocabulary_absent_domains(spark, sf_dir):
    return V.absent_domains(made_names(spark, sf_dir))


@query(f"""WITH {NAMES}, abbr AS ({_ABBR}), w AS (SELECT DISTINCT name, unnest({SPLIT}) AS word FROM names)
SELECT 'word' AS kind, word AS key, name FROM w UNION SELECT 'abbreviation', word, name FROM w UNION SELECT 'abbreviation', abbr.w, name FROM w JOIN abbr ON k = word
UNION SELECT 'phonetic', rpad(substr(lower(name), 1, 1) || substr(replace({_RUNS}, '0', ''), 1, 3), 4, '0'), name FROM names""")
def semantic_keys(spark, sf_dir):
    """Stems are in `name_stems`; the rest of the keys is here."""
    from loomtext.operators import index as I

    return I.semantic_keys(made_names(spark, sf_dir), M.stem, N.split, N.phonetic, N.expand_words).where("kind != 'stem'")


@query(f"WITH {NAMES}, s AS (SELECT name, lower(name) AS l, {SPLIT} AS w, jaro_winkler_similarity(lower(name), 'user config') AS j FROM names) SELECT name, CASE WHEN l = 'user config' THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, CASE WHEN contains(l, 'user config') THEN 0.9 ELSE 0.0 END::DOUBLE AS substring, round(CASE WHEN j > 0.7 THEN 0.7 * (0.7 + 0.1 * (j - 0.7)) ELSE 0 END, 6)::DOUBLE AS fuzzy, round(0.4 * len(list_filter(['user', 'config'], lambda x: list_contains(w, x))) / 2.0, 6)::DOUBLE AS name_split FROM s")
def name_plain_layers(spark, sf_dir):
    return X.layers(made_names(spark, sf_dir), "user config").select("name", "exact", "substring", "fuzzy", "name_split")
