"""Rule tables over files and symbols: architecture checks, intents, components, memory profiles, naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import names as N
from loomtext.runtime import first_rows

#: Most rows that a rule table may have to be broadcast.
MOST_RULES = 10_000


def _rules(spark, rows, schema: str) -> DataFrame:
    if len(rows) > MOST_RULES:
        return spark.createDataFrame(rows, schema)
    return F.broadcast(spark.createDataFrame(rows, schema))


def verify(files: DataFrame, rules: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """path, rule, severity: files that meet a rule's pattern and break it.

    rules: (name, applies, must, must_not, severity); an empty must or must_not asks nothing.
    """
    found = []
    for name, applies, must, must_not, severity in rules:
        broken = F.lit(False)
        if must:
            broken = broken | ~F.col("content").rlike(must)
        if must_not:
            broken = broken | F.col("content").rlike(must_not)
        found.append(F.when(F.col("content").rlike(applies) & broken, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))))
    return files.select("path", F.explode(F.array_compact(F.array(*found))).alias("v")).select("path", "v.rule", "v.severity")


def compliance(files: DataFrame, violations: DataFrame) -> DataFrame:
    """n_files, n_violating, score: the share of files without a violation, in percent."""
    bad = violations.agg(F.count_distinct("path").alias("n_violating"))
    return files.agg(F.count_distinct("path").alias("n_files")).crossJoin(bad).select("n_files", "n_violating", F.round((F.col("n_files") - F.col("n_violating")) * 100 / F.greatest(F.col("n_files"), F.lit(1)), 6).alias("score"))


# Intents by expressions with a confidence, and keywords.
INTENTS = {
    "size_management": ([(r"(?i)(height|width|size).*\s*[:=]", 0.8), (r"(?i)func.*(Render|View|Layout)", 0.8), (r"(?i)(SetSize|GetSize|Resize)", 0.8)], ["height", "width", "size", "dimensions", "layout", "render"]),
    "event_handling": ([(r"(?i)func.*(Handle|Process|On)[A-Z]", 0.9), (r"(?i)(KeyPress|MouseClick|Input)", 0.9), (r"(?i)(Event|Handler|Listener)", 0.9)], ["event", "handler", "input", "key", "mouse", "click"]),
    "data_transformation": ([(r"(?i)func.*(Transform|Convert|Parse|Format)", 0.85), (r"(?i)(Marshal|Unmarshal|Serialize)", 0.85), (r"(?i)(Encode|Decode|Map)", 0.85)], ["transform", "convert", "parse", "format", "map", "serialize"]),
    "configuration": ([(r"(?i)(Config|Setting|Option)", 0.75), (r"(?i)func.*(Load|Save|Get|Set)Config", 0.75), (r"(?i)(Default|Override|Env)", 0.75)], ["config", "setting", "option", "default", "env", "load", "save"]),
}


def intents(texts: DataFrame, table: dict | None = None) -> DataFrame:
    """id, intent, confidence: (sum of the hit expressions' confidence + .1 a keyword) over the number of
    expressions, times 1.2 with more than one hit, 1 at most."""
    each = []
    for name, (expressions, keywords) in (table or INTENTS).items():
        hits = sum((F.when(F.col("text").rlike(p), 1).otherwise(0) for p, _ in expressions), F.lit(0))
        points = sum((F.when(F.col("text").rlike(p), c).otherwise(0.0) for p, c in expressions), F.lit(0.0))
        words = sum((F.when(F.contains(F.lower("text"), F.lit(k)), 0.1).otherwise(0.0) for k in keywords), F.lit(0.0))
        score = F.least(F.lit(1.0), (points + words) / len(expressions) * F.when(hits > 1, 1.2).otherwise(1.0))
        each.append(F.when(hits > 0, F.struct(F.lit(name).alias("intent"), F.round(score, 6).alias("confidence"))))
    return texts.select("id", F.explode(F.array_compact(F.array(*each))).alias("i")).select("id", "i.intent", "i.confidence")


#: Default component kinds by name keywords, in order of priority.
COMPONENTS = (("controller", "controller|handler", 0.9), ("service", "service|manager", 0.85), ("repository", "repo|store|dao", 0.85), ("model", "model|entity|dto", 0.8), ("view", "view|page|template", 0.8), ("middleware", "middleware|filter", 0.8), ("util", "util|helper", 0.6), ("test", "test|spec", 0.7), ("config", "config|setting", 0.7))


def components(symbols: DataFrame, least: float = 0.5, k: int | None = None) -> DataFrame:
    """name, component, confidence: each name's first rule, a generic one without; the k surest (None: all)."""
    low = F.lower("name")
    hit = F.coalesce(*[F.when(low.rlike(p), F.struct(F.lit(c).alias("component"), F.lit(s).alias("confidence"))) for c, p, s in COMPONENTS], F.struct(F.lit("generic").alias("component"), F.lit(0.5).alias("confidence")))
    rows = symbols.select("name").distinct().select("name", hit.alias("h")).select("name", "h.component", "h.confidence").where(F.col("confidence") >= least)
    return first_rows(rows.orderBy(F.desc("confidence"), "name"), k)


#: Default weights of calls that allocate, and of loops and tests.
CALL_WEIGHTS = {"make": 2.0, "append": 1.5, "new": 1.0, "copy": 1.0, "sprintf": 1.0, "concat": 1.5, "clone": 2.0, "map": 1.2, "filter": 1.2, "readall": 5.0}
LOOP_WEIGHT, TEST_FACTOR = 10.0, 0.1


def memory_profile(calls: DataFrame) -> DataFrame:
    """function, score: summed weights of its calls, tenfold inside loops, a tenth in tests.

    calls: function, callee, in_loop, is_test.
    """
    table = _rules(calls.sparkSession, sorted(CALL_WEIGHTS.items()), "callee string, weight double")
    rows = calls.withColumn("callee", F.lower("callee")).join(table, "callee")
    w = F.col("weight") * F.when(F.col("in_loop"), LOOP_WEIGHT).otherwise(1.0) * F.when(F.col("is_test"), TEST_FACTOR).otherwise(1.0)
    return rows.groupBy("function").agg(F.round(F.sum(w), 6).alias("score"))


def memory_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "high").alias("n_high"))


def access_patterns(accesses: DataFrame) -> DataFrame:
    """target, pattern of its reads and writes in order: read_only, write_only, write_then_read,
    read_then_write or mixed; violation if a read comes before the first write.

    accesses: target, at, kind (read or write).
    """
    read, write = F.col("kind") == "read", F.col("kind") == "write"
    rows = accesses.groupBy("target").agg(F.min(F.when(read, F.col("at"))).alias("r0"), F.max(F.when(read, F.col("at"))).alias("r1"), F.min(F.when(write, F.col("at"))).alias("w0"), F.max(F.when(write, F.col("at"))).alias("w1"))
    pattern = F.when(F.col("w0").isNull(), "read_only").when(F.col("r0").isNull(), "write_only").when(F.col("w1") < F.col("r0"), "write_then_read").when(F.col("r1") < F.col("w0"), "read_then_write").otherwise("mixed")
    return rows.select("target", pattern.alias("pattern"), F.coalesce(F.col("r0") < F.col("w0"), F.lit(False)).alias("read_first"))


# Allowed case styles by language and kind.
STYLES = {("go", "function"): ["camel", "pascal"], ("go", "type"): ["camel", "pascal"], ("python", "function"): ["snake"], ("python", "class"): ["pascal"], ("javascript", "function"): ["camel"], ("javascript", "class"): ["pascal"], ("rust", "function"): ["snake"], ("rust", "struct"): ["pascal"], ("java", "method"): ["camel"], ("java", "class"): ["pascal"]}


def naming_findings(symbols: DataFrame) -> DataFrame:
    """language, kind, name, style of names whose style their language doesn't allow; names of unknown
    style and kinds without a rule are left out."""
    table = _rules(symbols.sparkSession, [(a, b, v) for (a, b), v in sorted(STYLES.items())], "language string, kind string, allowed array<string>")
    rows = symbols.withColumn("style", N.case_style(F.col("name"))).where("style != 'unknown'").join(table, ["language", "kind"])
    return rows.where(~F.array_contains("allowed", F.col("style"))).select("language", "kind", "name", "style")


def abbreviation_findings(names: DataFrame) -> DataFrame:
    """short, long, n_short, n_long: abbreviations of the dictionary whose long form is used elsewhere."""
    words = names.select(F.explode(N.split(F.col("name"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    table = _rules(names.sparkSession, [(k, x) for k, v in sorted(N.ABBREVIATIONS.items()) for x in v], "short string, long string")
    a, b = words.select(F.col("w").alias("short"), F.col("n").alias("n_short")), words.select(F.col("w").alias("long"), F.col("n").alias("n_long"))
    return a.join(table, "short").join(b, "long").select("short", "long", "n_short", "n_long")


def dependency_cohesion(edges: DataFrame) -> DataFrame:
    """source, cohesion: of its targets, the share that another source of the same group also has.

    edges: group, source, target.
    """
    rows = edges.distinct()
    used = rows.groupBy("group", "target").agg(F.count("*").alias("n"))
    return rows.join(used, ["group", "target"]).groupBy("source").agg(F.round(F.avg((F.col("n") > 1).cast("double")), 6).alias("cohesion"))


def segments(lines: DataFrame) -> DataFrame:
    """path, line, kind of text: comment, string, blank or code; block comments span lines.

    A line is inside a block if, of the marks before it, more `/*` than `*/` stand.
    """
    opens = F.regexp_count("text", F.lit(r"/\*")) - F.regexp_count("text", F.lit(r"\*/"))
    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(opens).over(w), F.lit(0))
    t = F.ltrim("text")
    kind = F.when(t == "", "blank").when((depth > 0) | t.rlike(r"^(//|#|/\*)"), "comment").when(t.rlike(r"^[\"'`].*[\"'`][,;)]*\s*$"), "string").otherwise("code")
    return lines.select("path", "line", "text", kind.alias("kind"))


def looks_like_sql(text):
    """A statement's verb, and a clause that belongs to it."""
    up = F.upper(text)
    return up.rlike(r"\bSELECT\b.*\bFROM\b|\bINSERT\s+INTO\b|\bUPDATE\b.*\bSET\b|\bDELETE\s+FROM\b|\bCREATE\s+(TABLE|INDEX|VIEW)\b")


def looks_like_graphql(text):
    return text.rlike(r"^\s*(query|mutation|subscription|fragment)\b[^{]*\{") | text.rlike(r"^\s*\{\s*\w+\s*(\([^)]*\))?\s*\{")


def tagged_templates(files: DataFrame) -> DataFrame:
    """path, tag, body of sql, gql and html template strings."""
    whole = F.regexp_extract_all("content", F.lit(r"\b((?:sql|gql|graphql|html|css)`[^`]*`)"), F.lit(1))
    return files.select("path", F.explode(whole).alias("t")).select("path", F.regexp_extract("t", "^(\\w+)`", 1).alias("tag"), F.regexp_extract("t", "(?s)^\\w+`(.*)`$", 1).alias("body"))
