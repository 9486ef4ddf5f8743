"""Change history: frequency, volatility, collisions, ownership, anti-patterns, naming.

Changes are rows (path, author, ts, lines). The time that windows end at is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import paths as P
from loomtext.runtime import first_rows

# Windows in days and their names.
WINDOWS = {"7d": 7, "week": 7, "30d": 30, "month": 30, "90d": 90, "quarter": 90, "1y": 365, "year": 365}
DEFAULT_WINDOW = "30d"
#: Files that churn without being worked on.
EXCLUDED_NAMES = ("CHANGELOG.md", "CHANGELOG", "HISTORY.md", "CHANGES.md", "NEWS.md", "RELEASES.md", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "composer.lock", "Gemfile.lock")
EXCLUDED_GLOBS = ("*.min.js", "*.min.css", "*.map", "*.lock", "vendor/**", "node_modules/**", "dist/**")


def days(window: str) -> int:
    return WINDOWS.get(window.lower(), WINDOWS[DEFAULT_WINDOW])


def in_window(changes: DataFrame, as_of: str, window: str) -> DataFrame:
    """Changes of the window up to as_of; a change exactly at its start counts."""
    end = F.lit(as_of).cast("timestamp")
    return changes.where((F.col("ts") >= end - F.expr(f"INTERVAL {days(window)} DAYS")) & (F.col("ts") <= end))


def churn_kept(path: Column, include=(), exclude=()) -> Column:
    ok = ~P.base(path).isin(*EXCLUDED_NAMES)
    for g in (*exclude, *EXCLUDED_GLOBS):
        ok = ok & ~P.matches_glob(path, g)
    if include:
        some = F.lit(False)
        for g in include:
            some = some | P.matches_glob(path, g)
        ok = ok & some
    return ok


def frequency(changes: DataFrame, as_of: str, window: str = DEFAULT_WINDOW) -> DataFrame:
    """path, n_changes, n_lines, first, last, n_authors, rate (changes a day), volatility."""
    rows = in_window(changes, as_of, window).groupBy("path").agg(F.count("*").alias("n_changes"), F.round(F.sum("lines"), 6).alias("n_lines"), F.min("ts").alias("first_change"), F.max("ts").alias("last_change"), F.count_distinct("author").alias("n_authors"))
    rows = rows.withColumn("rate", F.round(F.col("n_changes") / days(window), 6))
    return rows.withColumn("volatility", F.round(volatility(F.col("rate"), F.col("n_lines"), F.col("n_authors")), 6))


def volatility(rate: Column, churn: Column, authors: Column) -> Column:
    one = F.lit(1.0)
    return 0.4 * F.least(rate, one) + 0.4 * F.least(churn / 100, one) + 0.2 * F.least(authors / 5, one)


def hotspots(rows: DataFrame, least: int, k: int) -> DataFrame:
    return rows.where(F.col("n_changes") >= least).orderBy(F.desc("volatility"), F.desc("n_changes"), "path").limit(k)


def contributors(changes: DataFrame, as_of: str, window: str = DEFAULT_WINDOW) -> DataFrame:
    """path, author, n, last, share of the path's changes."""
    per = in_window(changes, as_of, window).groupBy("path", "author").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    total = per.groupBy("path").agg(F.sum("n").alias("total"))
    return per.join(total, "path").select("path", "author", "n", "last", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def collisions(changes: DataFrame, as_of: str, window: str = DEFAULT_WINDOW) -> DataFrame:
    """path, n_authors, recent, ratio, score, severity for paths with two contributors or more.

    recent sums all changes of those active in the last seven days; ratio is second share over first.
    """
    per = contributors(changes, as_of, window)
    active = F.col("last") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    top = F.reverse(F.array_sort(F.collect_list("n")))
    rows = per.groupBy("path").agg(F.count("*").alias("n_authors"), F.coalesce(F.sum(F.when(active, F.col("n"))), F.lit(0)).alias("recent"), top.alias("tops")).where("n_authors >= 2")
    ratio = F.element_at("tops", 2) / F.element_at("tops", 1)
    one = F.lit(1.0)
    score = 0.4 * F.least((F.col("n_authors") - 1) / 4, one) + 0.4 * F.least(F.col("recent") / 10, one) + 0.2 * ratio
    rows = rows.select("path", "n_authors", "recent", F.round(ratio, 6).alias("ratio"), F.round(score, 6).alias("score"))
    return rows.withColumn("severity", F.when(F.col("score") >= 0.7, "critical").when(F.col("score") >= 0.4, "warning").otherwise("info"))


def ownership(changes: DataFrame, as_of: str, window: str = DEFAULT_WINDOW, least: float = 0.1) -> DataFrame:
    """module, total, owner, owner_share, n_secondary (others with a share of `least` or more)."""
    per = in_window(changes, as_of, window).withColumn("module", P.module(F.col("path"))).groupBy("module", "author").agg(F.count("*").alias("n"))
    total = per.groupBy("module").agg(F.sum("n").alias("total"))
    rows = per.join(total, "module").withColumn("share", F.col("n") / F.col("total")).withColumn("r", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("n"), "author")))
    return rows.groupBy("module").agg(F.max("total").alias("total"), F.max(F.when(F.col("r") == 1, F.col("author"))).alias("owner"), F.round(F.max(F.when(F.col("r") == 1, F.col("share"))), 6).alias("owner_share"), F.count_if((F.col("r") > 1) & (F.col("share") >= least)).alias("n_secondary"))


def most_active(changes: DataFrame, as_of: str, window: str = DEFAULT_WINDOW) -> DataFrame:
    return in_window(changes, as_of, window).groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(1)


def buckets(changes: DataFrame, width: str) -> DataFrame:
    """path, start, n of tumbling windows."""
    return changes.groupBy("path", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("start"), "n")


# Anti-pattern expressions and limits.
REGISTRATIONS = (r"\.register\(", r"\.Register\(", r"\.add\(", r"\.handle\(", r"\.Handle\(", r"\.use\(", r"\.route\(", r"\.bind\(", r"\.on\(", r"\.subscribe\(", r"router\.(get|post|put|delete)\(", r"app\.(get|post|put|delete)\(", r"AddCommand\(", r"@register", r"\.provide\(")
ENUMS = (r"case \w+ = ", r"= iota", r"enum \w+", r"[A-Z_]{3,} = \d+", r"const [A-Z_]{3,}", r"#define [A-Z_]{3,}")


def anti_patterns(files: DataFrame, least: int = 10, god_lines: int = 1500) -> DataFrame:
    """path, pattern, n, severity: registrations, enums, god objects, barrels, configuration files, and switches
    with many cases (`case` and `when` labels between one `switch` or `match` and the next)."""
    text = F.col("content")
    registered = F.greatest(*[F.regexp_count(text, F.lit(p)) for p in REGISTRATIONS])
    enums = sum((F.regexp_count(text, F.lit(p)) for p in ENUMS), F.lit(0))
    n_lines = F.size(F.split(text, "\n"))
    exports = F.regexp_count(text, F.lit(r"(?m)^\s*export |^from \S+ import "))
    fields = F.regexp_count(text, F.lit(r"(?m)^\s*[\w\"']+\s*[:=]\s*\S"))
    graded = lambda n, most: F.when(n >= 2 * most, "critical").when(n >= 1.5 * most, "warning").otherwise("info")
    barrel = F.lower(P.base(F.col("path"))).rlike(r"^(index|mod|__init__)\.")
    config = F.lower("path").rlike("config|settings|options")
    after = F.slice(F.split(text, r"\b(?:switch|match)\b[^{\n]*\{"), F.lit(2), F.greatest(F.size(F.split(text, r"\b(?:switch|match)\b[^{\n]*\{")) - 1, F.lit(0)))
    cases = F.coalesce(F.array_max(F.transform(after, lambda x: F.regexp_count(x, F.lit(r"(?m)^\s*(?:case|when)\b")))), F.lit(0))
    rules = F.array(
        F.when(registered >= least, F.struct(F.lit("registration").alias("pattern"), registered.alias("n"), graded(registered, least).alias("severity"))),
        F.when(enums >= least, F.struct(F.lit("enum").alias("pattern"), enums.alias("n"), graded(enums, least).alias("severity"))),
        F.when(n_lines >= god_lines, F.struct(F.lit("god_object").alias("pattern"), n_lines.alias("n"), graded(n_lines, god_lines).alias("severity"))),
        F.when(barrel & (exports >= least), F.struct(F.lit("barrel").alias("pattern"), exports.alias("n"), graded(exports, least).alias("severity"))),
        F.when(cases >= least, F.struct(F.lit("switch_factory").alias("pattern"), cases.alias("n"), graded(cases, least).alias("severity"))),
        F.when(config & (fields >= least), F.struct(F.lit("config").alias("pattern"), fields.alias("n"), graded(fields, least).alias("severity"))),
    )
    return files.select("path", F.explode(F.array_compact(rules)).alias("r")).select("path", "r.pattern", "r.n", "r.severity")


def metric_issues(before: DataFrame, after: DataFrame, cc: int = 10, lines: int = 100, nesting: int = 4, growth: float = 0.5) -> DataFrame:
    """id, issue, severity of functions after a change; metrics cc, n_lines, nesting, purity by id."""
    old = before.select("id", F.col("cc").alias("old_cc"), F.col("n_lines").alias("old_lines"), F.col("purity").alias("old_purity"))
    rows = after.join(old, "id", "left")
    over = lambda name, c, most: F.when(F.col(c) > most, F.struct(F.lit(name).alias("issue"), F.when(F.col(c) > 2 * most, "critical").otherwise("warning").alias("severity")))
    note = lambda cond, name: F.when(cond, F.struct(F.lit(name).alias("issue"), F.lit("warning").alias("severity")))
    each = F.array(over("complexity", "cc", cc), over("length", "n_lines", lines), over("nesting", "nesting", nesting), note(F.col("cc") > F.col("old_cc") * (1 + growth), "complexity_growth"), note(F.col("n_lines") > F.col("old_lines") * (1 + growth), "length_growth"), note(F.col("purity") > F.col("old_purity"), "purity_loss"))
    return rows.select("id", F.explode(F.array_compact(each)).alias("e")).select("id", "e.issue", "e.severity")


def report_risk(findings: DataFrame, *by: str) -> DataFrame:
    """The sum of weights by severity (.3 critical, .1 warning, .02 info), 1 at most; one for each `by`."""
    w = F.when(F.col("severity") == "critical", 0.3).when(F.col("severity") == "warning", 0.1).otherwise(0.02)
    return findings.groupBy(*by).agg(F.round(F.least(F.lit(1.0), F.coalesce(F.sum(w), F.lit(0.0))), 6).alias("risk"))


def dominant_styles(symbols: DataFrame, style: Column, least: int = 3) -> DataFrame:
    """kind, style, n: the most common case style of each kind with `least` examples."""
    per = symbols.groupBy("kind", style.alias("style")).agg(F.count("*").alias("n")).where("style != 'unknown'")
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "style")
    return per.withColumn("r", F.row_number().over(w)).where((F.col("r") == 1) & (F.col("n") >= least)).drop("r")


def frequency_report(changes: DataFrame, as_of: str, window: str = DEFAULT_WINDOW, focus: str = "all", k: int | None = None) -> DataFrame:
    """section, key, value: hotspots (volatility by path), collisions (score), ownership (owner's share by module)
    and contributors (changes by author), each the k largest (None: all); focus: one of them, or all."""
    author = F.col("author").cast("string")
    parts = {
        "hotspots": lambda: frequency(changes, as_of, window).select(F.col("path").alias("key"), F.col("volatility").alias("value")),
        "collisions": lambda: collisions(changes, as_of, window).select(F.col("path").alias("key"), F.col("score").alias("value")),
        "ownership": lambda: ownership(changes, as_of, window).select(F.col("module").alias("key"), F.col("owner_share").alias("value")),
        "contributors": lambda: in_window(changes, as_of, window).groupBy(author.alias("key")).agg(F.count("*").cast("double").alias("value")),
    }
    out = None
    for name in list(parts) if focus == "all" else [focus]:
        got = first_rows(parts[name]().orderBy(F.desc("value"), "key"), k).select(F.lit(name).alias("section"), "key", F.col("value").cast("double").alias("value"))
        out = got if out is None else out.union(got)
    return out


def analyse_change(before: DataFrame, after: DataFrame, copies: DataFrame, style: Column) -> DataFrame:
    """finding, n, severity counts of a change set: metric issues of changed functions, new copies of old texts,
    and names whose style isn't their kind's usual one.

    before, after: functions (id, name, kind, cc, n_lines, nesting, purity); copies: new_id, old_id, similarity.
    """
    metric = metric_issues(before, after).select(F.col("issue").alias("finding"), "severity")
    doubled = copies.select(F.lit("duplicate").alias("finding"), F.when(F.col("similarity") >= 0.95, "critical").otherwise("warning").alias("severity"))
    usual = dominant_styles(before, style).select("kind", F.col("style").alias("usual"))
    odd = after.select("id", "kind", style.alias("style")).join(usual, "kind").where("style != usual and style != 'unknown'").select(F.lit("naming").alias("finding"), F.lit("info").alias("severity"))
    return metric.union(doubled).union(odd).groupBy("finding", "severity").agg(F.count("*").alias("n"))
