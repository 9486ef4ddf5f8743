"""Code-quality scalars and rollups: complexity, health, smells, maintainability, percentiles, masks.

Inputs are rows of functions or symbols with plain numeric columns; every rule is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.prefix import running_sum

# Thresholds.
LOW, MEDIUM, DEBT = 10, 20, 15


def complexity_band(cc: Column) -> Column:
    return F.when(cc <= LOW, "low").when(cc <= MEDIUM, "medium").otherwise("high")


def complexity_metrics(functions: DataFrame) -> DataFrame:
    """One row: n, avg, median, 75th and 90th percentile, and the bands' counts; cc is 1 at least."""
    cc = F.greatest("cc", F.lit(1))
    band = complexity_band(cc)
    return functions.agg(F.count("*").alias("n"), F.round(F.avg(cc), 6).alias("avg_cc"), F.median(cc).alias("median_cc"), F.round(F.percentile(cc, F.lit(0.75)), 6).alias("p75_cc"), F.round(F.percentile(cc, F.lit(0.9)), 6).alias("p90_cc"), F.count_if(band == "low").alias("n_low"), F.count_if(band == "medium").alias("n_medium"), F.count_if(band == "high").alias("n_high"))


def health_score(metrics: DataFrame) -> DataFrame:
    """10 - 4 high share - 1.5 medium share - min(3, .15 (avg - 10)) above 10, in 0 .. 10."""
    over = F.when(F.col("avg_cc") > 10, F.least(F.lit(3.0), 0.15 * (F.col("avg_cc") - 10))).otherwise(0.0)
    raw = 10 - 4 * F.col("n_high") / F.col("n") - 1.5 * F.col("n_medium") / F.col("n") - over
    return metrics.select("n", F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw)), 6).alias("health"))


def debt_ratio(functions: DataFrame) -> DataFrame:
    return functions.agg(F.round(F.avg(((F.col("cc") > DEBT) | (F.col("n_in") > 10)).cast("double")), 6).alias("debt_ratio"))


def hotspots(functions: DataFrame, k: int) -> DataFrame:
    """cc over 10 or over 50 lines; risk .7 cc + .03 lines, 10 at most."""
    risk = F.round(F.least(F.lit(10.0), 0.7 * F.col("cc") + 0.03 * F.col("n_lines")), 6)
    return functions.where("cc > 10 or n_lines > 50").select("id", "cc", "n_lines", risk.alias("risk")).orderBy(F.desc("risk"), "id").limit(k)


def smells(functions: DataFrame) -> DataFrame:
    """id, smell, severity: long functions, complex ones, god classes, shotgun surgery."""
    rules = (("long_function", "n_lines", 50, 100), ("high_complexity", "cc", 10, 20), ("god_class", "n_methods", 15, 25), ("shotgun_surgery", "n_in", 10, 20))
    each = [F.when(F.col(c) > lo, F.struct(F.lit(name).alias("smell"), F.when(F.col(c) > hi, "high").otherwise("medium").alias("severity"))) for name, c, lo, hi in rules]
    return functions.select("id", F.explode(F.array_compact(F.array(*each))).alias("s")).select("id", "s.smell", "s.severity")


def top_smells(rows: DataFrame, k: int = 5) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return rows.orderBy(rank, "smell", "id").limit(k)


def problems(functions: DataFrame, k: int = 5) -> DataFrame:
    """+3 cc > 15, +2 lines > 100, +2 in > 15, +2 out > 15, 10 at most; kept from 5 on."""
    step = lambda c, most, points: F.when(F.col(c) > most, points).otherwise(0)
    risk = F.least(F.lit(10), step("cc", 15, 3) + step("n_lines", 100, 2) + step("n_in", 15, 2) + step("n_out", 15, 2))
    return functions.select("id", risk.alias("risk")).where("risk >= 5").orderBy(F.desc("risk"), "id").limit(k)


def importance(n_in: Column, exported: Column, is_main: Column, pattern: Column, cc: Column) -> Column:
    return F.round(n_in * F.when(exported, 1.5).otherwise(1.0) * F.when(is_main, 2.0).otherwise(1.0) * F.when(pattern, 1.3).otherwise(1.0) * (1 + cc / 20), 6)


def impact(n_in: Column, n_out: Column, cc: Column, public: Column) -> Column:
    return F.least(F.lit(10.0), 1 + F.least(n_in / 2, F.lit(5.0)) + F.least(n_out / 2, F.lit(3.0)) + F.when(cc > 10, 2.0).otherwise(0.0) + F.when(public, 2.0).otherwise(0.0))


def simple_risk(cc: Column, n_lines: Column, n_in: Column) -> Column:
    """.5 cc, steps for lines (50, 100) and references (5, 10), 10 at most."""
    return F.least(F.lit(10.0), 0.5 * cc + F.when(n_lines > 100, 2.0).when(n_lines > 50, 1.0).otherwise(0.0) + F.when(n_in > 10, 2.0).when(n_in > 5, 1.0).otherwise(0.0))


def risk_tags(cc: Column, n_lines: Column, nesting: Column, n_params: Column) -> Column:
    return F.array_compact(F.array(F.when(cc > 10, "complex"), F.when(n_lines > 100, "long"), F.when(nesting > 4, "nested"), F.when(n_params > 5, "many_params")))


def halstead(n1: Column, n2: Column, total1: Column, total2: Column) -> tuple[Column, Column]:
    """(volume, difficulty) of distinct and total operators and operands."""
    vocabulary = n1 + n2
    volume = F.when(vocabulary > 0, (total1 + total2) * F.log2(vocabulary)).otherwise(0.0)
    return F.round(volume, 6), F.round(F.when(n2 > 0, n1 / 2 * total2 / n2).otherwise(0.0), 6)


def maintainability(volume: Column, cc: Column, n_lines: Column) -> Column:
    """171 - 5.2 ln V - .23 cc - 16.2 ln lines, in 0 .. 100."""
    raw = 171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * cc - 16.2 * F.log(F.greatest(n_lines, F.lit(1)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 6)


def rating(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def percentiles(rows: DataFrame, score: str) -> DataFrame:
    """Adds percentile (share of scores <= own, in %) and severity; distinct scores are ranked, then joined."""
    counts = rows.groupBy(score).agg(F.count("*").alias("_n"))
    all_ = F.broadcast(counts.agg(F.sum("_n").alias("_all")))
    ranked = running_sum(counts, [score], "_n", "_upto").crossJoin(all_).select(score, (F.col("_upto") * 100.0 / F.col("_all")).alias("percentile"))
    return rows.join(ranked, score).withColumn("percentile", F.round("percentile", 6)).withColumn("severity", severity(F.col("percentile")))


def severity(percentile: Column) -> Column:
    return F.when(percentile >= 95, "critical").when(percentile >= 85, "high").when(percentile >= 70, "medium").otherwise("low")


def cohesion_lcom(per_file: DataFrame) -> DataFrame:
    """1 - (n - m) / m for n symbols and m methods of a file; may be negative; null without methods."""
    return per_file.select("file_id", F.round(F.when(F.col("m") > 0, 1 - (F.col("n") - F.col("m")) / F.col("m")), 6).alias("cohesion"))


def name_quality(names: DataFrame) -> DataFrame:
    """quality = 100 - mean name length (0 at least); smelly names: over 30 characters or 3 underscores."""
    n = F.char_length("name")
    return names.agg(F.round(F.greatest(F.lit(0.0), 100 - F.avg(n)), 6).alias("quality"), F.count_if((n > 30) | (F.regexp_count("name", F.lit("_")) > 3)).alias("n_smells"))


# Effect categories, from bit 1 on.
EFFECTS = {"param_write": 2, "receiver_write": 4, "global_write": 8, "closure_write": 16, "field_write": 32, "io": 64, "network": 128, "database": 256, "throws": 512, "channel": 1024, "async": 2048, "dynamic_call": 4096, "external_call": 8192}
_LOCAL = 2 | 4 | 16 | 32
_WORLD = 64 | 128 | 256 | 1024 | 2048


def purity_level(mask: Column) -> Column:
    """1 pure, 2 local effects, 3 object state, 4 global state, 5 the outside world."""
    return F.when(mask == 0, 1).when(mask.bitwiseAND(F.lit(_WORLD)) != 0, 5).when(mask.bitwiseAND(F.lit(8)) != 0, 4).when(mask.bitwiseAND(F.lit(4 | 32)) != 0, 3).otherwise(2)


def purity_score(level: Column) -> Column:
    return F.when(level == 1, 1.0).when(level == 2, 0.6).when(level == 3, 0.3).otherwise(0.0)


def effect_names(mask: Column) -> Column:
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(v)) != 0, k) for k, v in EFFECTS.items()]))


def purity_summary(masks: DataFrame) -> DataFrame:
    """category, n for each effect, with `pure` and `impure` totals."""
    hit = masks.select(F.explode(F.concat(effect_names(F.col("mask")), F.array(F.when(F.col("mask") == 0, "pure").otherwise("impure")))).alias("category"))
    return hit.groupBy("category").agg(F.count("*").alias("n"))


# Ordered keyword rules.
LAYERS = (("presentation", "controller|handler|view|ui|page|component"), ("api", "api|route|endpoint|rest|graphql"), ("business", "service|manager|usecase|logic"), ("data", "repo|store|dao|model|entity|database|db"), ("infrastructure", "config|util|helper|logger|client"))


def layer(name: Column) -> Column:
    """The first rule that a lower-cased name meets; else `other`."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike(p), k) for k, p in LAYERS], F.lit("other"))


def layer_rollup(names: DataFrame) -> DataFrame:
    """layer, n, cohesion (largest share of a 3-letter prefix), complexity n / 10."""
    rows = names.select(layer(F.col("name")).alias("layer"), F.lower(F.substring("name", 1, 3)).alias("prefix"))
    per = rows.groupBy("layer", "prefix").agg(F.count("*").alias("k")).groupBy("layer").agg(F.sum("k").alias("n"), F.max("k").alias("m"))
    return per.select("layer", "n", F.round(F.col("m") / F.col("n"), 6).alias("cohesion"), F.round(F.col("n") / 10, 6).alias("complexity"))


def layer_violations(rollup: DataFrame) -> DataFrame:
    """missing layers, and layers over five times the mean size."""
    spark = rollup.sparkSession
    every = F.broadcast(spark.createDataFrame([(k,) for k, _ in LAYERS], "layer string"))
    missing = every.join(rollup, "layer", "left_anti").select("layer", F.lit("missing").alias("violation"))
    mean = F.broadcast(rollup.agg(F.avg("n").alias("mean")))
    large = rollup.crossJoin(mean).where("n > 5 * mean").select("layer", F.lit("oversized").alias("violation"))
    return missing.union(large)


def module_rollup(symbols: DataFrame) -> DataFrame:
    """dir, n, n_files, cohesion (largest prefix share), stability 1 / (1 + n / 10)."""
    base = symbols.groupBy("dir").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"))
    top = symbols.groupBy("dir", F.lower(F.substring("name", 1, 3)).alias("p")).agg(F.count("*").alias("k")).groupBy("dir").agg(F.max("k").alias("m"))
    return base.join(top, "dir").select("dir", "n", "n_files", F.round(F.col("m") / F.col("n"), 6).alias("cohesion"), F.round(1 / (1 + F.col("n") / 10), 6).alias("stability"))


FEATURES = (("authentication", "auth|login|session|token"), ("data", "data|store|repo|record"), ("api", "api|route|handler|request"), ("search", "search|index|query"), ("ui", "view|page|render|display"))


def feature_rollup(names: DataFrame) -> DataFrame:
    """feature, n, completeness: share of four component kinds (handler, service, model, test) present."""
    low = F.lower("name")
    rows = names.select(F.coalesce(*[F.when(low.rlike(p), k) for k, p in FEATURES], F.lit("general")).alias("feature"), F.coalesce(*[F.when(low.contains(k), k) for k in ("handler", "service", "model", "test")]).alias("kind"))
    return rows.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.count_distinct("kind") / 4, 6).alias("completeness"))


def loops(nested: DataFrame) -> DataFrame:
    """function, depth, severity of nested loops: two deep medium, three high."""
    rows = nested.groupBy("function").agg(F.max("depth").alias("depth"))
    return rows.where("depth >= 2").withColumn("severity", F.when(F.col("depth") >= 3, "high").otherwise("medium"))
