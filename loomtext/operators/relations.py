"""Joins and aggregations over symbols and references: resolution, division, stats, coupling.

Interval lookups spread an interval over fixed-size line buckets, so that they run as equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64


def _spread(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BUCKET), F.floor(end / BUCKET)))


def at_position(points: DataFrame, ranges: DataFrame, key: str, at: str, innermost: bool = True) -> DataFrame:
    """Each point with the range of its key that holds it: the smallest, or the first by start.

    points: key, at, ...; ranges: key, range_id, start, end. Points outside every range are dropped.
    """
    spread = ranges.select(key, "range_id", "start", "end", _spread(F.col("start"), F.col("end")).alias("_b"))
    rows = points.withColumn("_b", F.floor(F.col(at) / BUCKET)).join(spread, [key, "_b"]).where(F.col(at).between(F.col("start"), F.col("end")))
    pick = F.struct(F.col("end") - F.col("start"), "start", "range_id") if innermost else F.struct("start", "end", "range_id")
    return rows.groupBy(*points.columns).agg(F.min_by("range_id", pick).alias("range_id"))


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """ref_id -> target: imported from another file, then same file, then exported, then the smallest id; with
    the number of candidates.

    refs: ref_id, file_id, name; symbols: symbol_id, file_id, name, exported; imports: file_id, name. Symbols are
    reduced first: to the smallest of each name and file, then to a few of each name, so that a reference
    meets one row, however common its name is.
    """
    per_file = symbols.groupBy("name", F.col("file_id").alias("s_file")).agg(F.min("symbol_id").alias("m"), F.min(F.when(F.col("exported"), F.col("symbol_id"))).alias("e"), F.count("*").alias("n"))
    first = per_file.groupBy("name").agg(F.min(F.struct("m", "s_file")).alias("a"), F.min("e").alias("any_exported"), F.sum("n").alias("n_candidates"))
    second = per_file.join(first.select("name", "a"), "name").where(F.col("s_file") != F.col("a.s_file")).groupBy("name").agg(F.min("m").alias("b"))
    rows = refs.select("ref_id", "file_id", "name").join(first, "name", "left").join(second, "name", "left")
    rows = rows.join(per_file.select("name", F.col("s_file").alias("file_id"), F.col("m").alias("same")), ["name", "file_id"], "left")
    if imports is not None:
        rows = rows.join(imports.select("file_id", "name", F.lit(True).alias("imported")).distinct(), ["file_id", "name"], "left")
    else:
        rows = rows.withColumn("imported", F.lit(None).cast("boolean"))
    elsewhere = F.when(F.col("a.s_file") == F.col("file_id"), F.col("b")).otherwise(F.col("a.m"))
    target = F.coalesce(F.when(F.col("imported"), elsewhere), "same", "any_exported", F.col("a.m"))
    return rows.select("ref_id", target.alias("target"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates")).withColumn("ambiguous", F.col("n_candidates") > 1)


def path_suffix(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """import_path, path pairs where either ends with the other: joined on the base name, then tested."""
    b = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    x = files.select("path", b(F.col("path")).alias("base"))
    y = wanted.select("import_path", b(F.col("import_path")).alias("base"))
    return x.join(y, "base").where((F.col("path") == F.col("import_path")) | F.col("path").endswith(F.concat(F.lit("/"), "import_path")) | F.col("import_path").endswith(F.concat(F.lit("/"), "path"))).select("import_path", "path")


def include_status(found: DataFrame) -> DataFrame:
    """import_path -> resolved (one path), ambiguous or not_found."""
    rows = found.groupBy("import_path").agg(F.count("path").alias("n"), F.min("path").alias("path"))
    return rows.select("import_path", F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("not_found").alias("status"), F.when(F.col("n") == 1, F.col("path")).alias("path"))


def divide(has: DataFrame, needs: DataFrame, who: str, what: str, group: str) -> DataFrame:
    """Relational division: (group, who) where who has every `what` that the group needs."""
    size = needs.distinct().groupBy(group).agg(F.count("*").alias("n_needed"))
    rows = has.select(who, what).distinct().join(needs.select(group, what).distinct(), what).groupBy(group, who).agg(F.count("*").alias("n"))
    return rows.join(size, group).where("n = n_needed").select(group, who)


def ref_stats(edges: DataFrame) -> DataFrame:
    """symbol, n_in, n_out, n_files, n_import: edges are source, target, file_id, type."""
    both = edges.select(F.col("target").alias("symbol"), F.lit(1).alias("i"), F.lit(0).alias("o"), "file_id", "type").unionByName(edges.select(F.col("source").alias("symbol"), F.lit(0).alias("i"), F.lit(1).alias("o"), "file_id", "type"))
    not_import = F.col("type") != "import"
    return both.groupBy("symbol").agg(F.count_if((F.col("i") == 1) & not_import).alias("n_in"), F.count_if((F.col("o") == 1) & not_import).alias("n_out"), F.count_distinct("file_id").alias("n_files"), F.count_if(~not_import).alias("n_import"))


def by_type(edges: DataFrame, types: list[str]) -> DataFrame:
    """target and one count column for each type."""
    return edges.groupBy("target").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types])


def neighbours(edges: DataFrame, type_: str, incoming: bool) -> DataFrame:
    a, b = ("target", "source") if incoming else ("source", "target")
    return edges.where(F.col("type") == type_).select(F.col(a).alias("symbol"), F.col(b).alias("other")).distinct()


def best_quality(evidence: DataFrame) -> DataFrame:
    """interface, implementor, quality: the best ranked evidence of each pair."""
    return evidence.groupBy("interface", "implementor").agg(F.max_by("quality", "rank").alias("quality"), F.max("rank").alias("rank"))


def co_located(symbols: DataFrame) -> DataFrame:
    """symbol, n_others: how many other symbols its file has (no pairs are made)."""
    per = symbols.groupBy("file_id").agg((F.count("*") - 1).alias("n_others"))
    return symbols.join(per, "file_id").select("symbol_id", "n_others")


def import_check(declared: DataFrame, used: DataFrame, limit: int = 5) -> DataFrame:
    """file_id, target, status: unused, missing, or coupled (more than `limit` uses without an import)."""
    d, u = declared.select("file_id", "target").distinct().withColumn("d", F.lit(True)), used.groupBy("file_id", "target").agg(F.count("*").alias("n_uses"))
    rows = d.join(u, ["file_id", "target"], "full_outer")
    status = F.when(F.col("n_uses").isNull(), "unused").when(F.col("d").isNull() & (F.col("n_uses") > limit), "coupled").when(F.col("d").isNull(), "missing")
    return rows.select("file_id", "target", F.coalesce("n_uses", F.lit(0)).alias("n_uses"), status.alias("status")).where("status is not null")


def coupling(package_edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """package, n_internal, ca, ce, instability, coupling, cohesion.

    package_edges: source_package, target_package (one row a reference); sizes: package, n_symbols.
    Instability is ce / (ca + ce), .5 without either; coupling min(1, ce / 5n); cohesion
    internal / (internal + ce), .5 without either.
    """
    pairs = package_edges.groupBy("source_package", "target_package").agg(F.count("*").alias("n"))
    inner = F.col("source_package") == F.col("target_package")
    out = pairs.groupBy(F.col("source_package").alias("package")).agg(F.sum(F.when(inner, F.col("n")).otherwise(0)).alias("n_internal"), F.sum(F.when(~inner, F.col("n")).otherwise(0)).alias("ce"))
    into = pairs.where(~inner).groupBy(F.col("target_package").alias("package")).agg(F.sum("n").alias("ca"))
    rows = sizes.join(out, "package", "left").join(into, "package", "left").na.fill(0, ["n_internal", "ca", "ce"])
    half = F.lit(0.5)
    return rows.select(
        "package",
        F.col("n_internal").cast("long").alias("n_internal"),
        F.col("ca").cast("long").alias("ca"),
        F.col("ce").cast("long").alias("ce"),
        F.round(F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(half), 6).alias("instability"),
        F.round(F.least(F.lit(1.0), F.col("ce") / (5 * F.col("n_symbols"))), 6).alias("coupling"),
        F.round(F.when(F.col("n_internal") + F.col("ce") > 0, F.col("n_internal") / (F.col("n_internal") + F.col("ce"))).otherwise(half), 6).alias("cohesion"),
    )


def call_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, n_orphans, mean_out of a call graph."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    a = nodes.join(ends, "id", "left").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("d").isNull()).alias("n_orphans"))
    return a.crossJoin(edges.agg(F.count("*").alias("n_edges"))).select("n_nodes", "n_edges", "n_orphans", F.round(F.col("n_edges") / F.col("n_nodes"), 6).alias("mean_out"))


def fans(edges: DataFrame) -> DataFrame:
    """symbol, fan_in, fan_out: distinct callers and callees; risk by the larger."""
    out = edges.groupBy(F.col("source").alias("symbol")).agg(F.count_distinct("target").alias("fan_out"))
    into = edges.groupBy(F.col("target").alias("symbol")).agg(F.count_distinct("source").alias("fan_in"))
    rows = out.join(into, "symbol", "full_outer").na.fill(0, ["fan_in", "fan_out"])
    most = F.greatest("fan_in", "fan_out")
    return rows.withColumn("risk", F.when(most > 10, "high").when(most > 3, "medium").otherwise("low"))


def first_n(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
