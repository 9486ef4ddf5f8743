"""Listing, inspecting and packing context: symbols, manifests, conversation windows, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import paths as P
from loomtext.runtime import first_rows

# Kinds and their other names, function flags.
KINDS = {"function": ["func", "fn", "def"], "method": ["meth"], "class": ["cls"], "struct": [], "interface": ["iface", "protocol"], "type": ["typedef"], "constant": ["const"], "variable": ["var", "let"], "enum": [], "field": ["property", "prop"]}
FLAGS = {"async": 1, "generator": 2, "method": 4, "variadic": 8}


def parse_kinds(text: str | None) -> list[str]:
    """Kinds of a comma list with aliases; `all`, unknown or nothing means no filter."""
    out = []
    for word in (text or "").lower().split(","):
        word = word.strip()
        out += [k for k, also in KINDS.items() if word == k or word in also or word == k + "s"]
    return out


def kinds_of(text: Column) -> Column:
    """parse_kinds for a column of comma lists."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), lambda w: F.trim(w))
    every = F.array(*map(F.lit, KINDS))
    return F.flatten(F.transform(words, lambda w: F.coalesce(*[F.when(w.isin(k, k + "s", *also), F.array(F.lit(k))) for k, also in KINDS.items()], F.slice(every, 1, 0))))


def list_symbols(symbols: DataFrame, kind: str | None = None, file: str | None = None, exported: bool | None = None, name: str | None = None, receiver: str | None = None, cc: tuple[int, int] | None = None, params: tuple[int, int] | None = None, sort: str = "name", offset: int = 0, limit: int | None = None) -> DataFrame:
    rows = symbols
    kinds = parse_kinds(kind)
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    if file:
        rows = rows.where(P.matches_glob(F.col("path"), file))
    if exported is not None:
        rows = rows.where(F.col("exported") == exported)
    if name:
        rows = rows.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if receiver:
        rows = rows.where(F.col("receiver") == receiver)
    if cc:
        rows = rows.where(F.col("cc").between(*cc))
    if params:
        rows = rows.where(F.col("n_params").between(*params))
    order = {"name": [F.col("name")], "complexity": [F.desc("cc")], "refs": [F.desc("n_in")], "params": [F.desc("n_params")], "line": [F.col("path"), F.col("line")]}[sort]
    return first_rows(rows.orderBy(*order, "path", "line", "name").offset(offset), limit)


def browse_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("line", "name")


def file_stats(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("path").agg(F.count("*").alias("n_symbols"), F.count_if("exported").alias("n_exported"), F.max("cc").alias("max_cc"), F.round(F.avg("cc"), 6).alias("avg_cc"))


def symbol_stats(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("exported").alias("n_exported"))


def top_symbols(symbols: DataFrame, k: int | None = None) -> DataFrame:
    return first_rows(symbols.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name"), k)


def entry_points(symbols: DataFrame, k: int | None = None) -> DataFrame:
    """main and init, then the first k (None: all) exported functions and methods by path and line."""
    mains = symbols.where("name in ('main', 'init')").withColumn("why", F.lit("main"))
    rest = symbols.where("name not in ('main', 'init') and exported and kind in ('function', 'method')")
    rest = first_rows(rest.orderBy("path", "line", "name"), k).withColumn("why", F.lit("exported"))
    return mains.unionByName(rest).select("path", "name", "why")


def flag_names(flags):
    return F.array_compact(F.array(*[F.when(flags.bitwiseAND(F.lit(v)) != 0, k) for k, v in FLAGS.items()]))


def inspect(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Symbols of a name with sorted caller and callee lists."""
    who = symbols.where(F.col("name") == name).select("symbol_id", "name", "kind")
    ids = who.select("symbol_id")
    up = edges.join(ids.withColumnRenamed("symbol_id", "target"), "target", "left_semi").groupBy(F.col("target").alias("symbol_id")).agg(F.sort_array(F.collect_set("source")).alias("callers"))
    down = edges.join(ids.withColumnRenamed("symbol_id", "source"), "source", "left_semi").groupBy(F.col("source").alias("symbol_id")).agg(F.sort_array(F.collect_set("target")).alias("callees"))
    return who.join(up, "symbol_id", "left").join(down, "symbol_id", "left")


def hydrate(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """ref_id, file_id, role, text: each (file, start, end) reference with its lines."""
    each = refs.select("ref_id", "file_id", "role", F.explode(F.sequence("start", "end")).alias("line"))
    rows = each.join(lines.select("file_id", "line", "text"), ["file_id", "line"])
    return rows.groupBy("ref_id", "file_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def by_roles(refs: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    rows = refs.where(F.col("role").isin(list(include))) if include else refs
    return rows.where(~F.col("role").isin(list(exclude))) if exclude else rows


def manifest_stats(refs: DataFrame) -> DataFrame:
    return refs.agg(F.count("*").alias("n_refs"), F.count_distinct("file_id").alias("n_files"), F.sum(F.col("end") - F.col("start") + 1).alias("n_lines"), F.count_distinct("role").alias("n_roles"))


def save_manifest(refs: DataFrame, path: str) -> None:
    refs.select("ref_id", "file_id", "role", "start", "end").write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ref_id long, file_id long, role string, start int, end int").json(path)


def conversation_windows(turns: DataFrame, before: int, after: int) -> DataFrame:
    """conv_id, turn, context_chars: characters of the turns around each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-before, after)
    return turns.select("conv_id", "turn", F.sum(F.char_length("text")).over(w).alias("context_chars"), F.count("*").over(w).alias("n_turns"))


def last_turns(turns: DataFrame, budget: int) -> DataFrame:
    """Of each conversation the last turns whose characters fit the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("conv_id", "turn", F.sum(F.char_length("text")).over(w).alias("so_far"))
    return rows.where(F.col("so_far") <= budget)


def snapshots(rows: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc("event_id"))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def as_text(rows: DataFrame, key: str, value: str) -> DataFrame:
    """`key:` and its number, aligned, one line a row."""
    return rows.select(F.concat(F.rpad(F.concat(F.col(key), F.lit(":")), 12, " "), F.lpad(F.col(value).cast("string"), 8, " ")).alias("value"))


def as_dot(edges: DataFrame) -> DataFrame:
    """Rows of a DOT graph's edges."""
    return edges.select(F.format_string('  "%s" -> "%s";', F.col("source").cast("string"), F.col("target").cast("string")).alias("value"))


def compact(rows: DataFrame) -> DataFrame:
    """`path:line: text` rows."""
    return rows.select(F.concat_ws(":", "path", F.col("line").cast("string"), F.concat(F.lit(" "), F.trim("text"))).alias("value"))
