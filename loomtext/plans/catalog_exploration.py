"""Queries of listing, manifests, conversation windows, sinks and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import exploration as E
from loomtext.plans.catalog_relations import EDGES, edges
from loomtext.plans.catalog_search import LINES
from loomtext.registry import query
from loomtext.runtime import table
from loomtext.sources import corpus as C
from loomtext.streaming import events as S

SYMBOLS = "s AS (SELECT p_partkey AS symbol_id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind, 'src/' || p_brand || '.go' AS path, CAST(p_partkey % 500 AS INTEGER) AS line, CAST(p_size AS INTEGER) AS cc, CAST(p_partkey % 5 AS INTEGER) AS n_params, p_partkey % 2 = 0 AS exported FROM part)"


def symbols(spark, sf_dir):
    k = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.when(k == 0, "function").when(k == 1, "method").otherwise("class").alias("kind"), F.concat(F.lit("src/"), "p_brand", F.lit(".go")).alias("path"), (F.col("p_partkey") % 500).cast("int").alias("line"), F.col("p_size").cast("int").alias("cc"), (F.col("p_partkey") % 5).cast("int").alias("n_params"), (F.col("p_partkey") % 2 == 0).alias("exported"))


@query(f"WITH {SYMBOLS} SELECT symbol_id, name, kind, path, line, cc FROM s WHERE kind IN ('function', 'method') AND exported AND cc BETWEEN 5 AND 40 ORDER BY cc DESC, path, line, name LIMIT 50 OFFSET 10")
def list_symbols(spark, sf_dir):
    return E.list_symbols(symbols(spark, sf_dir), kind="func,methods", exported=True, cc=(5, 40), sort="complexity", offset=10, limit=50).select("symbol_id", "name", "kind", "path", "line", "cc")


@query(f"WITH {SYMBOLS} SELECT path, count(*) AS n_symbols, count(*) FILTER (exported) AS n_exported, max(cc) AS max_cc, round(avg(cc), 6) AS avg_cc FROM s GROUP BY path")
def symbol_file_stats(spark, sf_dir):
    return E.file_stats(symbols(spark, sf_dir))


@query(f"WITH {SYMBOLS} SELECT kind, count(*) AS n, count(*) FILTER (exported) AS n_exported FROM s GROUP BY kind")
def symbol_distribution(spark, sf_dir):
    return E.symbol_stats(symbols(spark, sf_dir))


@query(f"WITH {SYMBOLS} SELECT name, count(*) AS n FROM s GROUP BY name ORDER BY n DESC, name LIMIT 100")
def top_symbols(spark, sf_dir):
    return E.top_symbols(symbols(spark, sf_dir), 100)


@query(f"WITH {SYMBOLS} SELECT path, name, 'exported' AS why FROM s WHERE exported AND kind IN ('function', 'method') ORDER BY path, line, name LIMIT 10")
def entry_points(spark, sf_dir):
    return E.entry_points(symbols(spark, sf_dir), 10)


@query("SELECT p_partkey AS symbol_id, array_to_string(list_filter([CASE WHEN p_size & 1 <> 0 THEN 'async' END, CASE WHEN p_size & 2 <> 0 THEN 'generator' END, CASE WHEN p_size & 4 <> 0 THEN 'method' END, CASE WHEN p_size & 8 <> 0 THEN 'variadic' END], lambda x: x IS NOT NULL), ',') AS flags FROM part")
def symbol_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.array_join(E.flag_names(F.col("p_size")), ",").alias("flags"))


@query(f"WITH {EDGES} SELECT p_partkey AS symbol_id, (SELECT count(DISTINCT source) FROM edges WHERE target = p_partkey) AS n_callers, (SELECT count(DISTINCT target) FROM edges WHERE source = p_partkey) AS n_callees FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def inspect_symbol(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = part.agg(F.min("p_name")).first()[0]
    rows = E.inspect(symbols(spark, sf_dir), edges(spark, sf_dir), name)
    return rows.select("symbol_id", F.coalesce(F.size("callers"), F.lit(0)).cast("long").alias("n_callers"), F.coalesce(F.size("callees"), F.lit(0)).cast("long").alias("n_callees"))


REFS = "refs AS (SELECT doc_id AS ref_id, doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'context' ELSE 'test' END AS role, 2 AS start, 4 AS stop FROM documents)"


def refs(spark, sf_dir):
    k = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), F.col("doc_id").alias("file_id"), F.when(k == 0, "primary").when(k == 1, "context").otherwise("test").alias("role"), F.lit(2).alias("start"), F.lit(4).alias("end"))


@query(f"WITH {LINES}, {REFS} SELECT ref_id, r.file_id, role, string_agg(text, chr(10) ORDER BY line) AS text FROM refs r JOIN cut c ON c.file_id = r.file_id AND c.line BETWEEN start AND stop WHERE role <> 'test' GROUP BY ALL")
def manifest_hydrate(spark, sf_dir):
    return E.hydrate(E.by_roles(refs(spark, sf_dir), exclude=["test"]), C.lines(C.files(spark, sf_dir)))


@query(f"WITH {REFS} SELECT count(*) AS n_refs, count(DISTINCT file_id) AS n_files, CAST(sum(stop - start + 1) AS BIGINT) AS n_lines, count(DISTINCT role) AS n_roles FROM refs")
def manifest_stats(spark, sf_dir):
    return E.manifest_stats(refs(spark, sf_dir))


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS context_chars, count(*) OVER w AS n_turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def conversation_windows(spark, sf_dir):
    return E.conversation_windows(table(spark, sf_dir, "conversations"), 2, 1)


@query("WITH s AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM conversations) SELECT * FROM s WHERE so_far <= 1500")
def conversation_budget(spark, sf_dir):
    return E.last_turns(table(spark, sf_dir, "conversations"), 1500)


@query("WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT event_id, user_id, event_type FROM r WHERE r <= 3")
def status_history(spark, sf_dir):
    return E.snapshots(table(spark, sf_dir, "events"), "user_id", "ts", 3).select("event_id", "user_id", "event_type")


@query(f"WITH {EDGES} SELECT DISTINCT '  \"' || source || '\" -> \"' || target || '\";' AS value FROM edges WHERE type = 'import'")
def export_dot(spark, sf_dir):
    return E.as_dot(edges(spark, sf_dir).where("type = 'import'").select("source", "target").distinct())


@query(f"WITH {LINES} SELECT concat_ws(':', path, CAST(line AS VARCHAR), ' ' || trim(text, ' ')) AS value FROM cut WHERE contains(text, 'leau')")
def export_compact(spark, sf_dir):
    rows = C.lines(C.files(spark, sf_dir)).where(F.contains("text", F.lit("leau")))
    return E.compact(rows)


@query("WITH m AS (SELECT user_id AS path, event_type AS type, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT path, min(ts) AS start, max(ts) AS last, arg_max(type, (ts, event_id)) AS type, count(*) AS n_events FROM s GROUP BY path, n")
def debounce_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("type"), "ts", "event_id")
    return S.debounced(rows, "1 hour").select("path", "start", "last", "type", "n_events")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return S.windowed(table(spark, sf_dir, "events"), "1 day").select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query("WITH l AS (SELECT user_id AS path, arg_max(event_type, (ts, event_id)) AS type FROM events GROUP BY user_id) SELECT path, type FROM l WHERE type <> 'error'")
def incremental_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("type"), "ts", "event_id")
    return S.final_state(rows, removed="error")
