"""Queries of graph operators on a graph of users: an edge joins consecutive users of one event type, upwards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.operators import customrules as X
from loomtext.operators import graph as G
from loomtext.registry import query
from loomtext.runtime import table

#: Consecutive users within a type and a day, towards the larger id, so that there is no cycle.
EDGES = "e AS (SELECT DISTINCT source, target FROM (SELECT user_id AS source, lead(user_id) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS target FROM events) WHERE target > source)"


def up_edges(spark, sf_dir):
    w = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.lead("user_id").over(w).alias("target"))
    return rows.where("target > source").distinct()


def ring_edges(spark, sf_dir):
    """Nations in a ring for each region, and one edge between regions that closes no cycle."""
    n = table(spark, sf_dir, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    ring = n.select(F.col("n_nationkey").alias("source"), F.coalesce(F.lead("n_nationkey").over(w), F.first("n_nationkey").over(w)).alias("target"), "n_regionkey")
    return ring.where("n_regionkey < 3").select("source", "target").union(ring.where("n_regionkey >= 3 and source < target").select("source", "target"))


RING = "r AS (SELECT n_nationkey AS source, coalesce(lead(n_nationkey) OVER w, first(n_nationkey) OVER w) AS target, n_regionkey FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)), ring AS (SELECT source, target FROM r WHERE n_regionkey < 3 UNION ALL SELECT source, target FROM r WHERE n_regionkey >= 3 AND source < target)"


@query(f"WITH RECURSIVE {EDGES}, w(seed, id, depth) AS (SELECT DISTINCT source, source, 0 FROM e UNION SELECT w.seed, e.target, w.depth + 1 FROM w JOIN e ON e.source = w.id WHERE w.depth < 2) SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY seed, id")
def graph_closure(spark, sf_dir):
    edges = up_edges(spark, sf_dir)
    return G.closure(edges, edges.select(F.col("source").alias("id")).distinct(), 2)


@query(f"WITH RECURSIVE {EDGES}, w(seed, id) AS (SELECT DISTINCT source, source FROM e UNION SELECT w.seed, e.target FROM w JOIN e ON e.source = w.id) SELECT seed, id FROM w")
def graph_reachable(spark, sf_dir):
    """The closure to its end, however deep."""
    edges = up_edges(spark, sf_dir)
    return G.closure(edges, edges.select(F.col("source").alias("id")).distinct()).select("seed", "id")


#: Consecutive users of one type and day, either way: a graph with overlapping cycles.
_BOTH = "g AS (SELECT DISTINCT source, target FROM (SELECT user_id AS source, lead(user_id) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL)"


@query(f"WITH {_BOTH} SELECT source::VARCHAR AS path FROM g WHERE source = target UNION ALL SELECT a.source || ',' || a.target FROM g a JOIN g b ON b.source = a.target AND b.target = a.source WHERE a.source < a.target UNION ALL SELECT a.source || ',' || a.target || ',' || b.target FROM g a JOIN g b ON b.source = a.target JOIN g c ON c.source = b.target AND c.target = a.source WHERE a.source < a.target AND a.source < b.target AND a.target <> b.target")
def graph_cycle_paths(spark, sf_dir):
    w = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    edges = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.lead("user_id").over(w).alias("target")).where("target IS NOT NULL")
    return G.cycle_paths(edges, 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


RULES = """
# name: trigger -> action
surge: has_label(checkout) AND strength > 0.5 -> multiply_strength(1.3)
far: hops >= 3 OR type == "dependency" -> add_strength(0.2)
data: has_dependency(database) AND hops < 2 -> set_strength(0.8)
"""


@query("WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'label' ELSE 'dependency' END AS type, event_id % 100 / 100.0::DOUBLE AS s0, event_id % 5 AS hops, user_id % 4 = 0 AS checkout, user_id % 5 = 0 AS database FROM events), a AS (SELECT *, checkout AND s0 > 0.5 AS f1, hops >= 3 OR type = 'dependency' AS f2, database AND hops < 2 AS f3 FROM s), b AS (SELECT *, CASE WHEN f1 THEN s0 * 1.3 ELSE s0 END + CASE WHEN f2 THEN 0.2 ELSE 0 END AS s2 FROM a) SELECT id, round(CASE WHEN f3 THEN 0.8 ELSE s2 END, 6)::DOUBLE AS strength, array_to_string(list_filter([CASE WHEN f1 THEN 'surge' END, CASE WHEN f2 THEN 'far' END, CASE WHEN f3 THEN 'data' END], lambda x: x IS NOT NULL), ',') AS fired FROM b")
def custom_rules(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    state = e.select(k.alias("id"), F.when(k % 2 == 0, "label").otherwise("dependency").alias("type"), F.col("event_type").alias("attribute"), (k % 100 / 100.0).alias("strength"), (k % 5).alias("hops"))
    labels = e.where("user_id % 4 = 0").select(k.alias("id"), F.lit("checkout").alias("label"))
    needs = e.where("user_id % 5 = 0").select(k.alias("id"), F.lit("database").alias("dependency"))
    return X.applied(state, X.parse(RULES), labels, needs).select("id", F.round("strength", 6).alias("strength"), F.array_join("fired", ",").alias("fired"))


@query(f"WITH RECURSIVE {EDGES}, w(id, depth) AS (SELECT min(source), 0 FROM e UNION SELECT e.target, w.depth + 1 FROM w JOIN e ON e.source = w.id WHERE w.depth < 5), l AS (SELECT id, min(depth) AS depth FROM w GROUP BY id) SELECT l.id, CAST(l.depth AS INTEGER) AS depth, coalesce(min(p.id), -1) AS parent FROM l LEFT JOIN (SELECT e.target, p.id, p.depth FROM e JOIN l p ON p.id = e.source) p ON p.target = l.id AND p.depth + 1 = l.depth GROUP BY l.id, l.depth")
def graph_call_tree(spark, sf_dir):
    edges = up_edges(spark, sf_dir)
    return G.call_tree(edges, edges.agg(F.min("source").alias("id")), 5).na.fill(-1, ["parent"])


@query(f"WITH RECURSIVE {EDGES}, w(seed, id) AS (SELECT source, target FROM e UNION SELECT w.seed, e.target FROM w JOIN e ON e.source = w.id), d AS (SELECT source, count(*) AS n FROM e GROUP BY source) SELECT seed AS id, any_value(d.n) AS n_direct, count(*) AS n_transitive FROM w JOIN d ON d.source = seed GROUP BY seed")
def graph_dependency_counts(spark, sf_dir):
    return G.dependency_counts(up_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_BOTH}, w(seed, id) AS (SELECT source, target FROM g UNION SELECT w.seed, g.target FROM w JOIN g ON g.source = w.id) SELECT seed AS id, count(*) AS n_transitive FROM w GROUP BY seed")
def graph_reach_estimates(spark, sf_dir):
    """On the graph with cycles. Sketches of this size are exact up to some 1,500 nodes."""
    w = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    edges = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.lead("user_id").over(w).alias("target"))
    return G.reach_estimates(edges, lg_k=14)


@query(f"WITH {RING} SELECT source AS id FROM r WHERE n_regionkey < 3")
def graph_cycles(spark, sf_dir):
    return G.on_cycle(ring_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, lab AS (SELECT source AS id, CASE WHEN source % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM (SELECT DISTINCT source FROM e WHERE source % 17 = 0)), w(id, label, hops) AS (SELECT id, label, 0 FROM lab UNION SELECT e.target, w.label, w.hops + 1 FROM w JOIN e ON e.source = w.id WHERE w.hops < 4), m AS (SELECT id, label, min(hops) AS hops FROM w GROUP BY id, label) SELECT id, label, round(pow(0.8, hops), 6) AS strength, CAST(hops AS INTEGER) AS hops FROM m")
def propagate_labels(spark, sf_dir):
    edges = up_edges(spark, sf_dir)
    labels = edges.where("source % 17 = 0").select(F.col("source").alias("id"), F.when(F.col("source") % 2 == 0, "even").otherwise("odd").alias("label"))
    return G.propagate_labels(edges, labels, max_hops=4)


@query(f"WITH {RING}, l0 AS (SELECT DISTINCT source AS id, 'x' AS label, 1.0::DOUBLE AS s FROM ring WHERE source % 4 = 0), l1 AS (SELECT id, label, sum(s) AS s FROM (SELECT * FROM l0 UNION ALL SELECT target, label, s FROM l0 JOIN ring ON source = id) GROUP BY ALL), l2 AS (SELECT id, label, sum(s) AS s FROM (SELECT * FROM l0 UNION ALL SELECT target, label, s FROM l1 JOIN ring ON source = id) GROUP BY ALL), l3 AS (SELECT id, label, sum(s) AS s FROM (SELECT * FROM l0 UNION ALL SELECT target, label, s FROM l2 JOIN ring ON source = id) GROUP BY ALL) SELECT id, label, s AS strength FROM l3")
def accumulate_labels(spark, sf_dir):
    edges = ring_edges(spark, sf_dir)
    return G.accumulate_labels(edges, edges.where("source % 4 = 0").select(F.col("source").alias("id"), F.lit("x").alias("label")), 3)


@query(f"WITH RECURSIVE {RING}, n AS (SELECT DISTINCT source AS id FROM ring UNION SELECT target FROM ring), m AS (SELECT id, CASE WHEN id % 3 = 0 THEN 2 << CAST(id % 5 AS INT) ELSE 0 END AS mask FROM n), w(seed, id) AS (SELECT id, id FROM n UNION SELECT w.seed, ring.target FROM w JOIN ring ON ring.source = w.id) SELECT w.seed AS id, any_value(o.mask) AS mask, bit_or(m.mask) AS transitive_mask FROM w JOIN m ON m.id = w.id JOIN m o ON o.id = w.seed GROUP BY w.seed")
def propagate_effects(spark, sf_dir):
    edges = ring_edges(spark, sf_dir)
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    masks = nodes.select("id", F.when(F.col("id") % 3 == 0, F.expr("shiftleft(2, cast(id % 5 as int))")).otherwise(0).alias("mask"))
    return G.propagate_effects(edges, masks).select("id", "mask", "transitive_mask")


def _pressure(rounds: int) -> str:
    """SQL: the rounds one after another."""
    out = ["p0 AS (SELECT id, base AS score FROM b)"]
    for i in range(1, rounds + 1):
        out.append(f"p{i} AS (SELECT b.id, b.base + 0.85 * coalesce(avg(q.score), 0) AS score FROM b LEFT JOIN e ON e.source = b.id LEFT JOIN p{i - 1} q ON q.id = e.target GROUP BY b.id, b.base)")
    return ", ".join(out)


@query(f"WITH {EDGES}, b AS (SELECT id, (id % 10) / 10.0::DOUBLE AS base FROM (SELECT source AS id FROM e UNION SELECT target FROM e)), {_pressure(6)} SELECT id, round(score, 6) AS score FROM p6")
def propagate_pressure(spark, sf_dir):
    edges = up_edges(spark, sf_dir)
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return G.pressure(edges, nodes.select("id", (F.col("id") % 10 / 10).alias("base")), rounds=6, epsilon=0.0)


@query(f"WITH {EDGES}, c AS (SELECT DISTINCT target AS id FROM e WHERE target % 10 = 0) SELECT DISTINCT source AS id FROM e WHERE target IN (SELECT id FROM c) AND source NOT IN (SELECT id FROM c)")
def cascade_updates(spark, sf_dir):
    edges = up_edges(spark, sf_dir)
    return G.cascade(edges, edges.where("target % 10 = 0").select(F.col("target").alias("id")).distinct())
