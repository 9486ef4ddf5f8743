import pytest
from pyspark.sql import functions as F

from loomtext.operators import graph as G
from loomtext.operators import relations as J

#: chain 1-2-3, diamond 3-4-6 and 3-5-6, cycle 7-8, self-loop 9, disconnected 10-11
EDGES = [(1, 2), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (7, 8), (8, 7), (9, 9), (10, 11), (1, 2)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "source long, target long")


def test_closure(spark, edges):
    seeds = spark.createDataFrame([(1,), (7,)], "id long")
    got = {(r["seed"], r["id"]): r["depth"] for r in G.closure(edges, seeds, 10).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (1, 5): 3, (1, 6): 4, (7, 7): 0, (7, 8): 1}
    assert max(r["depth"] for r in G.closure(edges, seeds, 2).collect()) == 2


def test_cycles(edges):
    assert sorted(r["id"] for r in G.on_cycle(edges).collect()) == [7, 8, 9]


def test_tree(spark, edges):
    got = {r["id"]: r["parent"] for r in G.call_tree(edges, spark.createDataFrame([(1,)], "id long"), 9).collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: 3, 5: 3, 6: 4}


def test_labels(spark, edges):
    labels = spark.createDataFrame([(1, "x"), (5, "x"), (7, "y")], "id long, label string")
    got = {(r["id"], r["label"]): (r["strength"], r["hops"]) for r in G.propagate_labels(edges, labels).collect()}
    assert got[6, "x"] == (0.8, 1) and got[4, "x"] == (0.512, 3) and got[8, "y"] == (0.8, 1) and got[7, "y"] == (1.0, 0)


def test_effects(spark, edges):
    masks = spark.createDataFrame([(i, {6: 4, 7: 8, 9: 2}.get(i, 0)) for i in range(1, 12)], "id long, mask int")
    got = {r["id"]: (r["transitive_mask"], r["hops"]) for r in G.propagate_effects(edges, masks).collect()}
    assert got[1] == (4, 4) and got[6] == (4, 0) and got[8] == (8, 1) and got[7] == (8, 0) and got[10] == (0, 0)


def test_pressure_is_bounded_on_cycles(spark, edges):
    base = spark.createDataFrame([(i, 1.0) for i in range(1, 12)], "id long, base double")
    got = {r["id"]: r["score"] for r in G.pressure(edges, base, rounds=200).collect()}
    assert got[6] == 1.0 and got[4] == 1.85 and 6 < got[7] <= 1 / 0.15 + 1e-6


def test_cascade(spark, edges):
    assert [r["id"] for r in G.cascade(edges, spark.createDataFrame([(3,), (2,)], "id long")).collect()] == [1]


def test_division(spark):
    needs = spark.createDataFrame([("i0", "a"), ("i0", "b"), ("i1", "c")], "iface string, m string")
    has = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t1", "z"), ("t2", "a"), ("t3", "c"), ("t3", "c")], "t string, m string")
    assert sorted(tuple(r) for r in J.divide(has, needs, "t", "m", "iface").collect()) == [("i0", "t1"), ("i1", "t3")]


def test_innermost_and_first(spark):
    ranges = spark.createDataFrame([(1, 100, 1, 500), (1, 200, 50, 60), (2, 300, 1, 10)], "f long, range_id long, start long, `end` long")
    points = spark.createDataFrame([(1, 55, "p"), (1, 499, "q"), (1, 501, "r"), (2, 10, "s")], "f long, line long, name string")
    inner = {r["name"]: r["range_id"] for r in J.at_position(points, ranges, "f", "line").collect()}
    first = {r["name"]: r["range_id"] for r in J.at_position(points, ranges, "f", "line", innermost=False).collect()}
    assert inner == {"p": 200, "q": 100, "s": 300} and first["p"] == 100


def test_no_call_order(edges):
    assert {r["symbol"]: r["fan_out"] for r in J.fans(edges.withColumn("x", F.lit(1))).collect()}[1] == 1


def test_pressure_covers_every_edge(spark):
    from places import SF_MID

    from loomtext.plans import catalog_graphs

    rows = sorted((r["event_type"], r["ts"].date(), r["ts"], r["event_id"], r["user_id"]) for r in spark.read.parquet(f"{SF_MID}/events.parquet").collect())
    pairs = {(a[-1], b[-1]) for a, b in zip(rows, rows[1:], strict=False) if a[:2] == b[:2] and b[-1] > a[-1]}
    got = {tuple(r) for r in catalog_graphs.up_edges(spark, SF_MID).collect()}
    assert got == pairs
    assert {r["id"] for r in catalog_graphs.propagate_pressure(spark, SF_MID).collect()} == {x for p in pairs for x in p}


def test_cycle_paths_against_a_plain_search(spark):
    import random

    from loomtext.operators import graph

    rng = random.Random(3)
    for _ in range(2):
        edges = {(rng.randrange(8), rng.randrange(8)) for _ in range(22)}
        out = {a: {t for s, t in edges if s == a} for a in range(8)}

        def walk(path):
            for t in out[path[-1]]:  # noqa: B023
                if t == path[0]:
                    yield tuple(path)
                elif t > path[0] and t not in path and len(path) < 4:
                    yield from walk([*path, t])

        want = sorted(p for a in range(8) for p in walk([a]))
        got = graph.cycle_paths(spark.createDataFrame(sorted(edges), "source long, target long"), 4)
        assert sorted(tuple(r["path"]) for r in got.collect()) == want


def test_custom_rules(spark):
    import pytest

    from loomtext.operators import customrules as X

    state = spark.createDataFrame([(1, "label", "a", 0.6, 1), (2, "label", "a", 0.6, 4), (3, "dependency", "b", 0.1, 0)], "id long, type string, attribute string, strength double, hops long")
    labels, none = spark.createDataFrame([(1, "x"), (1, "y")], "id long, label string"), spark.createDataFrame([], "id long, dependency string")
    rules = X.parse("a: has_label('x') AND strength >= 0.6 -> multiply_decay(0.5)\n# no\nb: strength < 0.5 OR hops > 3 -> add_strength(1)\nc: type != \"label\" -> set_strength(2)\n")
    rows = {r["id"]: (round(r["strength"], 6), r["fired"]) for r in X.applied(state, rules, labels, none).collect()}
    assert rows == {1: (0.3, ["a"]), 2: (1.6, ["b"]), 3: (2.0, ["b", "c"])}
    for bad in ("a: x -> add_strength(1)", "a: hops > 1 -> explode(1)", "a: type > 'x' -> add_strength(1)", "no rule"):
        with pytest.raises(ValueError):
            X.applied(state, X.parse(bad), labels, none)


def test_siblings_come_once_without_a_shuffle_of_pairs(spark):
    from loomtext.operators import context as X

    # 9 is a method of two receivers; reference r names two methods of one receiver, which bring in each other
    rows = [(1, 1, "A", "method"), (2, 1, "A", "method"), (3, 1, "A", "method"), (4, 1, "A", "class"), (5, 2, "A", "method"), (6, 1, None, "method"), (9, 1, "A", "method"), (9, 2, "A", "method")]
    symbols = spark.createDataFrame([(i, f, r, k, "x.go") for i, f, r, k in rows], "symbol_id long, file_id long, receiver string, kind string, path string")
    edges = spark.createDataFrame([], "source long, target long, type string")
    refs = spark.createDataFrame([("q", 1), ("r", 1), ("r", 2), ("r", 5), ("s", 4), ("t", 6)], "ref_id string, symbol_id long")
    got = X.expanded(refs, symbols, edges, ["siblings"])
    assert sorted((r["ref_id"], r["symbol_id"]) for r in got.collect()) == [("q", 2), ("q", 3), ("q", 9), ("r", 1), ("r", 2), ("r", 3), ("r", 9), ("s", 1), ("s", 2), ("s", 3), ("s", 9)]
    many = spark.range(6000).selectExpr("id AS symbol_id", "1L AS file_id", "'A' AS receiver", "'method' AS kind", "'x.go' AS path")
    got = X.expanded(many.selectExpr("symbol_id AS ref_id", "symbol_id").where("ref_id < 50"), many, edges, ["siblings"])
    assert got.count() == got.distinct().count() == 50 * 5999

    def records(plan):
        nodes, total = [plan], 0
        while nodes:
            p = nodes.pop()
            if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                nodes.append(p.executedPlan())
            elif p.getClass().getSimpleName().endswith("QueryStageExec"):
                nodes.append(p.plan())
            else:
                m = p.metrics().get("shuffleRecordsWritten")
                total += m.get().value() if m.isDefined() else 0
                nodes += [p.children().apply(i) for i in range(p.children().size())]
        return total

    got.collect()
    assert records(got._jdf.queryExecution().executedPlan()) < 50_000


def test_reach_of_a_large_tangle_is_counted(spark):
    # every node of 0..2000 reaches every other within eleven steps; 5000 leads in, 6000 is led to, 7000 points at itself
    n = 2001
    edges = [(i, j) for i in range(n) for j in (2 * i % n, (2 * i + 1) % n)] + [(5000, 3), (4, 6000), (7000, 7000), (6000, 6001), (None, 1), (1, None)]
    rows = spark.createDataFrame(edges, "source long, target long")
    got = {r["id"]: r["n_transitive"] for r in G.reach_estimates(rows, lg_k=4).collect()}
    assert got == dict.fromkeys(range(n), n + 2) | {5000: n + 2, 7000: 1, 6000: 1}
