"""Graph operators on edge lists: closure, call trees, cycles, reachability, propagation.

Each is a bounded loop of joins. A loop's tables are written to the shared checkpoint folder, so lost
executors cost a stage and plans stay short; only one-row aggregates reach the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.runtime import Scratch


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seed, id, depth: nodes reachable from each seed (id) in at most max_depth steps (None: any number), first
    depth each.

    Semi-naive: only the last frontier is joined; a reached pair is never joined again.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    edges = scratch.write(edges.select("source", "target").distinct(), "edges")
    frontier = scratch.write(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0)), "f0")
    reached = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(edges, F.col("id") == F.col("source")).select("seed", F.col("target").alias("id")).distinct()
        frontier = scratch.write(step.join(reached, ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)), f"f{depth}")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def call_tree(edges: DataFrame, root: DataFrame, max_depth: int) -> DataFrame:
    """id, depth, parent: each node once, at its least depth, under its smallest caller there."""
    levels = closure(edges, root, max_depth)
    up = levels.select(F.col("id").alias("parent"), F.col("depth").alias("p_depth"))
    calls = edges.select("source", "target").distinct().join(up, F.col("source") == F.col("parent")).select("target", "parent", "p_depth")
    rows = levels.join(calls, (F.col("id") == F.col("target")) & (F.col("depth") == F.col("p_depth") + 1), "left")
    return rows.groupBy("id", "depth").agg(F.min("parent").alias("parent"))


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component: nodes of one component reach each other; component is its largest id.

    Rounds of: trim nodes without both a way in and a way out (each is a component of its own, and left out
    here unless it points at itself); let the largest id flow forward until it settles, which colours every
    node by the largest id that reaches it; walk back from each colour's own node within its colour, which
    gives that node's component; take these nodes out. State is one row a node, never pairs.
    """
    scratch = Scratch(edges.sparkSession, "strong")
    edges = edges.select("source", "target").distinct()
    done = edges.where("source = target").select(F.col("source").alias("id"), F.col("source").alias("component"))
    left = scratch.write(edges.where("source != target"), "e0-0")
    parts, turn = [], 0
    while not left.isEmpty():
        n, i = left.count(), 0
        while True:
            both = left.select(F.col("source").alias("id")).distinct().join(left.select(F.col("target").alias("id")).distinct(), "id", "left_semi")
            kept = left.join(both.withColumnRenamed("id", "source"), "source", "left_semi").join(both.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
            i += 1
            left = scratch.write(kept, f"e{turn}-{i}")
            now = left.count()
            if now == n or not now:
                break
            n = now
        if not now:
            break
        colour = scratch.write(left.select(F.col("source").alias("id")).distinct().withColumn("colour", F.col("id")), f"c{turn}-0")
        i = 0
        while True:
            got = colour.join(left, F.col("id") == F.col("source")).groupBy(F.col("target").alias("id")).agg(F.max("colour").alias("more"))
            i += 1
            after = scratch.write(colour.join(got, "id", "left").select("id", F.greatest("colour", F.coalesce("more", "colour")).alias("colour"), (F.coalesce("more", "colour") > F.col("colour")).alias("moved")), f"c{turn}-{i}")
            moved = after.where("moved").isEmpty()
            scratch.drop(f"c{turn}-{i - 1}")
            colour = after.select("id", "colour")
            if moved:
                break
        a, b = colour.select(F.col("id").alias("source"), F.col("colour").alias("c1")), colour.select(F.col("id").alias("target"), F.col("colour").alias("c2"))
        inner = scratch.write(left.join(a, "source").join(b, "target").where("c1 = c2").select("source", "target", "c1"), f"i{turn}")
        found = frontier = scratch.write(colour.where("id = colour").select("id", F.col("colour").alias("component")), f"s{turn}-0")
        i = 0
        while True:
            back = frontier.join(inner, F.col("id") == F.col("target")).select(F.col("source").alias("id"), F.col("c1").alias("component")).distinct()
            i += 1
            frontier = scratch.write(back.join(found, "id", "left_anti"), f"s{turn}-{i}")
            if frontier.isEmpty():
                break
            found = found.union(frontier)
        parts.append(found)
        turn += 1
        rest = left.join(found.select(F.col("id").alias("source")), "source", "left_anti").join(found.select(F.col("id").alias("target")), "target", "left_anti")
        left = scratch.write(rest.select("source", "target"), f"e{turn}-0")
    for part in parts:
        done = done.join(part.select("id"), "id", "left_anti").union(part)
    return done


def on_cycle(edges: DataFrame) -> DataFrame:
    """id of nodes that lie on a cycle, however long."""
    return cycles(edges).select("id").distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """cycle, id, size: the nodes of each tangle of cycles (a strong component of two nodes or more, or a node
    that points at itself); cycle is the largest id of it."""
    comps = strong_components(edges)
    sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
    loops = edges.where("source = target").select(F.col("source").alias("id")).distinct().withColumn("loop", F.lit(True))
    rows = comps.join(sizes, "component").join(loops, "id", "left").where("size > 1 or loop")
    return rows.select(F.col("component").alias("cycle"), "id", "size")


def cycle_paths(edges: DataFrame, longest: int) -> DataFrame:
    """path: every simple cycle of at most `longest` nodes once, from its smallest id on (an edge to itself too).

    Edges that leave a tangle of cycles are dropped first. Paths then start at each node, go on to larger ids only,
    and are cycles when an edge leads back; a round is one join, written, and paths of a round are its state.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    edges = edges.select("source", "target").distinct()
    comp = cycles(edges).select("id", "cycle")
    inside = edges.join(comp.toDF("source", "a"), "source").join(comp.toDF("target", "b"), "target").where("a = b").select("source", "target")
    inside = scratch.write(inside, "edges")
    found = [inside.where("source = target").select(F.array("source").alias("path"))]
    ahead = scratch.write(inside.where("target > source").select(F.array("source", "target").alias("path"), F.col("target").alias("end")), "p2")
    back = inside.where("target < source").select(F.col("source").alias("end"), F.col("target").alias("start"))
    for n in range(2, longest + 1):
        found.append(ahead.withColumn("start", F.element_at("path", 1)).join(back, ["end", "start"]).select("path"))
        if n == longest or ahead.isEmpty():
            break
        step = ahead.join(inside.where("source != target"), F.col("end") == F.col("source")).where("target > path[0] and not array_contains(path, target)")
        ahead = scratch.write(step.select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("end")), f"p{n + 1}")
    out = found[0]
    for rows in found[1:]:
        out = out.union(rows)
    return out


def dependency_counts(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, n_direct, n_transitive: nodes that each node reaches in at most max_depth steps (None: any number);
    itself only counts if it is on a cycle.

    Exact counts need each node's reached set, so state grows with the pairs; bound max_depth on large graphs.
    """
    nodes = edges.select(F.col("source").alias("id")).distinct()
    far = closure(edges, nodes, max_depth).where("depth > 0").groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("n_transitive"), F.count_if(F.col("depth") == 1).alias("n_direct"))
    own = on_cycle(edges).withColumn("again", F.lit(1)) if max_depth is None else nodes.limit(0).withColumn("again", F.lit(1))
    return nodes.join(far, "id", "left").join(own, "id", "left").select("id", F.coalesce("n_direct", F.lit(0)).alias("n_direct"), (F.coalesce("n_transitive", F.lit(0)) + F.coalesce("again", F.lit(0))).alias("n_transitive"))


#: Components whose reached pairs are counted instead of sketched: 12.5 million pairs at most.
COUNTED = 5_000


def reach_estimates(edges: DataFrame, lg_k: int = 12, max_depth: int | None = None) -> DataFrame:
    """id, n_transitive: about how many nodes each node reaches in at most max_depth steps (None: any number);
    itself only counts if it is on a cycle. Ids are whole numbers or strings; edges with a null end are left out.

    Nodes on a common cycle reach the same, so without a max_depth a strong component is one node of weight. Where up
    to `COUNTED` components are left, numbers are exact: the sum of the sizes of the components that each reaches.
    Else state is one HyperLogLog sketch a component: each round unites the successors' sketches, until no estimate
    moves. The relative standard error is about 1.04 / sqrt(2^lg_k), 1.6 % for 12; numbers up to some 2^lg_k / 11 are
    exact but for colliding 26-bit hashes. `dependency_counts` is the exact way for all graphs, with pairs as state.
    """
    if max_depth is not None:
        return _sketched(edges, None, lg_k, max_depth)
    scratch = Scratch(edges.sparkSession, "condensed")
    edges = scratch.write(edges.where("source is not null and target is not null").select("source", "target").distinct(), "edges")
    cyclic = scratch.write(strong_components(edges), "cyclic")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    of = scratch.write(ends.join(cyclic, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.col("component").isNotNull().alias("cyclic")), "of")
    # an edge within a component is one from it to itself: a node on a cycle reaches itself
    ways = edges.join(of.select(F.col("id").alias("source"), F.col("component").alias("a")), "source").join(of.select(F.col("id").alias("target"), F.col("component").alias("b")), "target")
    ways = scratch.write(ways.select(F.col("a").alias("source"), F.col("b").alias("target")).distinct(), "ways")
    sizes = scratch.write(of.groupBy("component").agg(F.count("*").alias("size"), F.bool_or("cyclic").alias("cyclic")), "sizes")
    if sizes.count() <= COUNTED:
        far = closure(ways.where("source != target"), sizes.select(F.col("component").alias("id"))).where("depth > 0").select(F.col("seed").alias("component"), F.col("id").alias("to"))
        own = sizes.where("cyclic").select("component", F.col("component").alias("to"))
        each = far.union(own).join(sizes.select(F.col("component").alias("to"), "size"), "to").groupBy("component").agg(F.sum("size").alias("n_transitive"))
    else:
        each = _sketched(ways, of.select("id", "component"), lg_k, None).withColumnRenamed("id", "component")
    return of.join(each, "component").select("id", "n_transitive")


def _sketched(edges: DataFrame, members: DataFrame | None, lg_k: int, max_depth: int | None) -> DataFrame:
    """id, n_transitive of reach_estimates by sketches. members: id, component, where edges are between components."""
    scratch = Scratch(edges.sparkSession, "reach")
    edges = scratch.write(edges.where("source is not null and target is not null").select("source", "target").distinct(), "edges")
    # what a node hands on: itself, and what it reached a round ago
    if members is None:
        members = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("component", F.col("id"))
    own = scratch.write(members.groupBy(F.col("component").alias("id")).agg(F.hll_sketch_agg(members["id"], lg_k).alias("own")), "own")
    reach = seen = None
    for step in count(1) if max_depth is None else range(1, max_depth + 1):
        hands = own if reach is None else own.join(reach.select("id", "far"), "id", "left").select("id", F.coalesce(F.hll_union("own", "far"), "own").alias("own"))
        got = edges.join(hands, F.col("target") == F.col("id")).groupBy(F.col("source").alias("id")).agg(F.hll_union_agg("own").alias("far"))
        reach = scratch.write(got.withColumn("n_transitive", F.hll_sketch_estimate("far")), f"r{step}")
        if step > 1:
            scratch.drop(f"r{step - 1}")
        # estimates only grow, so their sum stands still when all do
        now = reach.agg(F.sum("n_transitive")).first()[0]
        if now == seen:
            break
        seen = now
    if reach is None:
        return own.limit(0).select("id", F.lit(0).cast("long").alias("n_transitive"))
    return reach.select("id", "n_transitive")


def reached_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """source_file, n_files: other files that a file's symbols refer to. files: id, file_id."""
    a, b = files.select(F.col("id").alias("source"), F.col("file_id").alias("source_file")), files.select(F.col("id").alias("target"), F.col("file_id").alias("target_file"))
    rows = edges.select("source", "target").distinct().join(a, "source").join(b, "target").where("source_file != target_file")
    return rows.groupBy("source_file").agg(F.count_distinct("target_file").alias("n_files"))


def oriented(edges: DataFrame, direction: str = "downstream", types: list[str] | None = None, hierarchy: DataFrame | None = None) -> DataFrame:
    """source, target: edges along a direction (downstream: to what is called, upstream: to callers, or
    bidirectional), of some types, with type hierarchy edges where given."""
    rows = edges.where(F.col("type").isin(types)).select("source", "target") if types else edges.select("source", "target")
    if hierarchy is not None:
        rows = rows.union(hierarchy.select("source", "target"))
    back = rows.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return {"downstream": lambda: rows, "upstream": lambda: back, "bidirectional": lambda: rows.union(back)}[direction]().distinct()


# Name tests of boost conditions.
BOOSTS = {"public": r"^\p{Lu}", "critical": r"(?i)critical|urgent|emergency", "payment": r"(?i)payment|billing|charge", "security": r"(?i)auth|security|permission"}


def propagate_configured(edges: DataFrame, labels: DataFrame, names: DataFrame, rules: DataFrame) -> DataFrame:
    """id, label, strength, hops: labels spread by a table of rules, one a label (config.rules_table).

    names: id, name. reachability and decay: strength falls by `decay` a hop; max: it stays; accumulation:
    arriving strengths are summed, 1 at most. Where a name meets `boost_on`, strength is raised by `boost`, 1 at
    most. The best of each node is kept; a label stops at its max_hops, or below its min_strength. All labels
    run together; each round is one join.
    """
    scratch = Scratch(edges.sparkSession, "rules")
    rules = F.broadcast(scratch.write(rules, "rules"))  # one row a label
    ways = scratch.write(oriented(edges, "downstream").withColumn("way", F.lit("downstream")).union(oriented(edges, "upstream").withColumn("way", F.lit("upstream"))).withColumn("both", F.lit("bidirectional")), "edges")
    of_names = scratch.write(names.select("id", "name"), "names")
    most = rules.agg(F.max("max_hops")).first()[0] or 0
    state = scratch.write(labels.select("id", "label").distinct().join(rules.select("label"), "label").select("id", "label", F.lit(1.0).alias("strength"), F.lit(0).alias("hops")), "s0")
    frontier = state
    for hop in range(1, most + 1):
        sent = frontier.join(rules, "label").where(F.col("max_hops") >= hop)
        sent = sent.join(ways, (F.col("id") == F.col("source")) & ((F.col("direction") == F.col("way")) | (F.col("direction") == F.col("both"))))
        sent = sent.withColumn("strength", F.when(F.col("mode") == "max", F.col("strength")).otherwise(F.col("strength") * F.col("decay")))
        sums = F.when(F.first("mode") == "accumulation", F.least(F.lit(1.0), F.sum("strength"))).otherwise(F.max("strength"))
        sent = sent.groupBy(F.col("target").alias("id"), "label").agg(sums.alias("strength"), *[F.first(x).alias(x) for x in ("min_strength", "boost", "boost_on")]).join(of_names, "id", "left")
        meets = F.coalesce(*[F.when(F.col("boost_on") == k, F.col("name").rlike(p)) for k, p in BOOSTS.items()], F.lit(False))
        raised = F.when(meets, F.least(F.lit(1.0), F.col("strength") * F.col("boost"))).otherwise(F.col("strength"))
        sent = sent.withColumn("strength", F.round(raised, 9)).where("strength >= min_strength").select("id", "label", "strength")
        before = state.select("id", "label", F.col("strength").alias("was"))
        frontier = scratch.write(sent.join(before, ["id", "label"], "left").where("was is null or strength > was").select("id", "label", "strength", F.lit(hop).alias("hops")), f"f{hop}")
        if frontier.isEmpty():
            break
        state = scratch.write(state.join(frontier.select("id", "label"), ["id", "label"], "left_anti").union(frontier), f"s{hop}")
    return state.withColumn("strength", F.round("strength", 6))


def propagate_labels(edges: DataFrame, labels: DataFrame, decay: float = 0.8, max_hops: int = 10, cut: float = 0.001) -> DataFrame:
    """id, label, strength, hops: the strongest that reaches a node along edges source -> target.

    Strength falls by `decay` a hop, so a shorter way is never weaker and each (node, label) is settled
    the first time it is reached.
    """
    scratch = Scratch(edges.sparkSession, "labels")
    edges = scratch.write(edges.select("source", "target").distinct(), "edges")
    frontier = scratch.write(labels.select("id", "label", F.lit(1.0).alias("strength"), F.lit(0).alias("hops")).distinct(), "l0")
    known, strength = frontier, 1.0
    for hop in range(1, max_hops + 1):
        strength *= decay
        if strength < cut:
            break
        step = frontier.join(edges, F.col("id") == F.col("source")).select(F.col("target").alias("id"), "label").distinct()
        frontier = scratch.write(step.join(known, ["id", "label"], "left_anti").select("id", "label", F.lit(strength).alias("strength"), F.lit(hop).alias("hops")), f"l{hop}")
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known.withColumn("strength", F.round("strength", 6))


def accumulate_labels(edges: DataFrame, labels: DataFrame, rounds: int = 3) -> DataFrame:
    """id, label, strength: own strength 1 plus the neighbours' of the round before, `rounds` times.

    On a cycle this grows with the rounds, which are fixed for that.
    """
    scratch = Scratch(edges.sparkSession, "sums")
    own = labels.select("id", "label", F.lit(1.0).alias("strength")).distinct()
    state = scratch.write(own, "s0")
    for i in range(1, rounds + 1):
        sent = state.join(edges, F.col("id") == F.col("source")).groupBy(F.col("target").alias("id"), "label").agg(F.sum("strength").alias("strength"))
        state = scratch.write(own.union(sent).groupBy("id", "label").agg(F.sum("strength").alias("strength")), f"s{i}")
    return state


def dependency_weights(edges: DataFrame, seeds: DataFrame, mode: str = "linear", max_hops: int = 5, cut: float = 0.0) -> DataFrame:
    """id, n_sources, total, best: seeds' hop-weighted influence on each node they reach; weights over `cut`.

    total sums the weights, best is the largest, n_sources counts the seeds once each.
    """
    far = closure(edges, seeds, max_hops).where("depth > 0").withColumn("w", hop_weight(F.col("depth"), mode)).where(F.col("w") > cut)
    return far.groupBy("id").agg(F.count_distinct("seed").alias("n_sources"), F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 6).alias("best"))


def dependency_depth(edges: DataFrame, max_depth: int) -> DataFrame:
    """id, depth: the longest shortest way from a node, within max_depth."""
    nodes = edges.select(F.col("source").alias("id")).distinct()
    return closure(edges, nodes, max_depth).groupBy(F.col("seed").alias("id")).agg(F.max("depth").alias("depth"))


def critical(labelled: DataFrame, labels: list[str], least: float = 0.7) -> DataFrame:
    """Nodes whose strength for a critical label is over the least; the hop-discounted confidence with it."""
    rows = labelled.where(F.col("label").isin(labels) & (F.col("strength") > least))
    return rows.withColumn("confidence", F.round(F.col("strength") * F.pow(F.lit(0.9), F.col("hops")), 6)).orderBy(F.desc("strength"), "id", "label")


def through_implementations(calls: DataFrame, implements: DataFrame) -> DataFrame:
    """source, target, confidence: calls of an interface, spread evenly over its implementations.

    implements: interface, implementor.
    """
    n = implements.groupBy("interface").agg(F.count("*").alias("n"))
    rows = calls.join(implements, F.col("target") == F.col("interface")).join(n, "interface")
    return rows.select("source", F.col("implementor").alias("target"), F.round(1 / F.col("n"), 6).alias("confidence"))


def hop_weight(hops, mode: str = "linear"):
    if mode == "exponential":
        return F.pow(F.lit(0.8), hops)
    if mode == "log":
        return F.when(hops > 0, 1 / F.log(hops + F.lit(1.0))).otherwise(1.0)
    return F.greatest(F.lit(0.0), 1 - 0.2 * hops)


def propagate_effects(calls: DataFrame, masks: DataFrame, max_rounds: int = 100) -> DataFrame:
    """id, mask, transitive_mask, hops: callees' effects are OR-ed into callers until nothing changes.

    calls: source (caller), target (callee). hops is the last round that changed a node.
    """
    scratch = Scratch(calls.sparkSession, "effects")
    calls = scratch.write(calls.select("source", "target").distinct(), "calls")
    state = scratch.write(masks.groupBy("id").agg(F.bit_or("mask").alias("own")).select("id", "own", F.col("own").alias("mask"), F.lit(0).alias("hops")), "m0")
    for i in range(1, max_rounds + 1):
        got = calls.join(state.select(F.col("id").alias("target"), "mask"), "target").where("mask != 0").groupBy(F.col("source").alias("id")).agg(F.bit_or("mask").alias("more"))
        rows = state.join(got, "id", "left").withColumn("next", F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0))))
        rows = rows.select("id", "own", F.col("next").alias("mask"), F.when(F.col("next") != F.col("mask"), i).otherwise(F.col("hops")).alias("hops"))
        state = scratch.write(rows, f"m{i}")
        changed = state.where(F.col("hops") == i).isEmpty()
        scratch.drop(f"m{i - 1}")
        if changed:
            break
    return state.select("id", F.col("own").alias("mask"), F.col("mask").alias("transitive_mask"), "hops")


def confidence_after(hops, start: float = 1.0):
    """.95 a hop, .3 at least."""
    return F.round(F.greatest(F.lit(0.3), F.lit(start) * F.pow(F.lit(0.95), hops)), 6)


def pressure(calls: DataFrame, base: DataFrame, damping: float = 0.85, rounds: int = 20, epsilon: float = 0.001) -> DataFrame:
    """id, score = base + damping * mean of the callees' scores, until the largest change is below epsilon.

    The mean, not the sum, keeps it bounded on cycles.
    """
    scratch = Scratch(calls.sparkSession, "pressure")
    calls = scratch.write(calls.select("source", "target").distinct(), "calls")
    start = scratch.write(base.select("id", F.col("base").cast("double").alias("base")), "base")
    state = scratch.write(start.select("id", F.col("base").alias("score")), "p0")
    for i in range(1, rounds + 1):
        got = calls.join(state.select(F.col("id").alias("target"), "score"), "target").groupBy(F.col("source").alias("id")).agg(F.avg("score").alias("more"))
        after = scratch.write(start.join(got, "id", "left").select("id", (F.col("base") + damping * F.coalesce("more", F.lit(0.0))).alias("score")), f"p{i}")
        change = after.alias("a").join(state.alias("b"), "id").agg(F.max(F.abs(F.col("a.score") - F.col("b.score")))).first()[0] or 0.0
        scratch.drop(f"p{i - 1}")
        state = after
        if change < epsilon:
            break
    return state.withColumn("score", F.round("score", 6))


def cascade(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """Direct dependents (source) of changed targets that are not themselves changed."""
    return dependencies.join(changed.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct().join(changed, "id", "left_anti")
