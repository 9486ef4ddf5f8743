"""Streams with keyed state: rebuilds that wait for a quiet moment, and links that follow edits.

`rebuilds` holds a burst of events for each scope (a module, a project) and gives one row when the scope has been
quiet for a while, or when the burst has lasted the longest wait. Timers are event-time timeouts of the state, so a
burst that is open when a stream stops goes on after a restart from its checkpoint.

The linker is two streams. `name_changes` keeps the names that each file defines and uses, and turns a new version of
a file (or its removal) into additions and removals of names. `link_changes` keeps, for each name, who defines and who
uses it, and says which references point elsewhere now: a new, removed or better definition moves every reference of
its name, in files that were not edited too. A reference points to a definition in its own directory if there is one,
else in the whole corpus; of several to the smallest path. References of a name are dealt over `salts` states, which
all hear of its definitions, so a name that a third of all files use isn't one state.

Versions are numbers that rise with time; an older version than the one known changes nothing, so an event that is
delivered twice or late does no harm. `links_of` is the same in one batch job; `latest` folds changes into a table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.runtime import ship_package

#: Milliseconds of quiet, and of the longest wait.
QUIET_MS, LONGEST_MS = 300, 5_000
REBUILD = "scope string, first timestamp, last timestamp, n_events long, n_paths long"
EDIT = "path string, version long, defines array<string>, uses array<string>"
NAME = "name string, path string, role string, present boolean, version long"
LINK = "name string, path string, target string, version long"


def _bursts(rows: list[tuple[int, str]], open_: dict | None, quiet: int, longest: int) -> tuple[list[dict], dict | None]:
    """(bursts that ended, the open one) after events (ms, path) in order of time."""
    ended = []
    for at, path in rows:
        if open_ and (at - open_["last"] >= quiet or at - open_["first"] >= longest):
            ended.append(open_)
            open_ = None
        if open_ is None:
            open_ = {"first": at, "last": at, "n": 0, "paths": set()}
        open_["last"], open_["n"] = max(open_["last"], at), open_["n"] + 1
        open_["paths"].add(path)
    return ended, open_


def _rows(scope: str, bursts: list[dict]) -> pd.DataFrame:
    at = lambda key: pd.to_datetime([b[key] for b in bursts], unit="ms")
    return pd.DataFrame({"scope": [scope] * len(bursts), "first": at("first"), "last": at("last"), "n_events": [b["n"] for b in bursts], "n_paths": [len(b["paths"]) for b in bursts]})


def rebuilds(events: DataFrame, watermark: str = "1 second", quiet: int = QUIET_MS, longest: int = LONGEST_MS) -> DataFrame:
    """scope, first, last, n_events, n_paths: one row for each burst of a scope (columns scope, path, ts).

    A burst ends after `quiet` ms without an event, and `longest` ms after its first. Its paths are state until then.
    """
    ship_package(events.sparkSession)

    def step(key: tuple, parts, state: GroupState):
        held = state.getOption
        open_ = None if held is None else {"first": held[0], "last": held[1], "n": held[2], "paths": set(held[3])}
        if state.hasTimedOut:
            state.remove()
            yield _rows(key[0], [open_])
            return
        rows = sorted((int(t.value // 1_000_000), p) for part in parts for t, p in zip(part["ts"], part["path"], strict=True))
        ended, open_ = _bursts(rows, open_, quiet, longest)
        due = min(open_["last"] + quiet, open_["first"] + longest)
        if due <= state.getCurrentWatermarkMs():
            ended.append(open_)
            if state.exists:
                state.remove()
        else:
            state.update((open_["first"], open_["last"], open_["n"], sorted(open_["paths"])))
            state.setTimeoutTimestamp(due)
        if ended:
            yield _rows(key[0], ended)

    rows = events.select("scope", "path", "ts").where("scope IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", watermark)
    return rows.groupBy("scope").applyInPandasWithState(step, REBUILD, "first long, last long, n long, paths array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def rebuilds_of(events: DataFrame, quiet: int = QUIET_MS) -> DataFrame:
    """The same bursts in one batch job, without a longest wait."""
    order = Window.partitionBy("scope").orderBy("ts")
    gap = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(order))
    rows = events.withColumn("_new", (F.coalesce(gap, F.lit(quiet)) >= quiet).cast("int")).withColumn("_burst", F.sum("_new").over(order))
    return rows.groupBy("scope", "_burst").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n_events"), F.count_distinct("path").alias("n_paths")).drop("_burst")


def name_changes(edits: DataFrame) -> DataFrame:
    """name, path, role, present, version: what each edit adds and removes; null lists are a removed file."""
    ship_package(edits.sparkSession)

    def step(key: tuple, parts, state: GroupState):
        version, defines, uses = state.getOption or (None, [], [])
        names = {"def": set(defines), "use": set(uses)}
        rows = [(int(v), d, u) for part in parts for v, d, u in zip(part["version"], part["defines"], part["uses"], strict=True)]
        out = []
        for at, d, u in sorted(rows, key=lambda r: r[0]):
            if version is not None and at <= version:
                continue
            version = at
            for role, new in (("def", set(() if d is None else d)), ("use", set(() if u is None else u))):
                out += [(n, key[0], role, n in new, at) for n in sorted(names[role] ^ new)]
                names[role] = new
        if version is not None:
            state.update((version, sorted(names["def"]), sorted(names["use"])))
        if out:
            yield pd.DataFrame(out, columns=["name", "path", "role", "present", "version"])

    rows = edits.select("path", "version", "defines", "uses").where("path IS NOT NULL AND version IS NOT NULL")
    return rows.groupBy("path").applyInPandasWithState(step, NAME, "version long, defines array<string>, uses array<string>", "append", GroupStateTimeout.NoTimeout)


def _directory(path: str) -> str:
    return path.rpartition("/")[0]


def _target(path: str, defined: list[str], nearby: dict[str, str]) -> str | None:
    return nearby.get(_directory(path)) or (defined[0] if defined else None)


def link_changes(names: DataFrame, salts: int = 8) -> DataFrame:
    """name, path, target, version: references whose target changed (null: none, or the reference is gone)."""
    ship_package(names.sparkSession)

    def step(key: tuple, parts, state: GroupState):
        held = state.getOption or ([], [])
        known = {role: {p: (v, there) for p, v, there in (map(tuple, rows))} for role, rows in zip(("def", "use"), held, strict=True)}

        def targets() -> dict[str, str | None]:
            defined = sorted(p for p, (_, there) in known["def"].items() if there)
            nearby: dict[str, str] = {}
            for p in defined:
                nearby.setdefault(_directory(p), p)
            return {p: _target(p, defined, nearby) for p, (_, there) in known["use"].items() if there}

        before, newest = targets(), 0
        for part in parts:
            for path, role, present, version in zip(part["path"], part["role"], part["present"], part["version"], strict=True):
                if version > known[role].get(path, (-1,))[0]:
                    known[role][path] = (int(version), bool(present))  # a removal stays, so that an older addition does no harm
                    newest = max(newest, int(version))
        after = targets()
        changed = sorted(p for p in before.keys() | after.keys() if before.get(p) != after.get(p))
        state.update(tuple([(p, v, there) for p, (v, there) in sorted(known[role].items())] for role in ("def", "use")))
        if changed:
            yield pd.DataFrame([(key[0], p, after.get(p), newest) for p in changed], columns=["name", "path", "target", "version"])

    own = F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int")
    dealt = names.withColumn("salt", F.explode(F.when(F.col("role") == "def", F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(own))))
    entry = "array<struct<path:string,version:bigint,there:boolean>>"
    return dealt.groupBy("name", "salt").applyInPandasWithState(step, LINK, f"defs {entry}, uses {entry}", "append", GroupStateTimeout.NoTimeout)


def latest(changes: DataFrame) -> DataFrame:
    """name, path, target of the links as they stand after these changes."""
    last = changes.groupBy("name", "path").agg(F.max_by("target", "version").alias("target"))
    return last.where("target IS NOT NULL")


def links_of(edits: DataFrame) -> DataFrame:
    """The links after all edits in one batch job: each name's definitions meet its uses through their smallest
    path, of each directory and of all."""
    last = edits.groupBy("path").agg(F.max_by(F.struct("defines", "uses"), "version").alias("e")).select("path", "e.*")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    defs = last.select("path", F.explode(F.array_distinct("defines")).alias("name"))
    nearby = defs.groupBy("name", folder.alias("dir")).agg(F.min("path").alias("near"))
    anywhere = nearby.groupBy("name").agg(F.min("near").alias("far"))
    uses = last.select("path", F.explode(F.array_distinct("uses")).alias("name")).withColumn("dir", folder)
    rows = uses.join(anywhere, "name").join(nearby, ["name", "dir"], "left")
    return rows.select("name", "path", F.coalesce("near", "far").alias("target"))


def run_linker(edits: DataFrame, place: str) -> DataFrame:
    """Both streams up to all edits at hand, under a shared folder; gives all link changes so far. Called again
    with the same folder it goes on where it stopped."""
    spark = edits.sparkSession

    def through(rows: DataFrame, name: str) -> None:
        rows.writeStream.format("parquet").option("path", f"{place}/{name}").option("checkpointLocation", f"{place}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()

    through(name_changes(edits), "names")
    through(link_changes(spark.readStream.schema(NAME).parquet(f"{place}/names")), "links")
    return spark.read.schema(LINK).parquet(f"{place}/links")
