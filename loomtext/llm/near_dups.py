"""3. MinHash near-dedup: b-bit MinHash.

Each text's set of k-word shingle hashes gives `bands * rows` minima. Bands of whole minima give
candidate pairs; of each minimum only the low `bits` bits are kept, packed as bit planes, so that a
candidate's similarity is estimated by XOR, OR and a bit count, corrected for the collisions that b
bits make by chance. Candidates whose estimate is not clearly too low are confirmed on the full sets.

Shape of the job. Texts with equal sets are one class from the start (a pre-aggregated group-by).
Classes that share a band key are linked in rounds: each key's members are held against one member
(the pivot, one that meets many), confirmed links merge components, and only keys that still span several components stay;
after `pivot_rounds` what is left is compared block by block across components, and only survivors
come out, so no pair that could join two components goes untested and large groups of near copies
never become all pairs. Components come from large-star/small-star rounds over confirmed links. Every
loop writes its tables to the shared checkpoint folder; nothing per document reaches the driver.

Defined cases: null text, or text without words, has an empty set and is linked with nothing. Fewer
words than k give the whole sequence as the one shingle. Rows with the same doc_id are one document,
linked to what any of its texts with words is; a null doc_id is linked with nothing and has a null component
(and is kept). Repeated rows come out as often as they went in. An empty table gives an empty result.
doc_id is an integer of any width. Other columns are ignored by `classes` and kept by `keep_first`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import words as W
from loomtext.llm.frames import column, slices
from loomtext.llm.joins import join_hot
from loomtext.llm.memory import claim
from loomtext.runtime import Scratch, ship_package


@dataclass(frozen=True)
class Params:
    """Two sets are linked if 100 * intersection >= percent * union. With 32 bands of 5 rows a pair at
    0.8 shares no band with probability 3e-6; `slack` is five deviations of the estimate."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    bits: int = 4
    slack: float = 0.17
    pivot_rounds: int = 2
    sketch: int = 512  # lowest set hashes that a block holds of each member
    block: int = 64
    broadcast_ids: int = 2_000_000  # at most this many 8-byte ids are broadcast; more are joined by shuffle
    hot: int = 50_000  # rows of one key that one task joins; more are salted


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    h = W.text_hashes((text or "").encode("utf-8", "replace").lower())  # bytes.lower() changes A-Z only
    if not len(h):
        return h
    return np.unique(W.fast_windows(h, min(k, len(h))))


def _multipliers(n: int) -> np.ndarray:
    return W.mix(np.arange(1, n + 1, dtype=np.uint64) * W.MULTIPLIERS[0]) | np.uint64(1)


def minima(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """For each of the odd multipliers, the smallest product with a shingle's hash, in 32 bits."""
    s, a = (s >> np.uint64(32)).astype(np.uint32), a.astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    buffer = np.empty((min(len(s), 1024), len(a)), np.uint32)
    for at in range(0, len(s), 1024):
        part = s[at : at + 1024]
        got = np.multiply(part[:, None], a[None, :], out=buffer[: len(part)])
        np.minimum(low, got.min(axis=0), out=low)
    return low.astype(np.uint64)


def pack(low: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of the mixed minima's low bits: word w of plane j has bit j of minima 64w.. ; slots beyond
    the last are zero."""
    padded = np.zeros(-(-len(low) // 64) * 64, np.uint64)
    padded[: len(low)] = W.mix(low * W.MULTIPLIERS[3])
    planes = [np.packbits((padded >> np.uint64(j)).astype(np.uint8) & 1, bitorder="little").view("<u8") for j in range(bits)]
    return np.concatenate(planes).view(np.int64)


def sign(docs: DataFrame, params: Params) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, band keys and packed signature."""
    n = params.bands * params.rows
    schema = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, planes array<long>"

    def run(batches):
        claim("shingles")
        a, seeds = _multipliers(n), _multipliers(n + params.bands)[n:]
        for part in slices(batches):
            out = {x: [] for x in ("n", "fp1", "fp2", "bands", "planes")}
            for text in column(part, "text"):
                s = shingles(text, params.shingle)
                out["n"].append(len(s))
                if not len(s):
                    for x in ("fp1", "fp2", "bands", "planes"):
                        out[x].append(None)
                    continue
                low = minima(s, a)
                keys = W.mix(W.mix(low.reshape(params.bands, params.rows) * a[: params.rows]).sum(axis=1, dtype=np.uint64) + seeds)
                out["bands"].append(keys.view(np.int64))
                out["planes"].append(pack(low, params.bits))
                out["fp1"].append(int(W.mix(s * W.MULTIPLIERS[1]).sum(dtype=np.uint64).view(np.int64)))
                out["fp2"].append(int(W.mix(s * W.MULTIPLIERS[2]).sum(dtype=np.uint64).view(np.int64)))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["fp1"], pa.int64()), pa.array(out["fp2"], pa.int64()), pa.array(out["bands"], lists), pa.array(out["planes"], lists)], names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "planes"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, params: Params) -> DataFrame:
    def run(batches):
        for part in slices(batches):
            sets = [shingles(t, params.shingle).view(np.int64) for t in column(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, set array<long>")


def estimate(a, b, params: Params):
    """Collision-corrected similarity of two packed signatures, as a column."""
    slots = params.bands * params.rows
    words = -(-slots // 64)
    differ = []
    for w in range(words):
        planes = [F.element_at(a, j * words + w + 1).bitwiseXOR(F.element_at(b, j * words + w + 1)) for j in range(params.bits)]
        differ.append(F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), planes)))
    matched = (F.lit(float(slots)) - reduce(lambda x, y: x + y, differ)) / F.lit(float(slots))
    chance = 2.0**-params.bits
    return (matched - F.lit(chance)) / F.lit(1 - chance)


def components(scratch: Scratch, edges: DataFrame, name: str, hot: int = 50_000) -> DataFrame:
    """(id, comp) for every node of the edges (a, b): comp is the component's smallest id."""
    pairs = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")
    step, seen = 0, None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = join_hot(both.where("v > u"), least, "u", hot, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.write(large, f"{name}-large-{step}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, low, "u", hot, "v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        after = scratch.write(small, f"{name}-{step + 1}")
        scratch.drop(f"{name}-{step}", f"{name}-large-{step}")
        pairs, step = after, step + 1
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _semi(rows: DataFrame, ids: DataFrame, on: str, n: int, limit: int, how: str) -> DataFrame:
    """Join that broadcasts the ids only if there are few."""
    return rows.join(F.broadcast(ids) if n <= limit else ids, on, how)


def _across(members: DataFrame, sigs: DataFrame, sets: DataFrame, params: Params, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a key and may be linked.

    A key's members are dealt into blocks of about `block`: a component with that many members there fills blocks
    of its own, the rest share some, whole components at a time. Blocks are paired unless both are of one
    component, so a large group only meets what is not in it yet, and a task compares two blocks with numpy:
    sizes, bit estimate, the pair's first shared band being this key, and the lowest hashes of both sets (exact
    for sets that fit). Only survivors come out.
    """
    per = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    few = per.where(F.col("n") < params.block).groupBy("key").agg(F.ceil(F.sum("n") / params.block).alias("shared"))
    per = scratch.write(per.join(few, "key", "left"), "per-component")
    of = members.select("key", "id", "comp").join(per, ["key", "comp"])
    large = F.col("n") >= params.block
    number = F.pmod(F.when(large, F.xxhash64("id", F.lit("block"))).otherwise(F.xxhash64("comp", F.lit("block"))), F.when(large, F.ceil(F.col("n") / params.block)).otherwise(F.col("shared")))
    label = F.concat(F.when(large, F.col("comp").cast("string")).otherwise("shared"), F.lit(":"), number.cast("string"))
    placed = scratch.write(of.select("key", "id", "comp", label.alias("block"), F.when(large, F.col("comp")).alias("own")), "placed")
    low = sets.select("id", F.slice("set", 1, params.sketch).alias("low"))
    rows = placed.join(sigs, "id").join(low, "id")
    blocks = rows.groupBy("key", "block").agg(F.collect_list(F.struct("id", "comp", "n_shingles", "planes", "bands", "low")).alias("m"))
    blocks = scratch.write(blocks, "blocks")
    names = placed.select("key", "block", "own").distinct()
    each = names.select("key", F.col("block").alias("bx"), F.col("own").alias("ox")).join(names.select("key", F.col("block").alias("by"), F.col("own").alias("oy")), "key").where("bx <= by and (ox is null or oy is null or ox != oy)")
    x, y = blocks.select("key", F.col("block").alias("bx"), F.col("m").alias("x")), blocks.select("key", F.col("block").alias("by"), F.col("m").alias("y"))
    return each.select("key", "bx", "by").join(x, ["key", "bx"]).join(y, ["key", "by"]).select("key", "bx", "by", "x", "y").mapInArrow(_comparer(params), "a long, b long").distinct()


def _comparer(params: Params):
    slots, words = params.bands * params.rows, -(-params.bands * params.rows // 64)
    least, chance = params.percent / 100, 2.0**-params.bits

    def unpack(block) -> dict:
        m = block.values
        out = {k: m.field(k).to_numpy(zero_copy_only=False) for k in ("id", "comp", "n_shingles")}
        for k in ("planes", "bands"):
            out[k] = m.field(k).flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
        return out | {"low": m.field("low")}

    def run(batches):
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for i in range(batch.num_rows):
                key, bx, by = (batch.column(k)[i].as_py() for k in range(3))
                x, y = unpack(batch.column(3)[i]), unpack(batch.column(4)[i])
                ok = x["comp"][:, None] != y["comp"][None, :]
                if bx == by:
                    ok &= np.triu(np.ones(ok.shape, np.bool_), 1)
                nx, ny = x["n_shingles"][:, None], y["n_shingles"][None, :]
                ok &= (nx * 100 >= ny * params.percent) & (ny * 100 >= nx * params.percent)
                differ = np.zeros(ok.shape, np.int64)
                for w in range(words):
                    planes = np.zeros(ok.shape, np.int64)
                    for j in range(params.bits):
                        planes |= x["planes"][:, None, j * words + w] ^ y["planes"][None, :, j * words + w]
                    differ += np.bitwise_count(planes.view(np.uint64))
                ok &= ((slots - differ) / slots - chance) / (1 - chance) >= least - params.slack
                p, q = np.nonzero(ok)
                if not len(p):
                    continue
                same = x["bands"][p] == y["bands"][q]
                here = x["bands"][p, same.argmax(axis=1)] == key
                lows: dict[tuple[int, int], np.ndarray] = {}
                for a, b in zip(p[here].tolist(), q[here].tolist(), strict=True):
                    u = lows.setdefault((0, a), x["low"][a].values.to_numpy().view(np.uint64))
                    v = lows.setdefault((1, b), y["low"][b].values.to_numpy().view(np.uint64))
                    if max(x["n_shingles"][a], y["n_shingles"][b]) > params.sketch:
                        # up to the smaller sketch's end both sets are known
                        end = min(u[-1] if x["n_shingles"][a] > params.sketch else v[-1], v[-1] if y["n_shingles"][b] > params.sketch else u[-1])
                        u, v = u[u <= end], v[v <= end]
                        need = least - params.slack
                    else:
                        need = least
                    at = np.searchsorted(v, u)
                    both = int((v[np.minimum(at, len(v) - 1)] == u).sum()) if len(v) else 0
                    if both >= need * (len(u) + len(v) - both) - 1e-9:
                        one, two = int(x["id"][a]), int(y["id"][b])
                        found.add((min(one, two), max(one, two)))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def link(docs: DataFrame, params: Params, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(signed rows: doc_id, n_shingles, fp1, fp2; classes: fp1, fp2, rep, comp)."""
    ship_package(docs.sparkSession)
    signed = scratch.write(sign(docs, params), "signed")
    some = signed.where("doc_id is not null and n_shingles > 0")
    one = F.min_by(F.struct("n_shingles", "bands", "planes"), "doc_id")
    made = scratch.write(some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), one.alias("s")), "classes")
    classes, reps = made.select("fp1", "fp2", "rep"), made.select(F.col("rep").alias("id"), "s.*")
    keyed = scratch.write(reps.select("id", F.explode("bands").alias("key")), "keyed")
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    met = scratch.write(join_hot(keyed, shared, "key", params.hot, "id"), "met")
    scratch.drop("keyed")
    # how many members a class meets over all its keys: the middle of a group of near copies meets most
    ids = scratch.write(met.groupBy("id").agg(F.sum("n").alias("central")), "ids")
    members = scratch.write(met.select("key", "id").join(ids, "id"), "members")
    scratch.drop("met")
    ids = ids.select("id")
    n_ids = ids.count()
    sigs = scratch.write(_semi(reps, ids, "id", n_ids, params.broadcast_ids, "left_semi").select("id", "n_shingles", "planes", "bands"), "sigs")
    sets = scratch.write(full_sets(_semi(docs.select("doc_id", "text"), ids.withColumnRenamed("id", "doc_id"), "doc_id", n_ids, params.broadcast_ids, "left_semi"), params), "sets")

    def near(x: str, y: str):
        size = (F.col(f"{x}.n_shingles") * 100 >= F.col(f"{y}.n_shingles") * params.percent) & (F.col(f"{y}.n_shingles") * 100 >= F.col(f"{x}.n_shingles") * params.percent)
        return size & (estimate(F.col(f"{x}.planes"), F.col(f"{y}.planes"), params) >= params.percent / 100 - params.slack)

    def confirm(pairs: DataFrame, step: int) -> DataFrame:
        """Links among pairs (a, b): a is the side that many pairs share."""
        a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        good = join_hot(pairs.join(b, "b"), a, "a", params.hot, "b", pairs).where(both * 100 >= (F.size("sa") + F.size("sb") - both) * params.percent)
        return scratch.write(good.select("a", "b").distinct(), f"links-{step}")

    def estimated(pairs: DataFrame) -> DataFrame:
        side = lambda k: sigs.select(F.col("id").alias(k), F.struct("n_shingles", "planes").alias("x" if k == "a" else "y"))
        return join_hot(pairs.join(side("b"), "b"), side("a"), "a", params.hot, "b", pairs).where(near("x", "y")).select("a", "b").distinct()

    # a doc_id whose rows have different sets stands for all of them
    torn = some.groupBy("doc_id").agg(F.min("fp1").alias("lo"), F.max("fp1").alias("hi")).where("lo < hi").select("doc_id")
    links = scratch.write(some.join(torn, "doc_id", "left_semi").select("doc_id", "fp1", "fp2").join(classes, ["fp1", "fp2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b"), "torn")
    tested = labels = None
    if links.isEmpty():
        links = None
    else:
        labels = scratch.write(components(scratch, links, "comp-torn", params.hot), "labels-torn")
    for step in range(params.pivot_rounds + 1):
        now = members.withColumn("comp", F.col("id")) if labels is None else members.join(labels, "id", "left").select("key", "id", "central", F.coalesce("comp", "id").alias("comp"))
        last = step == params.pivot_rounds
        other = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(1000)) / 5000 if step else F.lit(0.0)  # each round another central one
        pivot = F.max_by(F.struct("id", "comp"), F.struct(F.col("central") * (1 - other), "id"))
        open_keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot.alias("p")).where("lo < hi").select("key", "p")
        open_keys = scratch.write(open_keys, f"open-{step}")
        if open_keys.isEmpty():
            break
        if last:
            pairs = _across(scratch.write(join_hot(now, open_keys.select("key"), "key", params.hot, "id"), "still-open"), sigs, sets, params, scratch)
        else:
            pairs = join_hot(now, open_keys, "key", params.hot, "id").where(F.col("comp") != F.col("p.comp")).select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct()
            pairs = estimated(scratch.write(pairs, f"candidates-{step}"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, f"pairs-{step}")
        scratch.drop(f"candidates-{step}", f"open-{step}")
        tested = pairs if tested is None else tested.union(pairs)
        found = confirm(pairs, step)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            merged = components(scratch, links, f"comp-{step}", params.hot)
            labels = scratch.write(merged, f"labels-{step}")
            links = labels.select(F.col("id").alias("a"), F.col("comp").alias("b"))
    final = classes.withColumn("comp", F.col("rep")) if labels is None else classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("fp1", "fp2", "rep", F.coalesce("comp", "rep").alias("comp"))
    of = scratch.write(final, "of")
    scratch.keep("signed", "of")
    return signed, of


def classes(docs: DataFrame, params: Params = Params(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    scratch = scratch or Scratch(docs.sparkSession, "near")
    signed, of = link(docs, params, scratch)
    worded = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    # all copies of a text have one key, so it may be hot; rows without words have none
    linked = join_hot(signed.where(worded).select("doc_id", "n_shingles", "fp1", "fp2"), of.select("fp1", F.col("fp2").alias("other"), "comp"), "fp1", params.hot, "doc_id").where("fp2 = other")
    bare = signed.where(~F.coalesce(worded, F.lit(False))).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = linked.select("doc_id", "n_shingles", F.col("comp").alias("component_id")).union(bare)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of each component's smallest doc_id, with all their columns; of rows that share a doc_id one, the
    smallest by text, then by the other columns that have an order. Rows without doc_id stay."""
    scratch = Scratch(docs.sparkSession, "near-keep")
    judged = scratch.write(classes(docs, params, scratch), "judged")
    scratch.keep("judged")
    gone = scratch.write(judged.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    many = scratch.write(judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "many")
    rest = _semi(docs, gone, "doc_id", gone.count(), params.broadcast_ids, "left_anti")
    if many.isEmpty():
        return rest
    n = many.count()
    column_of = {f.name: F.col(f"`{f.name}`") for f in docs.schema}
    ordered = [column_of[f.name] for f in docs.schema if f.name != "text" and not re.search("map<|variant", f.dataType.simpleString())]
    smallest = F.min_by(F.struct(*column_of.values()), F.struct("text", *ordered))
    once = _semi(rest, many, "doc_id", n, params.broadcast_ids, "left_semi").groupBy("doc_id").agg(smallest.alias("_row")).select("_row.*")
    return _semi(rest, many, "doc_id", n, params.broadcast_ids, "left_anti").unionByName(once)
