import hashlib
import math
import zlib

from common import documents, odd_rows

from loomtext.llm import sharding as S


def choose(key, weights):
    bids = []
    for s, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        bids.append((-w / math.log(u), s))
    return max(bids)[1]


def test_against_plain_python(spark):
    rows = odd_rows() + [(i, f"text {i}") for i in range(100, 900)]
    weights = [1.0, 2.0, 0.5, 1.0]
    got = S.assign(documents(spark, rows), weights, [*weights, 1.0]).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == choose(key, weights) and r["grown_shard"] == choose(key, [*weights, 1.0])
        assert r["grown_shard"] in (r["shard"], len(weights))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    assert sizes[1] == (8, 0) and sizes[11] == (608, zlib.crc32(("é" * 300).encode()))
    n = [len(slots[s]) for s in range(4)]
    assert n[1] > n[0] > n[2]  # shares follow the weights


def test_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 3)
    got = S.assign(documents(spark, [(i % 150, f"t{i % 7}") for i in range(600)]), [1.0] * 5, [1.0] * 6).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 600 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_and_native(spark):
    out = S.assign(documents(spark, []), [1.0] * 3, [1.0] * 4)
    assert out.count() == 0
    plan = S.assign(documents(spark, odd_rows()), [1.0] * 3, [1.0] * 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
