import re

import numpy as np
import pytest
from common import multiset, words
from test_decontamination import brute as leaked
from test_near_dups import brute
from test_quality import base

import corpus_pipeline as P
from loomtext.llm import quality, secrets
from loomtext.llm.vocabularies import byte_level
from loomtext.runtime import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs = Scratch(spark, "pipeline-test"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(scratch.write(stage(spark, out[-1], SF), name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dups", "decontamination", "secrets", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_every_stage_against_brute_force(spark, stages):
    rows = [sorted((r.asDict() for r in s.collect()), key=lambda r: r["doc_id"]) for s in stages[:-1]]
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    params = quality.fit(read("documents"), read("labels"))
    judged = quality.judge_all([r["text"] for r in rows[0]], [r["lang"] for r in rows[0]], params)
    for r, j in zip(rows[0], judged, strict=True):
        limits = params.limits(r["lang"], j["script"], j["n_tokens"])
        assert j["base_failed"] == base(r["text"])[-1]
        assert j["kept"] == (not j["base_failed"] and all(lo <= j[m] <= hi for m, (lo, hi) in limits.items()))
    assert rows[1] == [r for r, j in zip(rows[0], judged, strict=True) if j["kept"]]
    comp = brute([(r["doc_id"], r["text"]) for r in rows[1]], 5)
    assert rows[2] == [r for r in rows[1] if comp[r["doc_id"]] == r["doc_id"]]
    items = [r["text"] for r in read("benchmark").collect()]
    assert rows[3] == [r for r in rows[2] if not any(leaked(r["text"], i) for i in items)]
    flat = lambda x: " ".join(words(x))
    assert not any(flat(i) in flat(r["text"]) for r in rows[3] for i in items)
    want = []
    for r in rows[3]:
        text, spans = r["text"], []
        for rule in secrets.RULES:
            spans += [(m.start(), m.end(), rule.kind) for m in re.finditer(rule.pattern, text) if rule.keep is None or rule.keep(m)]
        out, at = "", 0
        for start, end, kind in sorted(spans, key=lambda s: (s[0], [x.kind for x in secrets.RULES].index(s[2]))):
            if start >= at:
                out, at = out + text[at:start] + f"[{kind}]", end
            else:
                at = max(at, end)
        out += text[at:]
        want.append(r | {"text": out, "n_chars": len(out) if spans else r["n_chars"]})
    assert rows[4] == want


def test_packing_covers_what_is_left(spark, stages):
    texts = {r["doc_id"]: r["text"] for r in stages[-2].collect()}
    sizes = {}
    for r in stages[-1].collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    encoded = byte_level("byte_bpe_50k.json")
    assert sizes == {d: len(np.frombuffer(encoded.encode_all([t])[0], "<u4")) + 1 for d, t in texts.items()}


def test_run_gives_the_same_rows(spark, stages):
    """Which pieces a document is cut into depends on how rows are dealt to tasks; what they hold does not."""
    out = [r for r in P.run(spark, SF).collect()]
    assert out[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    whole = lambda rows: {(r["doc_id"], r["doc_tokens"]) for r in rows}
    assert whole(out) == whole(stages[-1].collect())
    sizes = {}
    for r in out:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert {(d, n) for d, n in sizes.items()} == whole(out)


def test_extra_columns_and_empty_tables(spark, stages):
    docs = stages[0].limit(30).selectExpr("*", "'x' as kept", "1 as component_id", "'y' as script", "2 as doc")
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        assert set(multiset(r[:2] for r in after.select("doc_id", "doc").collect())) <= set(multiset(r[:2] for r in docs.select("doc_id", "doc").collect()))
        docs = after
    docs = stages[0].limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
