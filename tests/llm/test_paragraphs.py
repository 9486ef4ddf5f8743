"""Paragraph sketches against plain Python sets, sizes that need larger sketches, and the defined cases."""

import base64
import hashlib
import random
import re

import pytest
from common import documents, odd_rows
from oracle import same
from places import SF
from pyspark.sql import functions as F

from loomtext.llm import paragraphs, queries


def plain(text):
    """The set of paragraph digests."""
    parts = re.findall(paragraphs.PATTERN, text or "")
    return {int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in parts}


def cells(keys):
    made = [[0, 0, 0] for _ in range(48)]
    for d in keys:
        for part in range(3):
            cell = made[(d >> (4 * part) & 15) + 16 * part]
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] ^ d, cell[2] ^ d % paragraphs.CHECK
    return base64.b64encode(bytes.fromhex("".join(f"{n:08x}{k:016x}{c:08x}" for n, k, c in made))).decode()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """For documents in order: (doc_id, n_chars, edited digest, fingerprint, edited fingerprint, near_edited, near_next)."""
    out = []
    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), cells(a), cells(b), pytest.approx(like(a, b)), pytest.approx(like(a, c))))
    return out


def test_table_against_sql(spark):
    same(spark, SF, queries.QUERIES["op12_paragraph_sketch"], queries.ORACLE_SQL["op12_paragraph_sketch"])


def test_main_path_is_native(spark):
    plan = queries.op12_paragraph_sketch(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_edits_against_sets(spark):
    rng = random.Random(5)
    made = []
    for i in range(40):
        lines = [" ".join(rng.choice(["aa", "b.", "céé", "Dd!", "\U0001f600"]) for _ in range(rng.randint(0, 120))) for _ in range(rng.choice([0, 1, 3, 9, 90]))]
        made.append((i * 3 - 20, "\n".join(lines)))
    docs = documents(spark, made).repartition(5)
    got = sorted(tuple(r)[:7] for r in paragraphs.compare_edits(docs).collect())
    assert got == expected(made)


@pytest.mark.parametrize("n", [0, 1, 10, 40, 200, 4000])
def test_differences_of_any_size(spark, n):
    rng = random.Random(n)
    common, a, b = ([f"{side} {i} {rng.random()}" for i in range(k)] for side, k in (("c", 300), ("a", n), ("b", n // 3)))
    one, two = ["\n".join(common + a)], ["\n".join(b + common[::-1])]
    row = paragraphs.changes(documents(spark, [(1, one[0])]), documents(spark, [(1, two[0])])).collect()[0]
    assert set(row["removed"]) == plain("\n".join(a)) and set(row["added"]) == plain("\n".join(b))
    assert len(row["removed"]) == n and len(row["added"]) == n // 3
    assert row["likeness"] == pytest.approx(300 / (300 + n + n // 3))


def test_what_the_largest_cannot_peel(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "LOAD", 10_000)
    monkeypatch.setattr(paragraphs, "LARGER", (1,))
    docs = [documents(spark, [(1, "\n".join(f"{side}{i}" for i in range(300)))]) for side in "ab"]
    row = paragraphs.changes(*docs).collect()[0]
    assert len(row["removed"]) == len(row["added"]) == 300 and row["likeness"] == 0


def test_a_sketch_that_is_too_small_does_not_peel(spark):
    keys = F.array(*[F.lit(hash((i, "x")) & ((1 << 60) - 1)) for i in range(100)])
    state = spark.range(1).select(paragraphs.peel(paragraphs.sketch(keys)).alias("s")).select("s.done", "s.cells").collect()[0]
    assert state["done"] and any(c["n"] for c in state["cells"])


def test_defined_cases(spark):
    rows = odd_rows()
    got = paragraphs.compare_edits(documents(spark, [(r[0], r[1]) for r in rows])).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    of = lambda d: [r for r in got if r["doc_id"] == d]
    assert of(1)[0]["n_chars"] == 0 and of(1)[0]["near_edited"] == 1.0 and of(1)[0]["near_next"] == 1.0
    assert of(2)[0]["near_next"] == 0.0  # the next is white space, a paragraph
    assert len(of(4)) == 2 and tuple(of(4)[0]) == tuple(of(4)[1])
    assert of(4)[0]["fingerprint"] == of(5)[0]["fingerprint"] and of(4)[0]["near_next"] == 1.0
    assert paragraphs.compare_edits(documents(spark, [])).count() == 0
    alone = paragraphs.compare_edits(documents(spark, [(1, "ab")])).collect()[0]
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()
    named = documents(spark, [(1, "x\ny"), (2, "y")]).selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {r["doc_id"]: r["near_next"] for r in paragraphs.compare_edits(named).collect()} == {"d1": 0.5, "d2": 0.5}


def test_fingerprints(spark):
    rows = paragraphs.fingerprints(documents(spark, [(1, "a\nb"), (2, "a\nb"), (3, None)])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == cells(plain("a\nb")) and by[3]["n_paragraphs"] == 0
