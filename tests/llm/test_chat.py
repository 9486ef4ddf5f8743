import hashlib

from loomtext.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, target string, example string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "t", "e") for r in rows], SCHEMA)


HARD = ["", "\\", "###", "####", "</turn>", "<</turn>/turn>", r"\h\e\b\c", "a\n### user: x</turn>\n", r"\### Assistant: </turn> ok", "é\u0085\r\n:", "\\\\###", None]


def test_hostile_texts_round_trip(spark):
    rows = [(i, t, role, x) for i, x in enumerate(HARD) for t, role in ((0, "user"), (1, "assistant"), (2, "a:b\\###</turn>"))]
    back = {r["conv_id"]: r for r in C.read_back(C.examples(rows_of(spark, rows))).collect()}
    for i, x in enumerate(HARD):
        assert [tuple(t) for t in back[i]["turns"]] == [("user", x or ""), ("assistant", x or ""), ("a:b\\###</turn>", x or "")]
        assert list(back[i]["trained"]) == [x or ""]


def test_every_assistant_turn_is_an_example_with_its_context(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"), (1, 4, "assistant", "a2"), (1, 5, "user", "u3")]
    got = C.examples(rows_of(spark, rows)).orderBy("example").collect()
    assert [r["n_turns"] for r in got] == [3, 5, 6]
    for r, reply in zip(got, ("a1", "a2", None), strict=True):
        text = r["context"] + r["target"]
        assert r["context"] == "".join(f"### {role}: {x}</turn>\n" for _, _, role, x in rows[: r["n_turns"] - 1])
        if reply is None:
            assert r["loss_start"] is None and r["loss_end"] is None
        else:
            assert text[r["loss_start"] : r["loss_end"]] == reply


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "x" * 200_000), (2, 1, "assistant", "y" * 200_000)]
    back = {r["conv_id"]: r for r in C.read_back(C.examples(rows_of(spark, rows))).collect()}
    assert [t["text"] for t in back[1]["turns"]] == ["a", "a", "b"] and back[1]["trained"] == []
    assert [tuple(t) for t in back[None]["turns"]] == [("", "")]
    assert back[2]["trained"] == ["y" * 200_000]
    assert C.examples(rows_of(spark, [])).count() == 0


def test_query_against_plain_python(spark):
    from loomtext.llm.queries import HOSTILE, op4_prefix_targets

    sf = "/root/testdata/sf0.001"
    turns = {-7: [("user", HOSTILE), ("assistant", HOSTILE)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in op4_prefix_targets(spark, sf).collect()}
    assert set(got) == set(turns)
    for conv, each in turns.items():
        loss = "".join(t for role, t in each if role == "assistant")
        assert got[conv]["n_turns"] == len(each)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in each).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_native_plan(spark):
    plan = C.read_back(C.examples(rows_of(spark, [(1, 0, "user", "x")])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
