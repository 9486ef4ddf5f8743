import random

import pytest
from common import documents, odd_rows, words

from loomtext.llm import repeats as R


def brute(rows, length):
    """Word positions of each document in a window of `length` words that another doc_id holds."""
    seen = {}
    for doc, text in rows:
        if doc is None:
            continue
        w = words(text)
        for i in range(len(w) - length + 1):
            seen.setdefault(tuple(w[i : i + length]), set()).add(doc)
    out = {}
    for doc, text in rows:
        if doc is None:
            continue
        w = words(text)
        for i in range(len(w) - length + 1):
            if len(seen[tuple(w[i : i + length])]) > 1:
                out.setdefault(doc, set()).update(range(i, i + length))
    return out


def got(spark, rows, params):
    out = {}
    for r in R.spans(documents(spark, rows), params).collect():
        assert r["n_words"] == r["end"] - r["start"] >= params.length
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    passages = [[f"p{i}x{rnd.randrange(10**6)}" for _ in range(rnd.choice([30, 49, 50, 51, 60, 75, 140]))] for i in range(14)]
    rows = []
    for doc in range(60):
        text = []
        for _ in range(rnd.choice([0, 1, 2, 3])):
            text += [f"d{rnd.randrange(10**7)}" for _ in range(rnd.randrange(40))]
            p = list(rnd.choice(passages))
            if rnd.random() < 0.4:  # another partner reaches further left or right
                p = p[rnd.randrange(12) :]
            if rnd.random() < 0.4:
                p = p[: len(p) - rnd.randrange(12)]
            text += p
        text += [f"d{rnd.randrange(10**7)}" for _ in range(rnd.randrange(60))]
        rows.append((doc, " ".join(text)))
    rows += [(100, rows[0][1]), (101, rows[0][1])]
    assert got(spark, rows, R.Params()) == brute(rows, 50)


def test_odd_rows(spark):
    rows = [r for r in odd_rows()]
    assert got(spark, rows, R.Params()) == brute([(r[0], r[1]) for r in rows], 50)


def test_hot_heads_and_small_blocks(spark):
    """One passage in many documents, each cut elsewhere; joins salted, positions shuffled, one-head blocks."""
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join([*[f"d{rnd.randrange(10**7)}" for _ in range(rnd.randrange(9))], *passage[rnd.randrange(30) : rnd.randrange(60, 91)], f"e{i}"])) for i in range(80)]
    assert got(spark, rows, R.Params(hot=5, broadcast_bytes=0, block=7)) == brute(rows, 50)


def test_empty(spark):
    assert got(spark, [], R.Params()) == {}


def test_one_text_in_most_documents(spark):
    """Whole copies, short texts and empty ones have hot keys."""
    text = " ".join(f"t{i}" for i in range(70))
    rows = [(i, text) for i in range(30)] + [(i, "") for i in range(30, 50)] + [(i, "a few words") for i in range(50, 70)] + [(70, "x " + text), (71, None), (None, text)]
    rows += [(72, text), (72, "short")]
    assert got(spark, rows, R.Params(hot=3)) == brute(rows, 50)
