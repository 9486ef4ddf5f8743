import re
from collections import defaultdict
from functools import cache
from itertools import product

import pytest
from common import documents, odd_rows

from loomtext.llm import decontamination as D

ITEM = "If Alice has 12 apples and gives 5 kg of flour to Bob then how many apples does Alice keep after trading with Bob today?"
SWAP = "If Carol has 40 apples and gives 9 kg of flour to Dave then how many apples does Carol keep after trading with Dave today?"
BROKEN = "If Carol has 40 apples and gives 9 kg of flour to Dave then how many apples does Erin keep after trading with Frank today?"
FILL = " ".join(f"filler{i}" for i in range(60))


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def leaks(spark, docs, items, params=D.Params()):
    return {(r["doc_id"], r["item_id"]): r for r in D.hits(documents(spark, docs), bench(spark, items), params).collect()}


def test_copies_and_reparameterised_questions_are_caught(spark):
    docs = [(1, f"{FILL}. {ITEM} {FILL}"), (2, f"{FILL}. {SWAP} {FILL}"), (3, f"{FILL}. {BROKEN} {FILL}"), (4, FILL), (5, ITEM.lower()), (6, ITEM.upper()), (7, f"{FILL} {ITEM[:40]} {FILL}")]
    got = leaks(spark, docs, [(10, ITEM), (11, "Something else entirely is asked here about trees and rivers in the north")])
    assert set(got) == {(1, 10), (2, 10), (5, 10), (6, 10)}
    assert got[2, 10]["view"] == "typed" and got[2, 10]["slots"] >= 4 and got[2, 10]["share"] >= 0.8
    words = docs[0][1].split()
    assert words[got[1, 10]["start"] : got[1, 10]["end"]][:3] == ["If", "Alice", "has"]


def test_slots_must_be_consistent(spark):
    assert leaks(spark, [(3, BROKEN)], [(10, ITEM)]) == {}


def test_planted_passages_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " ".join(t.split())
    texts = {r["doc_id"]: flat(r["text"]) for r in docs.collect()}
    want = {(d, i["item_id"]) for i in items.collect() for d, t in texts.items() if flat(i["text"]) in t}
    got = {(r["doc_id"], r["item_id"]) for r in D.hits(docs, items).collect()}
    assert len(want) > 10 and want <= got
    assert len(got - want) <= 0.1 * len(want)


def test_shuffled_joins_and_many_like_items(spark):
    docs = [(1, ITEM), (2, SWAP), (4, FILL)]
    items = [(i, f"{ITEM} number {i} of many") for i in range(12)] + [(99, None), (98, ""), (97, "too short")]
    assert leaks(spark, docs, items, D.Params(broadcast_rows=0)) == leaks(spark, docs, items)
    assert {i for d, i in leaks(spark, docs, items)} == set(range(12))


def test_long_texts_are_read_whole(spark, monkeypatch):
    class Part:
        def __init__(self, text):
            self.text = text

    whole = f"{FILL}. {ITEM} {FILL}. -- -- . . {ITEM} ... {FILL} 7 kg. Ann"
    monkeypatch.setattr(D, "column", lambda part, name: [part.text])
    windows = lambda: {(tuple(c.at[p : p + 5].tolist()), int(h)) for c in D._read(Part(whole), 5) if len(c.at) >= 5 for v in range(2) for p, h in enumerate(D.hashed(c, v, D.Params()))}
    at_once = windows()
    for size in (20, 50, 200, 1000):
        monkeypatch.setattr(D, "BLOCK", size)
        assert at_once <= windows()


def test_short_items_are_found_whole(spark):
    docs = [(1, "So: What is 2+2? he asked"), (2, "what IS 2+2"), (3, "what is 2+3"), (4, "what is"), (5, "is 2+2 what"), (6, None)]
    got = leaks(spark, docs, [(10, "What is 2+2?"), (11, "he asked"), (12, "asked"), (13, "!?")])
    assert set(got) == {(1, 10), (2, 10), (1, 11)} and {r["view"] for r in got.values()} == {"whole"}


def test_ids_of_any_type_and_repeats(spark):
    docs = spark.createDataFrame([("a", ITEM), ("a", ITEM), ("a", FILL), (None, SWAP)], "doc_id string, text string")
    items = spark.createDataFrame([(1.5, ITEM), (1.5, ITEM)], "item_id double, text string")
    assert sorted((r["doc_id"] or "", r["item_id"]) for r in D.hits(docs, items).collect()) == [("", 1.5), ("a", 1.5)]
    assert [tuple(r) for r in D.keep_clean(docs, items).collect()] == [("a", FILL)]


@cache
def kept_words(text):
    """(place, core, number, unit, title, opens) of the words with a core, by plain expressions."""
    out, before = [], "."
    for i, w in enumerate(text.split()):
        core = re.sub(r"^[\W_]+|[\W_]+$", "", w)
        low = core.lower()
        if core:
            made = re.match(r"[+-]?\d[\d.,]*([a-z%]+)$", low)
            number = (core[0].isdigit() or w[0] in "+-$€£") and bool(re.match(r"[+-]?[$€£]?\d[\d.,:/]*%?$", low) or (made and made[1] in D.UNITS))
            digits = core[0].isdigit() or w[0] in "+-$€£"
            unit = not digits and low in D.UNITS and bool(out) and out[-1][2]
            title = not digits and not unit and core[0].isupper() and core[1:] == low[1:]
            out.append((i, low, number, unit, title, before.rstrip("\"')]»”’")[-1:] in tuple(".!?:;…")))
        before = w
    return out


@cache
def brute_windows(text, view, k=5):
    """[(place in words, {(tokens, slots)}, own tokens)]: every reading of each window."""
    words, out = kept_words(text), []
    for p in range(len(words) - k + 1):
        choices = []
        for _, low, number, unit, title, opens in words[p : p + k]:
            fixed = ("<number>", 1) if number else ("<unit>", 1) if unit else None
            if fixed or not title or view == "plain":
                choices.append([fixed or (low, 0)])
            else:
                choices.append([(low, 0), ("<name>", 1)] if opens else [("<name>", 1)])
        made = []
        for some in product(*choices):
            slots = sum(s << j for j, (_, s) in enumerate(some))
            literal = slots.bit_count() > k - 2
            made.append((("literal", *[w[1] for w in words[p : p + k]]) if literal else tuple(t for t, _ in some), slots))
        out.append((p, set(made), made[0][0]))
    return out


def brute(text, item):
    """Whether a document leaks an item of five words or more: every place where they begin to meet, both orders."""
    a, b, best = kept_words(text), kept_words(item), 0.0
    reach = 2 * (b[-1][0] - b[0][0] + 1)
    for view in ("typed", "plain"):
        items = brute_windows(item, view)
        need = len({own for _, _, own in items})
        where = defaultdict(list)
        for q, made, own in items:
            for tokens, slots in made:
                where[tokens].append((q, own, slots))
        hits = sorted({(p, q, own, slots) for p, made, _ in brute_windows(text, view) for tokens, _ in made for q, own, slots in where[tokens]})
        met = {(p, q) for p, q, *_ in hits}
        for p0, q0 in {(p, q) for p, q in met if (p - 1, q - 1) not in met}:
            some = [h for h in hits if a[p0][0] <= a[h[0]][0] < a[p0][0] + reach]
            for order in (some, sorted(some, key=lambda h: abs(a[h[0]][0] - h[1] - a[p0][0] + q0))):
                means, seen = {}, set()
                for p, q, own, slots in order:
                    pairs = {(b[q + j][1], a[p + j][1]) for j in range(5) if slots >> j & 1}
                    if len({x for x, _ in pairs}) == len(pairs) and all(means.get(x, y) == y for x, y in pairs):
                        means.update(pairs)
                        seen.add(own)
                best = max(best, len(seen) / need)
    return best >= 0.8


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    names, verbs = ["Ann", "Bob", "Cyd", "Dan", "Eve"], ["buys", "sells", "eats", "finds"]

    def question(n):
        out = []
        for _ in range(n):
            who = rng.choice(names)
            out.append(f"{who} {rng.choice(verbs)} {rng.randint(1, 30)} {rng.choice(['kg', 'apples', 'km', 'big pears'])} of it with {rng.choice(names)}.")
        return " ".join([*out, "How many are left in the end?"])

    def changed(text):
        kind = rng.randrange(5)
        swap = dict(zip(names, rng.sample(["Tom", "Kim", "Lea", "Max", "Zoe"], 5), strict=True))
        words = text.split()
        if kind == 0:
            return text
        if kind == 1:
            return " ".join(swap.get(w.strip("."), w.strip(".")) + "." * w.endswith(".") for w in words)
        if kind == 2:
            return " ".join(w if rng.random() < 0.9 else "other" for w in words)
        if kind == 3:
            return " ".join(rng.choice(names) if w in names and rng.random() < 0.4 else w for w in words)
        return re.sub(r"\d+", lambda _: str(rng.randint(1, 99)), text)

    items = [(i, question(rng.randint(1, 4))) for i in range(15)]
    docs = [(i, " ".join([question(1) if i % 3 else FILL, changed(rng.choice(items)[1]), FILL if i % 2 else question(2)])) for i in range(80)]
    want = {(d, i) for d, t in docs for i, x in items if brute(t, x)}
    assert 20 < len(want) < 400 and set(leaks(spark, docs, items)) == want
    assert set(leaks(spark, docs, items, D.Params(broadcast_rows=0))) == want


@pytest.mark.parametrize("rows", [[], odd_rows()])
def test_odd_rows(spark, rows):
    docs, items = documents(spark, rows), bench(spark, [(10, ITEM), (11, None)])
    assert D.hits(docs, items).count() == 0
    assert D.keep_clean(docs, items).count() == len(rows) and D.keep_clean(docs, items).columns == docs.columns
    assert D.keep_clean(docs, bench(spark, [])).count() == len(rows) and D.hits(docs, bench(spark, [])).count() == 0


def test_keep_clean_drops_leaks_only(spark):
    docs = documents(spark, [(1, ITEM), (2, SWAP), (3, FILL), (None, ITEM), (5, None)])
    assert sorted(r["doc_id"] for r in D.keep_clean(docs, bench(spark, [(10, ITEM)])).collect()) == [3, 5]


OPENING = "Natalia sold 48 clips to each of her friends in the spring. Natalia then sold 9 clips on the market. Weng bakes for 12 hours every week. Natalia helps with all of it."


def test_names_that_open_sentences_are_slots_too(spark):
    swap = OPENING.replace("Natalia", "Tom").replace("Weng", "Ada").replace("48", "31")
    broken = swap.replace("Tom then", "Zoe then").replace("Tom helps", "Kim helps")
    docs = [(1, f"{FILL}. {swap} {FILL}"), (2, f"{FILL} {swap} {FILL}"), (3, OPENING), (4, broken), (5, FILL), (6, OPENING.lower())]
    got = leaks(spark, docs, [(10, OPENING), (11, "Here is nothing of it. Nobody is sold anything in this text. It ends")])
    assert set(got) == {(1, 10), (2, 10), (3, 10), (6, 10)}
    assert got[1, 10]["share"] == got[2, 10]["share"] == 1.0


def test_every_reading_of_several_openings_is_tried(spark):
    item = "they all ran. Ann. Bob won the race today. Then it rained a lot"
    swaps = [item, item.replace("Ann", "Eve"), item.replace("Bob", "Max"), item.replace("Ann.", "Eve").replace("Bob", "Max"), item.replace("Ann", "ann").replace("Bob", "Max")]
    assert {k: r["share"] for k, r in leaks(spark, list(enumerate(swaps)), [(10, item)], D.Params(share=1.0)).items()} == {(i, 10): 1.0 for i in range(5)}


def test_a_stray_window_before_a_copy_hides_nothing(spark):
    plain = "one river bends past the old mill where nobody has ground any corn since the war ended and the miller left for good"
    n, docs = len(plain.split()), []
    for words in (plain.split()[:5], plain.split()[-5:]):
        for gap in range(0, 3 * n):
            docs.append((len(docs), " ".join([*words, *[f"f{i}" for i in range(gap)], *plain.split(), *[f"g{i}" for i in range(gap)], *words])))
    assert {k: r["share"] for k, r in leaks(spark, docs, [(10, plain)]).items()} == {(d, 10): 1.0 for d, _ in docs}


def test_a_stray_value_before_a_swapped_question_hides_nothing(spark):
    n = len(ITEM.split())
    docs = [(gap, " ".join(["If Olga has 77 apples and gives 3 kg of flour", *[f"f{i}" for i in range(gap)], SWAP, "If Ivan has 5 apples and gives"])) for gap in range(3 * n)]
    assert {k: r["share"] for k, r in leaks(spark, docs, [(10, ITEM)]).items()} == {(d, 10): 1.0 for d, _ in docs}
