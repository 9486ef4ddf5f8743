"""Token alignment against plain Python over the libraries' own tokens, and its defined cases."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from common import documents, odd_rows
from places import SF

from loomtext.llm import alignment, queries, vocabularies
from loomtext.runtime import table


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_names():
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


NAMES = byte_names()


def spans(tokens):
    at = 0
    for i, raw in tokens:
        yield i, at, at + len(raw)
        at += len(raw)


def plain(text, libraries):
    """(n_a, n_b, n_groups, links, digest) of a text."""
    a_lib, b_lib = libraries
    none = (0, 0, 0, [], "")
    if not text:
        return none
    want = (" " + text).encode()
    a = [(i, bytes(NAMES[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in b_lib.encode(text):
        piece = b_lib.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return none
    a, b = list(spans(a)), list(spans(b))
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, at = [], [0, 0]
    for end in cuts:
        sides = []
        for k, side in enumerate((a, b)):
            first = at[k]
            while at[k] < len(side) and side[at[k]][2] <= end:
                at[k] += 1
            sides.append(",".join(str(i) for i, *_ in side[first : at[k]]))
        groups.append("|".join(sides))
    links, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        m = j
        while m < len(b) and b[m][1] < e:
            links.append((i, b[m][0]))
            m += 1
    return len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def expected(rows, libraries):
    each = [(d, plain(t, libraries)) for d, t in rows]
    count = Counter(x for _, (*_, links, _) in each for x in links)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return Counter((d, n_a, n_b, g, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), sha) for d, (n_a, n_b, g, links, sha) in each)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_table_against_libraries(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = queries.op11_token_alignment(spark, SF)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == expected(rows, libraries)


def test_odd_texts_chunks_and_salt(spark, libraries):
    rng = random.Random(3)
    odd = ["a  b", " lead", "tail \n", "\n\nx\ny", "a▁b", "<|endoftext|> <s> <0x41> <unk>", "é ① 　x", "\x00", "\U0001f600\U0001f600", "x" * 300, "\t\r\n", " "]
    made = ["".join(rng.choice("ab \n.,é中\U0001f600") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(odd + made)] + [(r[0], r[1]) for r in odd_rows()]
    docs = documents(spark, rows).repartition(3)
    got = alignment.align(docs, alignment.Params(chunk=300, hot=2, salts=3, words=20))
    assert Counter(map(tuple, got.collect())) == expected(rows, libraries)


def test_long_text_in_parts(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "LONG_TEXT", 500)
    monkeypatch.setattr(vocabularies, "LONG_TEXT", 500)
    text = " ".join(f"w{i} \n q" for i in range(400))
    one = alignment.align_texts([text, None, text])
    n_a, n_b, groups, links, sha = plain(text, libraries)
    assert one.digests == [sha, "", sha] and one.n_a.tolist() == [n_a, 0, n_a] and one.n_b.tolist() == [n_b, 0, n_b] and one.n_groups.tolist() == [groups, 0, groups]
    assert len(one.pairs) == 2 * len(links)


def test_empty_table_and_links(spark):
    none = alignment.align(documents(spark, []))
    assert none.columns == COLUMNS and none.count() == 0
    counts = alignment.links(alignment.pair_counts(alignment.chunks(documents(spark, [(1, "one one two")]))))
    rows = counts.collect()
    assert sum(r["count"] for r in rows) == 3 and all(r["best"] for r in rows)
