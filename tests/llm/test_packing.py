import zlib

import numpy as np
import pytest
from common import documents, odd_rows

from loomtext.llm import balanced_packing as B
from loomtext.llm import token_matrix as M
from loomtext.llm.vocabularies import byte_level

ODD = ["", "  a", "a  b", "a \n b", " a", "\n\n x y  z", "x  y   b 's don't  ", "<|endoftext|> a b", "日本 語 \t\tq", "a  b  c\u001c d", "é" * 300, "x" * 5000 + " y", "a.\n b.\n\n  c", "don't  's 're\r\n ok"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_librarys(name, monkeypatch):
    import pandas as pd

    from loomtext.llm import vocabularies

    v = byte_level(name)
    texts = ODD + pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.to_list()
    for t, e in zip(texts, v.encode_all(texts), strict=True):
        assert np.frombuffer(e, "<u4").tolist() == v.plain(t)
    monkeypatch.setattr(vocabularies, "LONG_TEXT", 50)
    for t, e in zip(texts, v.encode_all(texts), strict=True):
        assert np.frombuffer(e, "<u4").tolist() == v.plain(t)


def test_every_code_point_is_cut_alike():
    """Ids of the file's own library against the quick one, over every 7th code point."""
    v = byte_level("byte_bpe_50k.json")
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}1{chr(c)}a {chr(c)}. {chr(c)}{chr(c)} b" for c in points[lo : lo + 500])
        assert np.frombuffer(v.encode(text), "<u4").tolist() == v.plain(text)


def test_tokenizers_gives_these_ids():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text, e in zip(ODD, byte_level("byte_bpe_50k.json").encode_all(ODD), strict=True):
        assert np.frombuffer(e, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def whole(text, end):
    return [*byte_level("byte_bpe_50k.json").plain(text or ""), end]


def test_pieces_cover_every_document_once(spark):
    rows = odd_rows() + [(100 + i, f"text number {i} " * (i % 40)) for i in range(300)]
    out = B.pack(documents(spark, rows).coalesce(1), B.Params(group=64)).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
    for doc, text in {r[0]: r[1] for r in rows if r[0] not in (4, None)}.items():
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist()
        assert ids == whole(text, 0) and {p["doc_tokens"] for p in pieces} == {len(ids)}
        assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
        assert sum(p["length"] for p in pieces) <= 1024
    assert sum(r["length"] for r in out) == sum(len(whole(r[1], 0)) for r in rows)
    assert len(by_seq) * 1024 - sum(r["length"] for r in out) < 1024 * (len(rows) // 64 + 1)
    assert B.pack(documents(spark, [])).count() == 0


def test_costs_are_balanced():
    sizes = np.random.default_rng(2).integers(1, 1024, 2000).tolist()
    placed = B.balance(sizes, B.Params())
    n = -(-sum(sizes) // 1024)
    cost, used = np.zeros(n), np.zeros(n)
    for _, _, k, s, offset in placed:
        assert offset == used[s]
        used[s] += k
        cost[s] += k + k * k / 1024
    assert (used[:-1] <= 1024).all() and used.sum() == sum(sizes)
    assert cost.std() / cost.mean() < 0.2


def plain_balance(sizes, params):
    """Longest first; every sequence is looked at for each rest."""
    n = -(-sum(sizes) // params.length)
    room, cost, out = [params.length] * n, [0.0] * n, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        start = 0
        while start < sizes[i]:
            left = sizes[i] - start
            fits = [s for s in range(n) if room[s] >= left]
            s = min(fits, key=lambda s: (cost[s], s)) if fits else max(range(n), key=lambda s: (room[s], -s))
            took = min(left, room[s])
            out.append((i, start, took, s, params.length - room[s]))
            room[s] -= took
            cost[s] += params.linear * took + params.quadratic * took * took
            start += took
    return out


def test_balance_matches_a_plain_search():
    rng = np.random.default_rng(5)
    for length in (7, 64, 100, 1024):
        for n in (1, 2, 30, 200):
            p = B.Params(length=length)
            sizes = rng.integers(1, length, n).tolist()
            assert B.balance(sizes, p) == plain_balance(sizes, p)
    p = B.Params(length=16)
    assert B.balance([16, 16, 3, 3, 3], p) == plain_balance([16, 16, 3, 3, 3], p)


def test_string_ids_and_small_groups(spark):
    docs = spark.createDataFrame([(f"d{i}", "some words here " * (i * 37 % 200)) for i in range(40)], "doc_id string, text string")
    for out in (B.pack(docs, B.Params(group=3)), M.build(docs, M.Params(group=3)).selectExpr("explode(doc_ids) as doc_id")):
        assert {r["doc_id"] for r in out.collect()} == {f"d{i}" for i in range(40)}


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(20):
        width = int(rng.integers(5, 60))
        sizes = rng.integers(1, width + 1, 80).tolist()
        rooms, rows = [], 0
        for size in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= size]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - size)
            else:
                rows += 1
                rooms.append(width - size)
        got = M.best_fit(sizes, width)
        assert len(got) == rows and sorted(i for r in got for i in r) == list(range(80))
        assert all(sum(sizes[i] for i in r) <= width for r in got)


def test_matrix_round_trip(spark, tmp_path):
    docs = documents(spark, odd_rows())
    M.write(M.build(docs), str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    ids, positions = M.matrix(rows)
    back = {}
    for i, r in enumerate(rows):
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"]
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"], strict=True)):
            back.setdefault(doc, []).append((start, ids[i, cu[k] : cu[k + 1]].tolist()))
            assert positions[i, cu[k] : cu[k + 1]].tolist() == list(range(cu[k + 1] - cu[k]))
        assert (ids[i, r["n_tokens"] :] == 50256).all()
    for doc, text, *_ in odd_rows():
        if doc not in (4, None):
            assert [x for _, part in sorted(back[doc]) for x in part] == whole(text, 50256)
    assert M.build(documents(spark, [])).count() == 0


def test_query_crc(spark):
    from loomtext.llm.queries import op10_cost_balanced

    r = op10_cost_balanced(spark, "/root/testdata/sf0.001").where("doc_id = 0 and start = 0").first()
    import pandas as pd

    text = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text[0]
    ids = np.array(whole(text, 0)[: r["length"]], "<u4")
    assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["doc_tokens"] == len(whole(text, 0))
