import random
import re

import numpy as np
import pytest

from ledgerlens.llm import decontaminate as D


def edits_anywhere(item: str, text: str) -> int:
    """Least edit distance of the item to any stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def changed(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(1, len(s) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("xyz")
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, rng.choice("xyz"))
    return "".join(s)


def test_scan_finds_every_occurrence_within_the_budget():
    rng = random.Random(5)
    words = ["the", "of", "ion", "and", "ering", "tho", "heat", "ou", "é", "st"]
    prose = lambda n: " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [(i, prose(rng.randint(12, 40))) for i in range(12)]
    index = D.ItemIndex(items, D.Q, D.EDIT_SHARE)
    texts, planted = [], []
    for i in range(60):
        item = rng.randrange(len(items))
        body = changed(rng, items[item][1], rng.randint(0, 5))
        texts.append(D.fold(prose(30) + " " + body + " " + prose(20)) if i % 3 else D.fold(prose(60)))
        planted.append(item)
    found = dict(D.scan_many(index, texts))
    for row, text in enumerate(texts):
        hit = {i: (s, e, d) for i, s, e, d in found.get(row, [])}
        for i in range(len(items)):
            least = edits_anywhere(index.texts[i], text)
            assert (least <= index.k[i]) == (i in hit), (row, i, least)
            if i in hit:
                s, e, d = hit[i]
                assert d == least and edits_anywhere(index.texts[i], text[s:e]) == d


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 500)
    rng = random.Random(1)
    item = "a benchmark passage that is long enough to be searched for"
    index = D.ItemIndex([(7, item)], D.Q, D.EDIT_SHARE)
    for at in (0, 480, 500, 990, 1700):
        filler = "".join(rng.choice("qwrtp ") for _ in range(1800))
        text = filler[:at] + item + filler[at:]
        assert (0, at, at + len(item), 0) in D.scan_many(index, [text])[0][1]


def test_gram_hashes_agree_only_for_equal_grams():
    x = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.uint32)
    for q in (3, 5, 6):
        h = D.gram_hashes(x, q)
        grams = [tuple(x[i : i + q]) for i in range(len(x) - q + 1)]
        assert [[a == b for b in h] for a in h] == [[a == b for b in grams] for a in grams]


@pytest.mark.parametrize("block", [10, 1_000_000])
def test_query_on_edge_cases(spark, block):
    item = "What is the boiling point of water at sea level?"
    docs = spark.createDataFrame(
        [(1, "Q: " + item.upper() + " yes", "x"), (2, None, "x"), (3, "", "x"), (1, "Q: " + item.upper() + " yes", "x"), (None, item, "x"), (4, "plain", None)],
        "doc_id long, text string, item_id string",
    )
    bench = spark.createDataFrame([(1, item, "e"), (1, item, "e"), (2, None, "e"), (3, "short", "e"), (4, "", "e"), (5, "another item that does not occur anywhere", "e")], "item_id long, text string, edits string")
    found = D.find_leaks(docs, bench, block_chars=block)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 1, 3, 3 + len(item), 0)] * 2 + [(None, 1, 0, len(item), 0)], key=str)
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert D.find_leaks(docs.limit(0), bench).count() == 0 and D.find_leaks(docs, bench.limit(0)).count() == 0


def test_rows_with_null_or_repeated_ids_go_by_their_texts(spark):
    item = "a benchmark passage that is long enough to be searched for"
    docs = spark.createDataFrame([(None, f"here {item} there"), (None, "clean one"), (None, None), (1, item), (1, "clean two"), (2, item), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {tuple(r) for r in D.decontaminate(docs, bench).collect()}
    assert kept == {(None, "clean one"), (None, None), (1, "clean two"), (3, "")}
    assert D.find_leaks(docs, bench).columns == ["doc_id", "item_id", "start", "end", "edits"] and D.find_leaks(docs, bench).count() == 3


@pytest.mark.parametrize("piece", [20, D.PIECE])
def test_short_items_are_whole_words(monkeypatch, piece):
    """Every item below q characters, and only where no letter or digit touches it, with and without longer items beside them."""
    monkeypatch.setattr(D, "PIECE", piece)
    rng = random.Random(8)
    shorts = ["x", "42", "a b", "a a", "C++", "é", "(y)", "seven77", "42", " x ", "", "  "]
    alphabet = ["x", "42", "a", "b", "c++", "é", "(y)", "seven77", " ", " ", " ", "_", "\n", "."]
    texts = [D.fold("".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for _ in range(300)] + ["", "x", "xx", "x-x"]
    for more in ([], ["a longer item that is searched by grams"]):
        index = D.ItemIndex(list(enumerate(shorts + more)), D.Q, D.EDIT_SHARE)
        found = {row: h for row, h in D.scan_many(index, texts)}
        for row, text in enumerate(texts):
            want = set()
            for i, item in enumerate(shorts):
                if wanted := D.fold(item).strip():
                    before, end = r"(?<![^\W_])", r"(?![^\W_])"
                    want |= {(i, m.start(), m.end(), 0) for m in re.finditer(before + re.escape(wanted) + end, text)}
            assert {(index.ids[i], s, e, d) for i, s, e, d in found.get(row, [])} == want, text


def test_best_hits_against_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        hits = {(rng.randrange(2), s, s + rng.randint(1, 6)): rng.randrange(3) for s in (rng.randrange(30) for _ in range(rng.randrange(25)))}
        want = []
        for (item, start, end), edits in sorted(hits.items(), key=lambda x: (x[0][0], x[1], x[0][1], x[0][2])):
            if not any(o[0] == item and start < o[2] and o[1] < end for o in want):
                want.append((item, start, end, edits))
        assert D.best_hits(hits) == want


def test_short_items_in_the_query(spark):
    docs = spark.createDataFrame([(1, "the answer is 42."), (2, "142 or 420"), (3, None), (4, "so: 42")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "42"), (8, None)], "item_id long, text string")
    assert sorted(map(tuple, D.find_leaks(docs, bench).collect())) == [(1, 9, 14, 16, 0), (4, 9, 4, 6, 0)]
    assert sorted(r["doc_id"] for r in D.decontaminate(docs, bench).collect()) == [2, 3]
