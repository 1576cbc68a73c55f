"""Alignment against the two libraries on whole texts and plain loops over all token pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import align

HOSTILE = [
    "", None, " ", "\n", "a", " a", "a ", "  a  b ", "a \n b\n\n c", "a \n \n b", "x\t y", "▁ mark", "a▁b", "nul \x00 byte", "<|endoftext|> and </s> <unk> <s>",
    "café 中文字 \U0001f600\U0001f468‍\U0001f469", " no break   x", "\x1c \x1d\x85 y", "don't we'll I'M 12345678901 3.14159", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9,
    "=" * 300 + "-" * 77, "https://ex.ample/a_b?c=d&e=%20#f", "　wide　 space", "é combining", "word " * 400, "\r\nline\r\n", "   em", "0 0  0   0    0", "﻿bom", "�",
]


def whole(tools, text):
    """Ids and ends of either tokenizer over the whole text, by the libraries, or none."""
    if not text:
        return [], [], [], []
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(tools.a_bytes[i] for i in a) != raw or b"".join(tools.b_bytes[i] for i in b) != raw:
        return [], [], [], []
    ends = lambda ids, x: np.cumsum([len(x[i]) for i in ids]).tolist()
    return a, b, ends(a, tools.a_bytes), ends(b, tools.b_bytes)


def plain_groups(a, b, ea, eb):
    out, both, i, j = [], sorted(set(ea) & set(eb)), 0, 0
    for e in both:
        x, y = i, j
        while x < len(a) and ea[x] <= e:
            x += 1
        while y < len(b) and eb[y] <= e:
            y += 1
        out.append((a[i:x], b[j:y], e))
        i, j = x, y
    return out


def texts():
    rng = random.Random(11)
    words = ["the", "river", "quartzé", "12.5", "don't", "中文", "xyzzyqqq", "A-B_c", "\n", " ", "\t", "", "aaaaaaa", "über", "%20%3D", "\U0001f600"]
    return HOSTILE + [" ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", "9"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]


@pytest.fixture(scope="module")
def tools():
    return align.loaded(align.default_files())


def test_ids_of_pieces_are_those_of_whole_texts(tools):
    every = texts()
    t = tools.encode(every)
    for k, text in enumerate(every):
        a, b, *_ = whole(tools, text)
        assert t.a[t.a_at[k] : t.a_at[k + 1]].tolist() == a, text
        assert t.b[t.b_at[k] : t.b_at[k + 1]].tolist() == b, text


def test_lockstep_groups_and_links(tools, monkeypatch):
    every = texts()
    for lane in (1, 3, 256):
        monkeypatch.setattr(align, "LANE", lane)
        t = tools.encode(every)
        g = align.groups(t)
        width = len(tools.b_bytes)
        for at_once in (5, 1 << 22):
            monkeypatch.setattr(align, "AT_ONCE", at_once)
            doc, code, weight = align.links(t, g, width)
            for k, text in enumerate(every):
                want = Counter(x * width + y for a, b, _ in plain_groups(*whole(tools, text)) for x in a for y in b)
                assert dict(zip(code[doc == k].tolist(), weight[doc == k].tolist(), strict=True)) == want


def test_groups_with_several_tokens_on_both_sides():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 40)
        cutting = lambda: sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, 12)))})
        docs = [(cutting(), cutting()) for _ in range(rng.randint(1, 6))]
        a_end = np.array([e + n * k for k, (x, _) in enumerate(docs) for e in x])
        b_end = np.array([e + n * k for k, (_, y) in enumerate(docs) for e in y])
        a, b = (np.array([rng.randint(0, 3) for _ in x]) for x in (a_end, b_end))
        at = lambda side: np.concatenate([[0], np.cumsum([len(d[side]) for d in docs])])
        t = align.Tokens(a, b, a_end, b_end, at(0), at(1))
        g = align.groups(t)
        doc, code, weight = align.links(t, g, 10)
        for k, (x, y) in enumerate(docs):
            ia, ib = a[t.a_at[k] : t.a_at[k + 1]].tolist(), b[t.b_at[k] : t.b_at[k + 1]].tolist()
            want = Counter(p * 10 + q for u, v, _ in plain_groups(ia, ib, x, y) for p in u for q in v)
            assert dict(zip(code[doc == k].tolist(), weight[doc == k].tolist(), strict=True)) == want


def brute(tools, rows):
    per, counts, top = [], Counter(), {}
    for _, text in rows:
        g = plain_groups(*whole(tools, text))
        pairs = Counter((x, y) for a, b, _ in g for x in a for y in b)
        counts.update(pairs.keys())
        per.append((g, pairs))
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    for (doc, _), (g, pairs) in zip(rows, per, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in g)
        yield (
            doc, sum(len(a) for a, *_ in g), sum(len(b) for _, b, _ in g), len(g), sum(pairs.values()), sum(w for p, w in pairs.items() if counts[p] == top[p[0]]),
            sum(w * counts[p] for p, w in pairs.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        )


def test_query_equals_brute_force_with_edge_rows(spark, tmp_path, tools):
    every = texts()
    rows = list(enumerate(every)) + [(None, "the river"), (7, every[7]), (40, every[40]), (40, every[40])]
    spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block int, codes string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(brute(tools, rows), key=str)
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in cols) for r in align.op11_lockstep_alignment(spark, str(tmp_path)).collect()), key=str) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    small = align.alignment_scores(docs, block_links=1).collect()
    assert sorted((tuple(r[c] for c in cols) for r in small), key=str) == want
    shown = {r["doc_id"]: [(x["a"], x["b"], x["end"]) for x in r["groups"]] for r in align.aligned(docs).collect() if r["doc_id"] not in (None, 7, 40)}
    assert all(shown[d] == plain_groups(*whole(tools, t)) for d, t in enumerate(every) if d not in (7, 40))
    assert align.alignment_scores(docs.where("doc_id = -1")).count() == 0
