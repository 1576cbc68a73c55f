import random
from collections import defaultdict

import numpy as np

from ledgerlens.llm import lines as L
from ledgerlens.llm import words as W
from ledgerlens.llm.words import words_at


def words(line):
    return frozenset(w for w in line.replace("\t", " ").split(" ") if w)


def brute(docs):
    """Per row: (lines with words, removed places), every line against every earlier one."""
    places = [(d, k, words(line)) for d, t in docs if t is not None for k, line in enumerate(t.split("\n"))]
    places = sorted((p for p in places if p[2]), key=lambda p: (p[0], p[1]))
    out = defaultdict(lambda: [0, []])
    for i, (d, k, s) in enumerate(places):
        out[d][0] += 1
        if any(5 * len(s & t) >= 4 * len(s | t) for _, _, t in places[:i]):
            out[d][1].append(k)
    return {d: (n, gone) for d, (n, gone) in out.items()}


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 8
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 40))] for _ in range(25)]
    docs = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line) if rng.random() < 0.9 else "")
        docs.append((d, "\n".join(lines)))
    return [*docs, (80, None), (81, ""), (82, "\n \n"), (83, "tab\tseparated line of words"), (84, "words of line separated tab")]


def test_join_against_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_lines string").repartition(4)
    _, hit = L.removable_lines(frame)
    got = defaultdict(list)
    for r in hit.collect():
        got[r["k_id"]].append(r["line_no"])
    want = brute(docs)
    assert {d: sorted(v) for d, v in got.items()} == {d: gone for d, (_, gone) in want.items() if gone}
    texts = {r["doc_id"]: r["text"] for r in L.dedup_lines(frame).collect()}
    for d, t in docs:
        gone = want.get(d, (0, []))[1]
        assert texts[d] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))


def test_wide_verification_and_empty_table(spark, monkeypatch):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    near = {tuple(r)[:3] for r in L.removable_lines(frame)[1].collect()}
    monkeypatch.setattr(L, "BROADCAST_CLASSES", 0)
    assert {tuple(r)[:3] for r in L.removable_lines(frame)[1].collect()} == near
    assert L.dedup_lines(frame.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f g"), (2, "a b c d e f")], "doc_id long, text string")
    texts = sorted((r["doc_id"] or -1, r["text"]) for r in L.dedup_lines(frame).collect())
    assert texts == [(-1, "a b c d e f g"), (1, ""), (1, ""), (2, "")]


def test_line_facts_against_sets(spark):
    """Sizes, prefixes and parity maps of lines against sets built from the same hashes and counters."""
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(9)) for _ in range(rng.randrange(30))) for _ in range(20)) for _ in range(6)] + ["once\ttold \x0b\r  tale\n \n\x0c", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    codes = [int(x) for x in L.word_codes(docs).first()["codes"].split(",")]
    vocabulary = sorted({w for t in texts if t for w in t.split()})
    h = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    count = defaultdict(int)
    for t in texts:
        for w in (t or "").split():
            count[h[w] & ((1 << L.BITS) - 1)] += 1
    assert len(codes) == 1 << L.BITS and {k: v for k, v in enumerate(codes) if v} == {k: min(127, 1 + int(np.floor(4 * np.log2(n)))) for k, n in count.items()}
    rows = {(r["k_id"], r["line_no"]): r for r in L.line_table(docs).collect()}
    seen = 0
    for d, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            w = sorted((codes[h[x] & ((1 << L.BITS) - 1)] << L.CODE) | ((h[x] & (2**64 - 1)) >> (64 - L.CODE)) for x in set(line.split()))
            if not w:
                assert (d, k) not in rows
                continue
            seen += 1
            r, parity = rows[d, k], 0
            for x in w:
                parity ^= 1 << (x & 127)
            length = len(w) - -(-4 * len(w) // 5) + 1 if len(w) > 3 else 0
            assert (r["n"], r["m"] & (2**64 - 1) | (r["m2"] & (2**64 - 1)) << 64, r["prefix"]) == (len(w), parity, [x for x in w[:length] if x >> L.CODE > 1])
    assert seen == len(rows)


def test_links_of_all_classes(spark, monkeypatch):
    """Class, copies and number of links of every line, against all pairs of different sets; frequent words go through the grid too."""
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    lines = {(d, k): words(line) for d, t in docs if t is not None for k, line in enumerate(t.split("\n")) if words(line)}
    first, copies = {}, defaultdict(int)
    for place in sorted(lines):
        first.setdefault(lines[place], place)
        copies[lines[place]] += 1
    links = {s: sum(5 * len(s & t) >= 4 * len(s | t) for t in first) - 1 for s in first}
    assert sum(links.values()) > 2 * sum(n > 0 for n in links.values())
    want = {p: (first[s], copies[s], links[s]) for p, s in lines.items()}
    for often in (L.OFTEN, 2):
        monkeypatch.setattr(L, "OFTEN", often)
        rows = L.line_join(frame).collect()
        got = {(r["doc_id"], c["line_no"]): ((c["class"]["k_id"], c["class"]["line_no"]), c["copies"], c["n_links"]) for r in rows for c in r["classes"]}
        assert got == want and len(rows) == len(docs)
    gone = brute(docs)
    assert all((r["n_lines"], r["removed_lines"]) == gone.get(r["doc_id"], (0, [])) for r in rows)


def test_words_longer_than_a_chunk(monkeypatch):
    """A word of any length is one word, with the hash and place that one large chunk gives."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("aBc \n") if rng.random() < p else "x" for _ in range(60)) for p in (0, 0.02, 0.1, 0.5, 1) for _ in range(60)]
    datas = [np.frombuffer(t.encode(), np.uint8) for t in [*texts, "x" * 16 + " y", "x" * 8 + " ", "x" * 8, " " * 20, ""]]
    want = [[a.tolist() for a in words_at(d, fold)] for d in datas for fold in (True, False)]
    assert len(W.shingle_set(datas[0], 2)) == 1
    for chunk in (1, 2, 7, 8):
        monkeypatch.setattr(W, "CHUNK", chunk)
        assert [[a.tolist() for a in words_at(d, fold)] for d in datas for fold in (True, False)] == want
        assert len(W.shingle_set(datas[0], 2)) == 1


def test_links_of_a_large_group_are_not_listed(spark, monkeypatch):
    """Two large groups of near copies, some far from their centre: all links counted, the earliest match named, few pairs listed."""
    rng = random.Random(12)
    bases = [[f"{c}{i}" for i in range(n)] for c, n in (("p", 60), ("q", 40))]
    lines = []
    for i in range(400):
        line = list(bases[i % 2])
        for _ in range(rng.choice((1, 1, 1, 2, 2, 3, 5, 9))):
            line[rng.randrange(len(line))] = f"x{rng.randrange(400)}"
        lines.append(" ".join(line[: rng.choice((99, 99, 99, 55, 33))]))
    docs = [(i, line) for i, line in enumerate(lines)]
    sets = [words(line) for line in lines]
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    linked = lambda s, t: 5 * len(s & t) >= 4 * len(s | t)
    links = {s: sorted(first[t] for t in first if t != s and linked(s, t)) for s in first}
    total = sum(map(len, links.values())) // 2
    listed, verify = [], L._verified
    monkeypatch.setattr(L, "_verified", lambda pairs, *more: listed.append(pairs.count()) or verify(pairs, *more))
    for wide in (L.BROADCAST_CLASSES, 0):
        monkeypatch.setattr(L, "BROADCAST_CLASSES", wide)
        rows = {r["doc_id"]: r for r in L.line_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
        for i, s in enumerate(sets):
            (c,) = rows[i]["classes"]
            assert (c["class"]["k_id"], c["n_links"]) == (first[s], len(links[s]))
            earlier = [x for x in [first[s], *links[s]] if x < i and (x != first[s] or first[s] != i)]
            by = min([x for x in links[s] if x < first[s]], default=first[s] if first[s] != i else None)
            assert rows[i]["matched_docs"] == ([] if by is None else [by]) and bool(earlier) >= bool(rows[i]["n_removed"])
    assert total > 10_000 and max(listed) < total / 3
