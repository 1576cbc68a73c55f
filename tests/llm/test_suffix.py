import random
from collections import Counter

import pytest

from ledgerlens.llm import suffix as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def cases(rng, length):
    prose = lambda n: "".join(rng.choice(["ab", "é", "c d", "xyz\n", "qq"]) for _ in range(n))
    base, shared = prose(4 * length), prose(length)
    near = [base[: (k * length) // 2] + prose(3) + base[(k * length) // 2 :] for k in range(6)]
    return [base, base, *near, prose(30) + shared + prose(40), shared, shared[1:] + "!", None, "", "a" * (3 * length), "ab" * (2 * length), prose(5 * length)]


def test_run_index_gives_matching_statistics():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(20)] + [b"aaaa" * 9, b"aaaa" * 8]
    index = S.RunIndex(strings)
    suffixes = [(i, s[k:]) for i, s in enumerate(strings) for k in range(len(s))]

    def match(i, k):
        own, best = strings[i][k:], 0
        for j, other in suffixes:
            if (j, len(other)) != (i, len(own)):
                n = 0
                while n < min(len(own), len(other)) and own[n] == other[n]:
                    n += 1
                best = max(best, n)
        return best

    for step, lanes, got in index.statistics():
        for lane, value in zip(lanes, got, strict=True):
            assert value == match(lane, len(strings[lane]) - step)


@pytest.mark.parametrize("many", [2048, 1])
def test_against_brute_force(spark, many):
    rng = random.Random(7)
    texts = cases(rng, 100)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(0, texts[0], 2), (None, texts[9], 3)], "doc_id long, text string, kept long").repartition(3)
    rows = S.remove_repeats(docs, length=100, many=many).collect()
    order = [*range(len(texts)), 0, None]
    want = Counter((d, *b) for d, b in zip(order, brute([*texts, texts[0], texts[9]], 100), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == want


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 333)
    texts = cases(random.Random(3), 100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in S.remove_repeats(docs, length=100).collect()}
    assert got == {k: (b[1], b[3]) for k, b in enumerate(brute(texts, 100))}
    assert S.remove_repeats(docs.limit(0)).count() == 0
