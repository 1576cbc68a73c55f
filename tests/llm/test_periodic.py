"""Periodic runs against a search over all periods, and the edge cases of the operator."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import periodic


def brute(words, least):
    """All runs by comparing words at every distance; the smallest period of each stretch."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, 2 * p):
                best.setdefault((i, length), p)
            i = j + 1
    return sorted((s, length, p) for (s, length), p in best.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def cases():
    rng = random.Random(7)
    for _ in range(300):
        yield [rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randint(0, 120))]
    for _ in range(120):
        t = [rng.choice("abcdef") for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
            t += (unit * 9)[: rng.randint(1, len(unit) * 5)] + [rng.choice("abcdef") for _ in range(rng.randint(0, 5))]
        yield t
    for m in (5, 17, 40):
        yield list("ab" * m + "a" + "ab" * m + "a")
        yield list("ab" * m + "b" + "a" + "ab" * m)
    yield ["a"] * 500
    yield fibonacci(400)
    yield list("abababa" * 2)


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_brute_force(least):
    every = list(cases())
    for t in every:
        got = [tuple(map(int, r)) for r in periodic.find_runs(np.array([ord(c) for c in t], np.int64), np.zeros(len(t), np.int64), least)]
        assert got == brute(t, least), "".join(t)


def changed(doc, words):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def digests(doc, text):
    words = changed(doc, re.findall("[^\x20\x09-\x0d]+", text or ""))
    runs = brute(words, 12)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force_with_edge_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 90))) for _ in range(120)]
    texts += ["x y\tx\ny x y x y x\x0by x y x y x y", "word " * 700, "é " * 30 + "  " * 30, " \n", ""]
    rows = [(k, t, 1, "r") for k, t in enumerate(texts)] + [(500, None, 1, "r"), (3, texts[3], 1, "r"), (3, texts[3], 1, "r")]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs int, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op12_periodic_runs(spark, str(tmp_path)).collect()
    cols = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(((r["doc_id"], *(r[c] for c in cols)) for r in got), key=str) == sorted(((d, *digests(d, t)) for d, t, *_ in rows), key=str)


def test_small_batches_null_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b " * 20), (1, "c " * 30), (2, "d e f")], "doc_id long, text string")
    want = {(None, ((0, 40, 2),), "a b"), (1, ((0, 30, 1),), "c"), (2, (), "d e f")}
    for batch in (1, 50, 1 << 18):
        got = {(r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.periodic_runs(docs, batch_words=batch).collect()}
        assert got == want
    assert periodic.periodic_runs(docs.where("doc_id = 9")).count() == 0
