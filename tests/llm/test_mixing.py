"""The mix against plain arithmetic, its SQL, hot and empty sources, and edge rows."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import pytest

from ledgerlens.llm import mixing


def targets(sizes, weights, share=Fraction(3, 2), most=2):
    """Water-filling with exact fractions, clamping one round at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    got, left = {}, share * sum(sizes.values())
    while True:
        live = [s for s in names if s not in got]
        total = sum(w[s] for s in live)
        over = [s for s in live if left * w[s] > most * sizes[s] * total]
        if not over:
            return got | {s: left * w[s] / total for s in live}
        for s in over:
            got[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(got.values())


def table(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string").repartition(5).write.parquet(f"{path}/documents.parquet")


def rows_of(rng, counts):
    rows, k = [], 0
    for source, n in counts.items():
        for _ in range(n):
            k += 1
            rows.append((k, " ".join(["w"] * rng.randint(0, 60)), source, 1, "x"))
    return rows


@pytest.mark.parametrize("counts", [{"b": 900, "a": 40, "": 40, "é": 7, None: 5, "z": 1}, {"one": 30}, {"a": 3, "b": 3, "c": 500}])
def test_targets_and_taken_words(spark, tmp_path, counts):
    rng = random.Random(5)
    rows = rows_of(rng, counts) + [(5000, None, "b", 1, "x"), (5001, "", None, 1, "x"), (None, "a\tb\x0bc d", "b", 1, "x"), (7, "same row", "b", 1, "x"), (7, "same row", "b", 1, "x"), (5002, "w " * 9000, "c", 1, "x")]
    table(spark, tmp_path, rows)
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes, mixing.WEIGHTS)
    got = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((d, words(t)) for d, t, *_ in rows if d is not None)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12, abs=1e-9)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    # The driver's form: the same rows from the SQL, and again from Spark.
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()
    query = lambda: sorted(map(tuple, mixing.op13_water_filling(spark, str(tmp_path)).collect()), key=str)
    assert query() == sorted(sql, key=str) == query()


def test_seed_order_and_epochs(spark):
    docs = spark.createDataFrame([(k, "v w x y z", "a" if k % 2 else "b") for k in range(40)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(3, 1), share=1.0, max_epochs=4, seed=1)
    rows = got.collect()
    assert {r["source"]: r["target"] for r in rows} == {"a": 150.0, "b": 50.0}
    order = sorted((r for r in rows if r["source"] == "a"), key=lambda r: hashlib.md5(f"1:{r['doc_id']}".encode()).hexdigest())
    assert [r["taken"] for r in order] == [10] * 10 + [5] * 10
    assert [r["taken"] for r in mixing.mix(docs, (3, 1), 1.0, 4, seed=2).orderBy("doc_id").collect()] != [r["taken"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    texts = mixing.mixed_texts(docs, got).collect()
    assert sum(len(r["text"].split()) for r in texts) == 200 and max(r["epoch"] for r in texts) == 1


def test_empty_table_and_tables_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mix(docs).collect()} == {(0.0, 0)}
    assert mixing.mix(docs.where("doc_id = 9")).count() == 0
