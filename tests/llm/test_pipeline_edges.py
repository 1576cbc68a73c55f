import random

import corpus_pipeline as cp

ITEM = "what is the boiling point of water at sea level in kelvin"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pa", "re", "so", "ti", "vu") for b in ("dan", "fel", "gor", "hin", "jun", "kal", "mer")]


def text(rng, n):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(12)) + "." for _ in range(n))


def test_edge_cases_stage_by_stage(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, copies under another id, and extra columns with the names that stages use."""
    rng = random.Random(1)
    a, b, c = (text(rng, 8) for _ in range(3))
    near = b.replace(b.split()[5], "changed", 1)
    rows = [(1, a), (1, a), (2, b), (3, near), (None, c), (4, None), (5, ""), (6, " \n "), (7, f"{text(rng, 8)}\n{ITEM}\n{text(rng, 4)}"), (8, "too short"), (9, a), (10, text(rng, 3000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k_id string, kept int, line_no string, _row string"
    spark.createDataFrame([(i, t, None, None, None, "x", 3, "y", "z") for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES:
        docs = cp.common.cut(stage(spark, docs, str(tmp_path)))
        left[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == cp.COLUMNS
    ids = {name: sorted(str(r["doc_id"]) for r in out) for name, out in left.items()}
    # Rejected: no text, or too few words. The copy 9 loses all its lines to 1, and its row goes; equal rows share their fate until one stays.
    assert ids["quality rules"] == ["1", "1", "10", "2", "3", "7", "9", "None"]
    # Of 3 only the line that no earlier line equals, or is similar to, may stay.
    assert set(ids["line dedup"]) - {"3"} == {"1", "10", "2", "7", "None"} and ids["line dedup"].count("1") == 2
    assert set(ids["near dedup"]) - {"3"} == {"1", "10", "2", "7", "None"} and ids["near dedup"].count("1") == 1
    assert set(ids["decontamination"]) - {"3"} == {"1", "10", "2", "None"}
    assert ids["encoding"] == ids["decontamination"] and all(r["round_trip"] for r in left["encoding"])
    final = {r["doc_id"]: r for r in left["decontamination"]}
    assert (final[1]["text"], final[2]["text"], final[None]["text"]) == (a, b, c) and final[None]["lang"] is None
    assert all(r["n_chars"] == len(r["text"]) for r in final.values())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
