"""Small cases for the operators without a file of their own: brute force, round trips, nulls, ties, repeats, clashes."""

import hashlib
import random
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import licenses, near, pieces, quality, secret_scan, sharding, warc

WORDS = ["the", "of", "river", "stone", "quiet", "lamp", "green", "under", "walks", "night", "é", "ça"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def edge_docs(spark, texts):
    """Texts with null, empty, very long and repeated ones, and columns named like outputs."""
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n\t"), (903, "word " * 30_000), (904, texts[0]), (904, texts[0]), (None, texts[0])]
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, kept int, shard string").repartition(3)


# Quality rules.
def test_quality_measures(spark):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (3, 60, 200)] + ["a b c a b c\n\nx\nx\n#$ |", "a a a a a", "one two", "u v w\x0bu v w"]
    book = {r["doc_id"]: r for r in quality.ledger(edge_docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {p for i, g in enumerate(tri) if tri.count(g) > 1 for p in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(book[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    assert book[900]["n_words"] == book[901]["n_words"] == 0 and book[903]["n_repeat_words"] == 30_000


def test_quality_policies_and_ablation(spark):
    book = quality.ledger(edge_docs(spark, ["a b c " * 40, "fine " + prose(random.Random(2), 100)]))
    judged = quality.apply_policy(book, 1)
    assert {r["doc_id"]: r["kept"] for r in judged.collect()}[1] is True
    bits = [r["fail_bits"] & quality.mask(2) for r in book.collect()]
    for r in quality.ablation(book, 2).collect():
        bit = 1 << [n for n, _ in quality.rules()].index(r["rule"])
        assert (r["n_failed"], r["n_only_this"], r["n_kept_without"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


# Sharding.
def test_sharding_law_and_slots(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot")).unionByName(spark.createDataFrame([(None, "y"), (5, "x"), (5, "x")], "doc_id long, slot string"))
    out = sharding.assign(docs, "doc_id", sharding.tree(24), sharding.tree(25)).collect()
    assert len(out) == 20_003 and {r["shard"] for r in out} == set(range(24))
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    moved = sum(r["grown_shard"] == 24 for r in out)
    assert 600 < moved < 1000 and all(650 < len(v) < 1020 for v in slots.values())
    assert len({r["shard"] for r in out if r["doc_id"] == 5}) == 1
    assert sharding.assign(docs.limit(0), "doc_id", sharding.tree()).count() == 0


def test_draws_recomputed_in_python(spark):
    """Every descent again with plain Python: exponential draws from seeded hashes, level by level."""
    import math

    import xxhash

    def draw(key, node, weight):
        bits = xxhash.xxh64(node.encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest() >> 12
        return -math.log((bits + 0.5) / (1 << 52)) / weight

    def descend(key, leaves, path, depth):
        if depth == 3:
            return leaves[0].shard
        groups = {}
        for leaf in leaves:
            groups.setdefault(((leaf.epoch, leaf.region), leaf.rack, leaf.shard)[depth], []).append(leaf)
        best = min(groups, key=lambda g: draw(key, f"{path}/{g}", sum(x.weight for x in groups[g]))) if len(groups) > 1 else next(iter(groups))
        return descend(key, groups[best], f"{path}/{best}", depth + 1)

    weighted = [sharding.Leaf(x.region, x.rack, x.shard, 1.0 + x.shard % 3, x.epoch) for x in sharding.tree(26)]
    df = spark.range(400).select(F.col("id").cast("string").alias("k"))
    for leaves in (sharding.tree(24), weighted):
        for r in df.select("k", sharding.shard_of(F.col("k"), leaves).alias("shard")).collect():
            assert r["shard"] == descend(r["k"], leaves, "", 0)


def test_changed_weights_move_rows_within_their_subtrees(spark):
    base = sharding.tree(24)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 9 else 1.0) for x in base]
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    for r in df.select(sharding.shard_of(F.col("k"), base).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).where("a <> b").collect():
        assert r["b"] // 8 == 1  # what moves goes into the region of shard 9
        assert r["a"] // 8 != 1 or r["b"] // 4 == 2  # within the region, into its rack


# WARC.
def test_archive_round_trip(spark, tmp_path):
    long = "<p>é" * 100_000
    rows = [(1, "http://a/\r\nX: y", long), (2, "u", long), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (0, "u", "y" * 100), (7, "u", "y" * 100), (7, "u", "y" * 100), (None, "u", "y" * 100)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_archive(pages, f"file://{tmp_path}/w", frame_bytes=1000)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    firsts = {(r[2] or ""): min(x[0] for x in rows if x[0] is not None and (x[2] or "") == (r[2] or "")) for r in rows}
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = firsts[html or ""]
        again = len(data) >= 100 and page_id != first
        r = next(x for x in got if x["page_id"] == page_id)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)
        assert again or bytes(r["payload"]) == data
    one = warc.read_records(index.where("page_id = 2")).collect()
    assert len(one) == 1 and one[0]["refers_to"] == 1
    for file in {r["file"] for r in index.collect()}:
        raw = open(file.removeprefix("file:"), "rb").read()
        frames = warc.seek_table(raw)
        import zstandard

        assert b"".join(zstandard.ZstdDecompressor().decompress(raw[a : a + n]) for a, n, _ in frames).startswith(b"WARC/1.1")
    assert warc.write_archive(pages.limit(0), f"file://{tmp_path}/e").count() == 0


# Near-duplicates.
def components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("block", [near.BLOCK, 3])
def test_components_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(1, 120)).split(" ")
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 9))
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    texts += [None, "", "  ", "alone", "alone", "two words"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(4)
    got = {r["doc_id"]: r for r in near.near_duplicates(docs, 2, 80).collect()}
    want, sizes = components(texts, 2, 80)
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    assert [got[k]["n_shingles"] for k in range(len(texts))] == sizes
    kept = sorted(r["doc_id"] for r in near.keep_first(docs, 2, 80).collect())
    assert kept == sorted(k for k, c in enumerate(want) if k == c)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Near copies beside texts that share half their words with them: block pairs give the components of brute force."""
    monkeypatch.setattr(near, "BLOCK", 40)
    rng = random.Random(12)
    base = prose(rng, 60).split(" ")
    texts = []
    for k in range(240):
        w = list(base)
        for _ in range(rng.randint(0, 5) if k % 4 else rng.randint(6, 16)):
            w[rng.randrange(len(w))] = f"other{rng.randint(0, 400)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs, 2, 80).collect()}
    want, _ = components(texts, 2, 80)
    assert len(set(want)) > 10 and [got[k] for k in range(len(texts))] == want


def test_near_edges_and_posterior(spark):
    docs = edge_docs(spark, [prose(random.Random(3), 50)])
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 900, 901, 902, 903]
    assert near.near_duplicates(docs.limit(0)).count() == 0
    assert near.least_agreements(16, 0.8, 1e-7) < near.least_agreements(16, 0.8, 1e-3) <= 13


# Licenses.
def test_license_blocks(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    texts = ["prose here\nReleased under the MIT License.\nmore prose", "x " + apache, "Licensed under the Apache Licence, Version 2.0.", "a license to tell of rivers and stones at night under green lamps", "no such word"]
    rows = licenses.scan(edge_docs(spark, texts)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert (by[0]["license_id"], by[0]["verdict"], by[0]["first_line"]) == ("MIT", "exact", 1)
    assert by[1]["license_id"] == "Apache-2.0" and by[2]["verdict"] == "variant" and by[2]["missing"] == "license" and by[2]["added"] == "licence"
    assert by[3]["verdict"] == "unknown" and 4 not in by and 900 not in by
    assert sum(r["doc_id"] == 904 for r in rows) == 2
    for license_id, text in licenses.TEMPLATES:
        assert licenses.judge(text)[0] == license_id and licenses.judge(text)[4] == "exact"


def test_license_forms_in_documents_and_prose():
    """Every notice form of the documents, and every long template inside a prose line and with a word changed."""
    forms = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0"}
    prose = " ".join("the river of stones and night walks past green lamps toward some or any mountain village".split() * 6)
    for text, license_id in forms.items():
        for line in (text, f"some prose\n{text}\nother prose"):
            assert [licenses.judge(b)[0] for _, _, b in licenses.blocks(line)] == [license_id]
    for license_id, text in licenses.TEMPLATES:
        if len(licenses.words(text)) <= licenses.AROUND:
            continue
        found = [licenses.judge(b) for _, _, b in licenses.blocks(f"{prose} {text} {prose}")]
        assert [(f[0], f[4]) for f in found] == [(license_id, "exact")]
        changed = text.split()
        middle = next(k for k in range(len(changed) // 2, len(changed)) if not any(map(licenses.telling, licenses.words(changed[k]))))
        changed[middle] = "zzz"
        found = [licenses.judge(b) for _, _, b in licenses.blocks(f"{prose} {' '.join(changed)} {prose}")]
        assert [(f[0], f[4] != "unknown") for f in found] == [(license_id, True)]
    both = "A license follows: " + licenses._MIT + ". Also Licensed under CC BY-NC 4.0. " + prose
    assert {licenses.judge(b)[0] for _, _, b in licenses.blocks(both)} >= {"MIT", "CC-BY-NC-4.0"}


def test_license_that_covers_most():
    """Changed notices against a comparison with every template: whatever its rank, the one that covers most words of those that fit is found."""
    rng = random.Random(8)
    for _, text in rng.sample(licenses.TEMPLATES, 70):
        block = text.split()
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(block))
            block[k : k + 1] = rng.choice([[], [block[k], "river"], ["stone"], block[k : k + 1] * 2])
            block = block or ["license"]
        block = " ".join(block)
        fits = []
        for license_id, template in licenses.TEMPLATES:
            own, found = licenses.words(template), licenses.words(block)
            missing, added, _, end = licenses.compare(found, own)
            n = max(len(missing), len(added))
            if n <= licenses.MAX_DIFFERENCE * len(own) and not licenses.conflict(own, missing, added, found[end:]):
                fits.append((len(missing) - len(own), n, license_id))
        license_id, _, missing, added, verdict = licenses.judge(block)
        if not fits:
            assert (license_id, verdict) == (None, "unknown")
            continue
        n = max(len(missing), len(added))
        assert (n, license_id) in {f[1:] for f in fits if f[:2] == min(fits)[:2]} and verdict == ("variant" if n else "exact")


def found_in(text):
    return [(said[0], said[4]) for *_, block in licenses.blocks(text) for said, _ in licenses.judgements(block)]


def test_names_and_versions_have_to_agree():
    gnu = lambda kind, v: licenses._GNU.format(thing="program", mark=":", stop=",", kind=kind, v=v)
    said = {
        "Licensed under the Apache License, Version 1.1.": "Apache-1.1", "This work is licensed under the GNU General Public License, version 1.": "GPL-1.0-only", gnu("Lesser ", "2.1"): "LGPL-2.1-or-later",
        gnu("Affero ", "3"): "AGPL-3.0-or-later", gnu("", "4"): None, "Subject to the terms of the Mozilla Public License, v. 1.1.": "MPL-1.1", "This work is licensed under a Creative Commons Attribution 3.1 International License.": None,
        "Licensed under CC BY 4.1.": None, "Released under the BSD License.": None, "Released under the ISC License.": "ISC", "Licensed under the Apache License, Version 3.0.": None,
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "SPDX-License-Identifier: Apache-2.0 OR MIT": None,
        "Licensed under the GNU General Public License, version 3 or any later version.": "GPL-3.0-or-later", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    }
    for text, license_id in said.items():
        got = {x for x, _ in found_in(text)}
        assert got <= {license_id, None} and (license_id is None or text.startswith("Subject") or got == {license_id}), text


def test_whole_texts_over_wrapped_lines_give_one_block():
    texts = {t: i for i, t in licenses.TEMPLATES if len(licenses.words(t)) > 60}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0"} == set(texts.values())
    for text, license_id in texts.items():
        for width in (40, 72):
            lines = __import__("textwrap").wrap(text, width)
            lines[4:4] = [""]
            page = "\n".join(["qqq river stone walks", "", f"{license_id.split('-')[0]} License", "", "Copyright (c) 2020 Jane Doe", "", *lines, "", "qqq lamp night"])
            assert [x for x, _ in found_in(page)] == [license_id]
    assert {x for x, _ in found_in("Released under the MIT License.\n\nLicensed under CC BY-NC 4.0.")} == {"MIT", "CC-BY-NC-4.0"}


def test_licenses_of_an_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string, block string")).count() == 0


# Pieces.
def test_pieces_equal_the_library_and_round_trip(spark):
    import sentencepiece

    model = pieces.loaded(pieces.default_model())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(6)
    texts = ["", " ", "     x", "a\n\nb", "日本語テキスト", "\x00�", "é" * 300, "a" * 3000, "ab" * 700, "1234567890" * 99, "▁ mark"] + ["".join(rng.choice("ab the in ion \n.é中#1▁") for _ in range(rng.randint(1, 150))) for _ in range(300)]
    for t in texts:
        assert list(model.encode(t)) == library.encode(t)
        assert list(model.stream(pieces.MARK + t.replace(" ", pieces.MARK)) if t else []) == library.encode(t)
    docs = edge_docs(spark, texts)
    out = pieces.encode(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[900]["ids"] is None and rows[901]["ids"] == [] and rows[903]["n_tokens"] > 29_999
    assert all(r["round_trip"] for r in rows.values() if r["doc_id"] is not None and r["doc_id"] < len(texts) and pieces.MARK not in texts[r["doc_id"]])
    back = {r["doc_id"]: r["text"] for r in pieces.decode(out).collect()}
    assert back[900] is None and back[3] == texts[3]


# Secrets.
def test_secret_scan(spark):
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f'{prose(rng, 5)} token = "{key(40)}" {prose(rng, 3)}' if k % 2 else f"{prose(rng, 4)} {rng.randint(10**15, 10**16)} {prose(rng, 4)} order{rng.randint(10**12, 10**13)}number" for k in range(120)]
    docs = edge_docs(spark, texts).withColumn("source", F.lit("src/a"))
    found = secret_scan.findings(docs)
    featured = secret_scan.with_features(found, secret_scan.word_counts(docs)).withColumn("label", secret_scan.rule_label())
    train, held_out = featured.where("doc_id % 3 <> 0"), featured.where("doc_id % 3 = 0")
    model = secret_scan.fit(train)
    rows = secret_scan.score(model, held_out).collect()
    assert rows and sum(r["is_secret"] == (r["label"] == 1) for r in rows) >= 0.95 * len(rows)
    assert secret_scan.fit(train.where("label = 1")) is None
    assert secret_scan.score(None, held_out).where("is_secret").count() > 0
    assert found.where("doc_id >= 900").count() == 2 * found.where("doc_id = 0").count()
    assert secret_scan.findings(docs.limit(0)).count() == 0
    assert zlib.crc32(b"") == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == cp.COLUMNS and out.count() <= docs.count()
        docs = cp.common.cut(out)
    ids = {r["doc_id"]: r["text"] for r in docs.collect()}
    encoded = {r["doc_id"]: r for r in cp.run(spark, d).collect()}
    assert set(encoded) == set(ids) and all(r["round_trip"] for r in encoded.values())
    items = [r["text"].lower() for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert not any(i in t.lower() for t in ids.values() for i in items)
