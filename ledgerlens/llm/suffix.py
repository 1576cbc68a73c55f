"""Removal of long repeated byte strings with run-length indexes.

Every string of ``length`` bytes has one anchor: its least k-gram hash. Equal strings have equal anchors
at the same place, so strings need comparing only where they share an anchor. The strings around one
anchor of one text start at consecutive places; the bytes they span are that anchor's stretch. Stretches that
are equal as a whole are counted by hash. Where one anchor has several different stretches, these
are dealt by anchor to tasks, and each block of them gets a run-compressed Burrows-Wheeler transform with
the common-prefix lengths sampled at run ends: walking a stretch backwards through the transform, the
match with the neighbouring suffixes grows by one inside a run and is read from the samples at its ends.
Those matching statistics mark every start whose match reaches ``length``.

An anchor with more than ``MANY`` different stretches is dealt to blocks, and each pair of its blocks gets an index of
its own: a string occurs elsewhere if it does so in one of these pairs. Nothing is capped, and no group is
gathered in one task.

Defined results: null texts are empty; texts shorter than ``length`` keep all; texts of any length are taken whole;
repeated rows are copies of one another; matches never cross rows; an empty table gives an empty result; other columns
are ignored, whatever their names; bytes need not stay valid UTF-8, so kept texts are binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, cut, mix64, release, row_key, utf8

LENGTH, GRAM = 400, 64
#: Bytes of a text looked at together; bytes of stretches indexed together; stretches of one anchor in a block at most.
PIECE, BLOCK, MANY = 4 << 20, 1 << 20, 2048

_OCC = pa.schema([("k_id", pa.int64()), ("k_text", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
OCC_SCHEMA = "k_id long, k_text long, at long, n int, fp long, h1 long, h2 long"
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings (a power of two), by doubling."""
    h, base, width = x.astype(np.uint64) + np.uint64(1), 0xB5AD4ECEDA1CE2A9, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    return mix64(h)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(x: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of each stretch of a byte array."""
    if len(x) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(x)
    keyed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    least = _sliding_min(keyed, length - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first, np.diff(np.append(first, len(least))), h[(least[first] & _LOW).astype(np.int64)]


def occurrences(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """All stretches: row key, first start, starts, anchor, 128-bit hash of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_views(batch.column(2))
            ids, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            out = []
            for k in range(batch.num_rows):
                a, b = offsets[k], offsets[k + 1]
                for lo in range(0, max(0, b - a - length + 1), PIECE):
                    piece = data[a + lo : min(b, a + lo + PIECE + length - 1)]
                    at, n, fp = anchors(piece, length)
                    view = memoryview(piece)
                    digest = hashlib.blake2b
                    hashes = np.frombuffer(b"".join([digest(view[s:e], digest_size=16).digest() for s, e in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                    out.append((np.full(len(at), ids[k]), np.full(len(at), texts[k]), at + lo, n.astype(np.int32), fp.view(np.int64), hashes[:, 0], hashes[:, 1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*out, strict=True), _OCC, strict=True)], schema=_OCC)

    return docs.select(*row_key(id_col, text_col), utf8(F.col(text_col)).alias("data")).mapInArrow(run, OCC_SCHEMA)


class RunIndex:
    """Run-compressed transform of a block of strings, with common prefixes sampled at run ends."""

    def __init__(self, strings: list[bytes]):
        m = len(strings)
        sizes = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(sizes + 1) - 1  # places of the terminators
        text = np.empty(int(ends[-1]) + 1, np.int64)
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        text[:] = raw.astype(np.int64) + m
        text[ends] = np.arange(m)  # terminators are all different, so all suffixes are
        self.text, self.ends, self.sizes, n = text, ends, sizes, len(text)
        rank, self.levels, width = self._dense(text), [], 1
        limit = int(sizes.max()) + 1
        while True:
            self.levels.append((width, rank))
            if width >= limit:
                break
            nxt = np.zeros(n, np.int64)
            nxt[:-width] = rank[width:] + 1
            rank, width = self._dense(rank * (n + 1) + nxt), width * 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        self.rank = rank
        bwt = text[suffixes - 1]
        heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        tails = np.append(heads[1:], n) - 1
        # Stable order of the runs by character gives where each run goes: the last-to-first mapping.
        order = np.argsort(bwt[heads], kind="stable")
        lengths = tails - heads + 1
        goes = np.empty(len(heads), np.int64)
        goes[order] = np.cumsum(lengths[order]) - lengths[order]
        self.heads, self.tails, self.goes = heads, tails, goes
        self.above = self._common(suffixes, goes - 1, goes)
        last = goes + lengths - 1
        self.below = self._common(suffixes, last, last + 1)

    @staticmethod
    def _dense(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        out = np.empty(len(keys), np.int64)
        out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        return out

    def _common(self, suffixes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes in rows a and b; 0 beyond the first or last row."""
        n = len(suffixes)
        good = np.flatnonzero((a >= 0) & (b < n))
        p, q = suffixes[a[good]], suffixes[b[good]]
        total = np.zeros(len(good), np.int64)
        for width, rank in reversed(self.levels):
            same = (p + total < n) & (q + total < n)
            same[same] = rank[(p + total)[same]] == rank[(q + total)[same]]
            total[same] += width
        out = np.zeros(len(a), np.int64)
        out[good] = total
        return out

    def statistics(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Stream all strings backwards at once: (place from the end, strings, their longest match from there)."""
        row, above, below = self.rank[self.ends], np.zeros(len(self.ends), np.int64), np.zeros(len(self.ends), np.int64)
        lanes = np.arange(len(self.ends))
        for step in range(1, int(self.sizes.max()) + 1):
            live = self.sizes[lanes] >= step
            if not live.all():
                lanes, row, above, below = lanes[live], row[live], above[live], below[live]
            run = np.searchsorted(self.heads, row, "right") - 1
            above = np.where(row == self.heads[run], self.above[run], above + 1)
            below = np.where(row == self.tails[run], self.below[run], below + 1)
            row = self.goes[run] + row - self.heads[run]
            yield step, lanes, np.maximum(above, below)


def long_matches(strings: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each string, the runs (first, last) of starts whose ``length`` bytes occur elsewhere in the block."""
    index = RunIndex(strings)
    width = int(index.sizes.max()) - length + 2
    marks = np.zeros((len(strings), max(1, width) + 1), bool)
    for step, lanes, match in index.statistics():
        hit = lanes[match >= length]
        marks[hit, index.sizes[hit] - step] = True
    edges = np.diff(np.concatenate([np.zeros((len(strings), 1), bool), marks, np.zeros((len(strings), 1), bool)], axis=1).view(np.int8), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for (i, a), (_, b) in zip(np.argwhere(edges == 1), np.argwhere(edges == -1), strict=True):
        out[i].append((int(a), int(b) - 1))
    return out


_PART = pa.schema([("k_id", pa.int64()), ("k_text", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
PART_SCHEMA = "k_id long, k_text long, a long, b long"


def keyed_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k_id, k_text, data): the one form in which texts are shuffled, so that the exchange is reused."""
    return docs.select(*row_key(id_col, text_col), utf8(F.col(text_col)).alias("data"))


def _indexed(contexts: DataFrame, length: int, many: int) -> DataFrame:
    """Repeated starts of single stretches, found in blocks of whole anchors, or in pairs of blocks of a larger anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def work():
            rows = []
            for (*_, c, k_id, k_text, at, _), runs in zip(held, long_matches([x[-1] for x in held], length), strict=True):
                if c == 1:
                    rows += [(k_id, k_text, at + lo, at + hi + length) for lo, hi in runs]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_PART)], schema=_PART)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Pairs of one anchor share blocks, so they never stand in one index.
                if held and row[:3] != last and (size >= BLOCK or row[0] == last[0]):
                    yield work()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
                last = row[:3]
        if held:
            yield work()

    blocks = F.ceil(F.col("d") / many)
    dealt = contexts.withColumn("own", F.pmod(F.xxhash64("h1", "h2"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pairs = dealt.select("fp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "c", "k_id", "k_text", "at", "data")
    return pairs.repartition("fp", "p", "q").sortWithinPartitions("fp", "p", "q").mapInArrow(run, PART_SCHEMA)


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """(k_id, k_text, spans): byte ranges covered by strings that also start elsewhere; they may overlap."""
    occ = cut(occurrences(docs, length, id_col, text_col))
    # Most anchors occur once: what follows sees only the others.
    # Written, so that the join that follows can split a hot anchor.
    common = cut(occ.groupBy("fp").agg(F.count("*").alias("t")).where("t > 1").select("fp"))
    shared = cut(occ.join(common, "fp", "left_semi"))
    release(occ, common)
    hull = shared.groupBy("fp", "h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("k_id", "k_text", "at", "n")).alias("r"))
    anchor = hull.groupBy("fp").agg(F.count("*").alias("d"))
    wanted = cut(hull.join(anchor, "fp").where("d > 1 OR c > 1").select("fp", "h1", "h2", "c", "d", "r.*"))
    contexts = wanted.where("d > 1").join(keyed_bytes(docs, id_col, text_col), ["k_id", "k_text"]).select("fp", "h1", "h2", "c", "d", "k_id", "k_text", "at", F.expr(f"substring(data, int(at) + 1, n + {length - 1})").alias("data"))
    parts = _indexed(contexts, length, many)
    again = wanted.where("c > 1").select("fp", "h1", "h2")
    whole = shared.join(again, ["fp", "h1", "h2"], "left_semi").select("k_id", "k_text", F.col("at").alias("a"), (F.col("at") + F.col("n") + length - 1).alias("b"))
    return whole.unionByName(parts).groupBy("k_id", "k_text").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])
OUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<a: long, b: long>>"


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """Each row's size, removed bytes, maximal removed runs, remaining bytes and the runs themselves."""
    spans = repeated_spans(docs, length, id_col, text_col, many)
    texts = keyed_bytes(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = data.as_py()
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                left, at = [], 0
                for a, b in merged:
                    left.append(data[at:a])
                    at = b
                kept = b"".join([*left, data[at:]])
                rows.append((doc_id, len(data), len(data) - len(kept), len(merged), kept, [{"a": a, "b": b} for a, b in merged]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_OUT)], schema=_OUT)

    doc_id = F.when(F.col("k_id") != -(2**63), F.col("k_id")).alias("doc_id")
    return texts.join(spans, ["k_id", "k_text"], "left").select(doc_id, "data", "spans").mapInArrow(run, OUT_SCHEMA)


def op5_run_length_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated 400-byte strings: digests, the removed byte ranges, and what is left as text (broken characters replaced)."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    left = F.expr("make_valid_utf8(cast(kept AS string))").alias("text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "removed", left)
