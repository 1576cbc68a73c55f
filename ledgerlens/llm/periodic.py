"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, at least ``max(min_words, 2 q)`` long, that no
neighbouring word extends. Texts are taken many at a time as one array of words, with a word of its own between two
texts, so that no run crosses them.

The dictionary names the factors of each power-of-two length n: places with equal names hold equal words, and a place
whose factor occurs once in its text has a name of its own and drops out of the longer lengths. A run of period
p in [2n - 1, 4n - 2] holds, at a multiple m of n in its first words, a factor that occurs again at m + p. The
successors of that occurrence are looked up in the two windows of twice the length that hold such places; in a
window of that size the occurrences of a factor form one arithmetic progression, so its first place, difference and count say
them all. Every term proposes a period, unless a run of a smaller period that is already known covers both occurrences, in
which case the period is no smallest one. Proposals are extended to both sides by descending the
dictionary, and among those of one stretch the smallest period stays: a larger one of the same stretch is its multiple.

A batch of w words takes about 4 bytes a word and length; lengths end where no factor occurs twice, and a text that is
longer than a batch is a batch of its own. Nothing is shuffled, and a lost task is run again from its rows.

Defined results: a null or empty text has no words, no run and an empty collapsed text; a null id keeps its row; repeated
rows repeat; an empty table stays empty; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run, in words; words handled at once.
MIN_WORDS, BATCH_WORDS = 12, 1 << 18
FOUND = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def split(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def basic_factors(words: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Names of the factors of length 1, 2, 4, ...: equal for equal factors of one owner, negative where a factor occurs once."""
    n = len(words)
    alone = -1 - np.arange(n)
    active = np.arange(n)
    names, key = [], owner * (np.int64(words.max()) + 1) + words if n else words
    length = 1
    while len(active):
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        level = alone.copy()
        active = active[again]
        level[active] = inverse[again]
        if not len(active):
            break
        names.append(level)
        # The next length: two neighbouring factors that both occur again.
        active = active[active + length < n]
        active = active[level[active + length] >= 0]
        key = level[active] * np.int64(n) + level[active + length]
        length *= 2
    return names


def extend(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from i and j on agree, and how many before them, for arrays of places."""
    n = len(names[0])
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        level, size = names[k], 1 << k
        while True:  # the longest length may repeat
            a, b = i + ahead, j + ahead
            same = (b < n) & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
            ahead[same] += size
            if k < len(names) - 1 or not same.any():
                break
        while True:
            a, b = i - back - size, j - back - size
            same = (a >= 0) & (level[np.maximum(a, 0)] == level[np.maximum(b, 0)])
            back[same] += size
            if k < len(names) - 1 or not same.any():
                break
    return ahead, back


def progressions(level: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first, difference, count) of the successors of each anchor, in either window that holds periods of the length."""
    n = len(level)
    anchors = np.arange(0, n, size)
    anchors = anchors[level[anchors] >= 0]
    order = np.flatnonzero(level >= 0)
    order = order[np.argsort(level[order], kind="stable")]  # by name, then by place
    keys = level[order] * np.int64(n) + order
    base = level[anchors] * np.int64(n)
    for low, high in ((2 * size - 1, 3 * size - 2), (3 * size - 1, 4 * size - 2)):
        if low > high:
            continue
        begin = np.searchsorted(keys, base + np.minimum(anchors + low, n))
        end = np.searchsorted(keys, base + np.minimum(anchors + high, n - 1), side="right")
        some = end > begin
        b, count = begin[some], (end - begin)[some]
        second = np.where(count > 1, order[np.minimum(b + 1, len(order) - 1)], order[b])
        yield anchors[some], order[b], second - order[b], count


def find_runs(words: np.ndarray, owner: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """(start, length, period) of all runs in an array of word numbers, by start, then period; none crosses owners."""
    runs: list[np.ndarray] = []
    n = len(words)
    names = basic_factors(words, owner) if n else []
    for k, level in enumerate(names):
        size, found = 1 << k, []
        # End of the furthest run of a period up to ``size`` that begins at a place or before.
        reach = np.zeros(n, np.int64)
        for old in runs:
            small = old[old[:, 2] <= size]
            np.maximum.at(reach, small[:, 0], small[:, 0] + abs(small[:, 1]))
        reach = np.maximum.accumulate(reach)
        for anchor, first, step, count in progressions(level, size):
            which = np.repeat(np.arange(len(anchor)), count)
            term = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            m, j = anchor[which], first[which] + step[which] * term
            fresh = reach[m] < j + size
            m, j = m[fresh], j[fresh]
            ahead, back = extend(names, m, j)
            period = j - m
            length = ahead + back + period
            whole = length >= np.maximum(2 * period, min_words)
            found.append(np.stack([m - back, length, period], 1)[whole])
            short = ~whole & (length >= 2 * period)  # too short to count, but it shows which periods are no smallest ones
            if short.any():
                found.append(np.stack([m - back, -length, period], 1)[short])
        runs.append(np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64))
    every = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    every = every[every[:, 1] > 0]
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    same = np.zeros(len(every), bool)
    same[1:] = (every[1:, :2] == every[:-1, :2]).all(1)
    every = every[~same]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, n_words, the runs by start, then period, and the text without what repeats (words joined by one blank).

    A word is dropped if a run holds it after its first ``period`` words. ``edit`` may change the words of a document first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []

        def emit() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            known: dict[bytes, int] = {}
            codes = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
            # A place of its own between texts: no factor with it occurs twice.
            at = np.concatenate([[0], np.cumsum(sizes + 1)])
            words = np.full(int(at[-1]), len(known), np.int64)
            owner = np.repeat(np.arange(len(texts)), sizes + 1)
            inner = np.ones(len(words), bool)
            inner[at[1:] - 1] = False
            words[inner] = codes
            found = find_runs(words, owner, min_words)
            whose = owner[found[:, 0]]
            found[:, 0] -= at[whose]
            cuts = np.searchsorted(whose, np.arange(len(texts) + 1))
            collapsed = []
            for k, t in enumerate(texts):
                mine = found[cuts[k] : cuts[k + 1]]
                if len(mine):
                    drop = np.zeros(len(t) + 1, np.int64)
                    np.add.at(drop, mine[:, 0] + mine[:, 2], 1)
                    np.add.at(drop, mine[:, 0] + mine[:, 1], -1)
                    t = [t[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0)]
                collapsed.append(b" ".join(t))
            struct = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], names=["start", "length", "period"])
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), struct), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )
            ids.clear()
            texts.clear()
            return out

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = split(text.as_py())
                if edit:
                    words = edit(doc, words)
                if held and held + len(words) > batch_words:
                    yield emit()
                    held = 0
                ids.append(doc)
                texts.append(words)
                held += len(words) + 1
        if ids:
            yield emit()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FOUND)


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, made periodic from a place on in one document of ten, as its id decides."""
    if doc is None or not words:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, with the planted ones, and digests of them and of the collapsed texts."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("_best.length") / -F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
