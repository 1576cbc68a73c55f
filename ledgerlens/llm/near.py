"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets form a class, and one row stands for it. Signatures of the classes are
cut into bands; classes that share a band are candidates. Signature values of a pair are compared a batch
at a time: with a flat prior, m agreements of n give a Beta posterior of the similarity, and a pair goes as
soon as the chance of reaching the threshold falls below the miss probability. Survivors are confirmed
on the full shingle sets.

First each class of a band meets one hub, the band's smallest class number, so groups of thousands of copies
need no quadratic table. What these links join is one component. Bands whose classes still fall into several
components are then dealt to blocks of bounded size, and each pair of blocks is one task's work: pairs of
different components are pruned batch by batch and confirmed on the full sets where they lie, best first, and
a task passes over pairs that its own links have joined. A pair belongs to the first band that it shares.
Only links leave a task: candidates are never rows. No link between different components is left untested.

Defined results: a null, empty or blank text has an empty set and stays alone; fewer words than a shingle
make one shingle; texts of any length are taken whole; repeated rows are copies of one another; ties go to the
smallest id (null ids last); an empty table gives an empty result; other columns are ignored, whatever their
names (``keep_first`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, cut, mix64, release, row_key, utf8
from .components import components
from .words import shingle_set

ROWS, BANDS, BATCH = 4, 24, 16
#: Chance of losing a pair at the threshold in one batch.
MISS = 1e-7
#: Classes of a band, and shingles of their sets, in one block; each pair of blocks is one task's work.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Pairs of a block compared at once.
CHUNK = 1 << 16
#: Classes whose texts are set apart, up to which their names are broadcast; beyond it they are joined by a shuffle.
BROADCAST_CLASSES = 100_000

_SIGS = pa.schema([("doc_id", pa.int64()), ("k_id", pa.int64()), ("k_text", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])
SIG_SCHEMA = "doc_id long, k_id long, k_text long, n_shingles long, s1 long, s2 long, sig binary"


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32), (seeds[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minima of a set of 64-bit hashes under n permutations of 32-bit numbers."""
    flips, factors = _permutations(n)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        h = (x[None, at : at + 4096] ^ flips[:, None]) * factors[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def least_agreements(n: int, threshold: float, miss: float = MISS) -> int:
    """Fewest agreements among n signature values at which P(similarity >= threshold) is at least ``miss``.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def signatures(docs: DataFrame, shingle: int, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's key, set size, 128-bit set hash and signature (null for an empty set)."""
    n = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_views(batch.column(3))
            sizes, one, two, sigs = [], [], [], []
            for k in range(batch.num_rows):
                s = shingle_set(data[offsets[k] : offsets[k + 1]], shingle)
                sizes.append(len(s))
                one.append(int(mix64(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                two.append(int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64)) if len(s) else 0)
                sigs.append(signature(s, n).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())], schema=_SIGS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), utf8(F.col(text_col)).alias("data")).mapInArrow(run, SIG_SCHEMA)


def _bands(sigs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit name of each band of each signature (one a row)."""
    parts = sigs.reshape(len(sigs), -1, rows)
    h = np.zeros(parts.shape[:2], np.uint64) + np.arange(parts.shape[1], dtype=np.uint64)
    for r in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h


def _steps(n: int, threshold: float) -> list[tuple[int, int]]:
    """(values compared so far, fewest agreements with which a pair goes on), batch by batch."""
    return [(k, least_agreements(k, threshold)) for k in range(BATCH, n + 1, BATCH)]


def _surviving(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (x[i], y[j]) that no batch of signature values rules out, and their agreements."""
    alive, agree = np.arange(len(i)), np.zeros(len(i), np.int32)
    for k, least in steps:
        agree = agree + (x[i[alive], k - BATCH : k] == y[j[alive], k - BATCH : k]).sum(axis=1, dtype=np.int32)
        good = agree >= least
        alive, agree = alive[good], agree[good]
    return alive, agree


def _reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold, in integer arithmetic."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _hub_links(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) that no batch of signature values rules out and whose full shingle sets reach the threshold."""
    steps = _steps(n, percent / 100)

    def probable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, n) for c in (2, 3))
            every = np.arange(batch.num_rows)
            yield batch.select([0, 1]).take(pa.array(_surviving(x, y, every, every, steps)[0]))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            views, names = [byte_views(batch.column(c)) for c in (2, 3)], [batch.column(c).to_pylist() for c in (0, 1)]
            keep = []
            for k in range(batch.num_rows):
                sets = []
                for (data, offsets), name in zip(views, names, strict=True):
                    if name[k] not in memo:
                        if len(memo) > 64:
                            memo.clear()
                        memo[name[k]] = shingle_set(data[offsets[k] : offsets[k + 1]], shingle)
                    sets.append(memo[name[k]])
                if _reaches(*sets, percent):
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    def both(frame: DataFrame, column: str) -> DataFrame:
        x, y = (texts.select(F.col("c").alias(z), F.col(column).alias(f"{column}_{z}")) for z in ("a", "b"))
        return frame.join(x, "a").join(y, "b").select("a", "b", f"{column}_a", f"{column}_b")

    left = cut(both(pairs, "sig").mapInArrow(probable, "a long, b long"))
    out = cut(both(left, "data").mapInArrow(confirmed, "a long, b long"))
    release(left)
    return out


def _cross_links(rows: list[tuple], band: int, shingle: int, percent: int, per_band: int, steps: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Links (a, b, component of a, component of b) that join the components of a pair of blocks of one band.

    Rows are (whether in the second block, class, component, set size, signature, text); of a single block, all are in the first.
    """
    second, c, k, size = (np.array([r[i] for r in rows]) for i in range(4))
    sigs = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), -1)
    names = _bands(sigs, per_band)
    one = not second.any()
    u = np.flatnonzero(~second)
    v = u if one else np.flatnonzero(second)
    open_ = k[u][:, None] != k[v][None, :]
    if one:
        open_ = np.triu(open_, 1)
    a, b = size[u][:, None], size[v][None, :]
    open_ &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    for t in range(int(np.flatnonzero(names[0].view(np.int64) == band)[0])):  # pairs that share an earlier band belong there
        open_ &= names[u, t][:, None] != names[v, t][None, :]
    i, j = (w[x] for w, x in zip((u, v), np.nonzero(open_), strict=True))
    found = [(at + alive, agree) for at in range(0, len(i), CHUNK) for alive, agree in [_surviving(sigs, sigs, i[at : at + CHUNK], j[at : at + CHUNK], steps)]]
    if not found:
        return []
    alive, agree = (np.concatenate(x) for x in zip(*found, strict=True))
    alive = alive[np.argsort(-agree, kind="stable")]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    sets: dict[int, np.ndarray] = {}
    out = []
    for p, q in zip(i[alive].tolist(), j[alive].tolist(), strict=True):
        x, y = find(int(k[p])), find(int(k[q]))
        if x == y:
            continue
        for r in (p, q):
            if r not in sets:
                sets[r] = shingle_set(np.frombuffer(rows[r][5], np.uint8), shingle)
        if _reaches(sets[p], sets[q], percent):
            out.append((int(c[p]), int(c[q]), int(k[p]), int(k[q])))
            root[max(x, y)] = min(x, y)
    return out


_LINK = pa.schema([(x, pa.int64()) for x in ("a", "b", "ka", "kb")])


def _block_links(open_rows: DataFrame, texts: DataFrame, shingle: int, percent: int, per_band: int, n: int) -> DataFrame:
    """Links between components, found by pairs of blocks of open bands (rows: band, class c, component k, blocks of the band)."""
    steps = _steps(n, percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def work() -> pa.RecordBatch:
            found = _cross_links(held, last[0], shingle, percent, per_band, steps)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], schema=_LINK)

        for batch in batches:
            for band, p, q, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (band, p, q) != last:
                    if held:
                        yield work()
                    held, last = [], (band, p, q)
                held.append(row)
        if held:
            yield work()

    own = F.pmod(F.xxhash64("c"), F.col("blocks"))
    dealt = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("second"), "c", "k")
    rows = dealt.join(texts, "c").select("band", "p", "q", "second", "c", "k", "n_shingles", "sig", "data")
    return rows.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q").mapInArrow(run, "a long, b long, ka long, kb long")


def link(docs: DataFrame, shingle: int, percent: int, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, links, components): each row's class c, confirmed pairs of classes that connect all that any links connect, and (c, root).

    A class is a number for one shingle set; its representative is the row of smallest key.
    """
    n = rows * bands
    kind = ["s1", "s2", "n_shingles"]
    signed = cut(signatures(docs, shingle, rows, bands, id_col, text_col))
    first = signed.where("sig IS NOT NULL").groupBy(*kind).agg(F.min(F.struct("k_id", "k_text")).alias("r"), F.first("sig").alias("sig"))
    reps = cut(first.select(*kind, "r.k_id", "r.k_text", "sig").withColumn("c", F.monotonically_increasing_id()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, n), rows)
            c = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), c], names=["band", "c"])

    band = reps.select("c", "sig").mapInArrow(keys, "band long, c long")
    # The hub of a band is an aggregate, so a hot band is never gathered.
    shared = band.groupBy("band").agg(F.count("*").alias("n"), F.min("c").alias("hub")).where("n > 1").select("band", "hub")
    rows_in = cut(band.join(shared, "band"))
    # Only classes that share a band are ever confirmed: their texts are set apart once, by the row that stands for each.
    banded = cut(reps.join(rows_in.select("c").distinct(), "c", "left_semi").select("k_id", "k_text", "c", "n_shingles", "sig"))
    named = F.broadcast(banded) if banded.count() <= BROADCAST_CLASSES and not banded.isEmpty() else banded
    found = docs.select(*row_key(id_col, text_col), utf8(F.col(text_col)).alias("data")).join(named.select("k_id", "k_text", "c"), ["k_id", "k_text"])
    texts = cut(found.dropDuplicates(["c"]).select("c", "data").join(banded.select("c", "n_shingles", "sig"), "c"))
    links = _hub_links(rows_in.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct(), texts, shingle, percent, n)
    of = components(links)
    placed = rows_in.join(of.withColumnRenamed("node", "c"), "c", "left").select("band", "c", F.coalesce("component", "c").alias("k"))
    sized = placed.join(reps.select("c", "n_shingles"), "c")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks")
    split = sized.groupBy("band").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), blocks).where("lo <> hi").select("band", "blocks")
    more = cut(_block_links(placed.join(split, "band"), texts, shingle, percent, rows, n))
    top = components(more, "ka", "kb")
    root = F.coalesce("r", "k").alias("root")
    labelled = reps.select(*kind, "c").join(of.withColumnRenamed("node", "c"), "c", "left").select(*kind, "c", F.coalesce("component", "c").alias("k"))
    labelled = labelled.join(top.select(F.col("node").alias("k"), F.col("component").alias("r")), "k", "left").select(*kind, "c", root)
    member = signed.select("doc_id", "k_id", "k_text", *kind)
    return member, links.unionByName(more.select("a", "b")), labelled


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k_id, k_text, n_shingles, class_id, component_id, kept for every row.

    class_id and component_id are smallest document ids; ``kept`` marks the row that stays (ties among repeated
    rows share one verdict).
    """
    member, _, labelled = link(docs, shingle, percent, rows, bands, id_col, text_col)
    kind = ["s1", "s2", "n_shingles"]
    first = member.where("n_shingles > 0").groupBy(*kind).agg(F.min("doc_id").alias("class_id"))
    placed = cut(first.join(labelled, kind))
    least = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    whole = placed.join(least, "root").select(*kind, "class_id", "component_id")
    out = member.join(whole, kind, "left")
    empty = F.col("n_shingles") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "k_id", "k_text", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group left: that of the smallest id; among repeated rows, one."""
    kept = near_duplicates(docs, shingle, percent, id_col=id_col, text_col=text_col).where("kept").select("k_id", "k_text").distinct()
    keys = [c.alias(f"_{n}") for c, n in zip(row_key(id_col, text_col), ("k_id", "k_text"), strict=True)]
    names = docs.columns
    chosen = docs.select(*names, *keys).join(kept, (F.col("_k_id") == F.col("k_id")) & (F.col("_k_text") == F.col("k_text")), "left_semi")
    return chosen.dropDuplicates(["_k_id", "_k_text"]).select(*names)


def op6_bayes_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of all documents on 2-word shingles at similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


ORACLE = None
