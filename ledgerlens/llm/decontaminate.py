"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m characters that occurs in a document with at most k edits shares at least
(m - q + 1) - k*q of its q-grams with it, and their diagonals (place in the document minus place in the
item) span at most k. So the shared q-grams are counted in overlapping diagonal bands of width 2(k+1)
and stride k+1; bands that reach the bound are verified by banded alignment.

Text and items are compared in lower case, with each white-space character as one blank. k is
``edit_share`` of m, lowered where needed so that the bound stays at least 1. Documents are scanned in
place, with no shuffle. Items are the query set: they go to the tasks in blocks of at most
``block_chars`` characters, each block against all documents, so what is sent is bounded at any size of
the benchmark.

Items shorter than q after trimming have no q-gram; they are found by an automaton where they stand exactly and
as whole words: no letter or digit comes before or after.

Defined results: null and empty texts match nothing; null and blank items are not searched for; items repeated in
the benchmark count once; of overlapping hits of an item the one with fewest edits counts, then the earlier, then
the shorter; a text of any length is scanned whole, in overlapping pieces; empty tables give an empty result; a repeated
document row gives its own rows again; ``decontaminate`` tells rows with a null or repeated id apart by their texts; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, row_key

Q, EDIT_SHARE, BLOCK_CHARS = 8, 0.08, 4_000_000
#: Characters scanned at once; longer texts go in overlapping pieces.
PIECE = 1 << 19
MATCH_SCHEMA = "doc_id long, item_id long, start long, end long, edits int"
_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
_KEYED = _MATCH.append(pa.field("k_id", pa.int64())).append(pa.field("k_text", pa.int64()))
#: Stands between texts and outside any text; no character has this code.
GAP = np.uint32(0xFFFFFFFF)
_FOLD_ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fold(text: str) -> str:
    """Lower case and blanks, character by character, so places stay those of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_FOLD_ASCII)
    for c in "\n\t\r\x0b\x0c\x85\xa0":
        low = low.replace(c, " ")
    return low


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram of a code array, by doubling."""
    base = 0x9E3779B97F4A7C15 | 1
    out, done, h, width = None, 0, x.astype(np.uint64) + np.uint64(1), 1
    rest = q
    while rest:
        if rest & 1:
            if out is None:
                out, done = h[: len(x) - q + 1].copy(), width
            else:
                out = out * np.uint64(pow(base, width, 1 << 64)) + h[done : done + len(x) - q + 1]
                done += width
        rest >>= 1
        if rest:
            h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
            width *= 2
    return mix64(out)


class ItemIndex:
    """The q-grams of a block of items: sorted hashes with postings, and a bit table in front."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], q: int, edit_share: float):
        self.q, self.ids, self.texts, self.k, self.need = q, [], [], [], []
        hashes, item_of, place_of, short = [], [], [], []
        for item_id, text in sorted(set(items)):
            folded = fold(text).strip()
            m = len(folded)
            if m < q:
                short += [(item_id, folded)] if m else []
                continue
            k = max(0, min(int(edit_share * m), (m - q) // q))
            h = gram_hashes(codes(folded), q)
            hashes.append(h)
            item_of.append(np.full(len(h), len(self.ids), np.int64))
            place_of.append(np.arange(len(h), dtype=np.int64))
            self.ids.append(item_id)
            self.texts.append(folded)
            self.k.append(k)
            self.need.append(m - q + 1 - k * q)
        self.longest = max(map(len, self.texts), default=0) + 2 * max(self.k, default=0) + q
        self.short = self._automaton(short) if short else None
        if not hashes:
            self.grams = np.zeros(0, np.uint64)
            return
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.item_of, self.place_of = np.concatenate(item_of)[order], np.concatenate(place_of)[order]
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.counts = np.diff(np.append(self.first, len(h)))
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.grams >> np.uint64(64 - self.BITS)] = True
        self.stride = np.array(self.k, np.int64) + 1
        self.bound = np.array(self.need, np.int64)

    def _automaton(self, short: list[tuple[int, str]]) -> ahocorasick.Automaton:
        """Finds all short items at once; the items of a text follow those with q-grams."""
        of: dict[str, list[int]] = {}
        for item_id, text in short:
            of.setdefault(text, []).append(len(self.ids))
            self.ids.append(item_id)
        out = ahocorasick.Automaton()
        for text, items in of.items():
            out.add_word(text, (len(text), items))
        out.make_automaton()
        return out

    def whole_words(self, text: str) -> dict:
        """The places (item, start, end) of short items in a folded text, all without edits."""
        hits = {}
        for last, (m, items) in self.short.iter(text) if self.short else ():
            start, end = last + 1 - m, last + 1
            if not (start and text[start - 1].isalnum() or text[end : end + 1].isalnum()):
                hits |= {(item, start, end): 0 for item in items}
        return hits

    def candidates(self, x: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) pairs whose shared q-grams reach the bound; band b covers diagonals from b*stride."""
        if len(x) < self.q or not len(self.grams):
            return []
        h = gram_hashes(x, self.q)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - self.BITS)])
        if not len(at):
            return []
        where = np.searchsorted(self.grams, h[at])
        where[where == len(self.grams)] = 0
        good = self.grams[where] == h[at]
        at, where = at[good], where[good]
        n = self.counts[where]
        total = int(n.sum())
        if not total:
            return []
        entry = np.repeat(self.first[where] - np.cumsum(n) + n, n) + np.arange(total)
        item = self.item_of[entry]
        band = (np.repeat(at, n) - self.place_of[entry]) // self.stride[item]
        keys = (item << 40) + band + (1 << 39)
        keys = np.sort(np.concatenate([keys, keys - 1]))  # each diagonal lies in two overlapping bands
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        return [(int(k >> 40), int((k & ((1 << 40) - 1)) - (1 << 39))) for k in keys[count >= self.bound[keys >> 40]]]


def banded_end(item: np.ndarray, text: np.ndarray, first: int, last: int, k: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits of ``item`` against a stretch of ``text`` that starts on diagonals first..last, and where that stretch ends.

    Only cells on diagonals first-k..last+k are computed. ``anchored`` demands a start at place 0.
    """
    low, high = first - k, last + k
    offs = np.arange(low, high + 1)
    big = len(item) + len(text) + 1
    row = np.where((offs >= first) & (offs <= last) & (offs >= 0) & (offs <= len(text)), 0, big)
    if anchored:
        row = np.where(offs >= 0, offs, big)
    steps = np.arange(len(offs))
    padded = np.concatenate([np.full(max(0, -low) + 1, GAP), text, np.full(len(item) + high + 1, GAP)])
    shift = max(0, -low) + 1
    for i, c in enumerate(item):
        col = offs + i + 1  # end places in the text after this item character, one for each diagonal
        chars = padded[np.clip(col - 1 + shift, 0, len(padded) - 1)]
        best = row + (chars != c)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[(col < 0) | (col > len(text))] = big
        row = np.minimum.accumulate(best - steps) + steps
        row[(col < 0) | (col > len(text))] = big
    at = int(np.argmin(row))
    return int(row[at]), int(offs[at]) + len(item)


def verify(index: ItemIndex, text: str, item: int, band: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the item in this band of a folded text, or None."""
    wanted, k, stride = index.texts[item], index.k[item], index.k[item] + 1
    lo = max(0, band * stride - k)
    hi = min(len(text), (band + 2) * stride + len(wanted) + k)
    if hi - lo < len(wanted) - k:
        return None
    piece = text[lo:hi]
    exact = piece.find(wanted)
    if exact >= 0:
        return lo + exact, lo + exact + len(wanted), 0
    if not k:
        return None
    a, b = codes(wanted), codes(piece)
    edits, end = banded_end(a, b, band * stride - lo, (band + 2) * stride - lo, k)
    if edits > k:
        return None
    back = b[max(0, end - len(a) - k) : end][::-1]
    _, length = banded_end(a[::-1], back, 0, 0, k, anchored=True)
    return lo + end - length, lo + end, edits


def scan(index: ItemIndex, text: str) -> list[tuple[int, int, int, int]]:
    """All (item, start, end, edits) in one folded text; overlapping hits of an item keep the best."""
    step = max(PIECE, 4 * index.longest)
    hits = {}
    for lo in range(0, max(1, len(text) - index.longest), step):
        piece = text[lo : lo + step + index.longest]
        for item, band in index.candidates(codes(piece)):
            if found := verify(index, piece, item, band):
                place = (item, lo + found[0], lo + found[1])
                hits[place] = min(found[2], hits.get(place, found[2]))
    return best_hits(hits)


def best_hits(hits: dict) -> list[tuple[int, int, int, int]]:
    """Hits of an item that overlap none of fewer edits."""
    out, kept = [], {}
    for (item, start, end), edits in sorted(hits.items(), key=lambda x: (x[0][0], x[1], x[0][1], x[0][2])):
        # Those kept are disjoint: of all that start before the end, the last one reaches farthest.
        own = kept.setdefault(item, [])
        at = bisect_left(own, (end,))
        if not at or own[at - 1][1] <= start:
            insort(own, (start, end))
            out.append((item, start, end, edits))
    return out


def scan_many(index: ItemIndex, texts: list[str]) -> list[tuple[int, list]]:
    """(row, hits) of the texts of a batch; short texts are filtered together."""
    out, group, size = [], [], 0

    def together():
        if not group:
            return
        starts, parts, at = [], [], 0
        for _, t in group:
            starts.append(at)
            parts.append(t)
            at += len(t) + 1
        x = codes("\0".join(parts))
        cuts = np.array(starts[1:], np.int64) - 1
        x = x.copy()
        x[cuts] = GAP
        per_row: dict[int, dict] = {}
        begins = np.array(starts, np.int64)
        for item, band in index.candidates(x):
            stride, m, k = index.k[item] + 1, len(index.texts[item]), index.k[item]
            # A band may touch two texts: try each text that its stretch meets.
            lo, hi = band * stride - k, (band + 2) * stride + m + k
            a = max(0, int(np.searchsorted(begins, lo, "right")) - 1)
            for r in range(a, len(group)):
                if starts[r] >= hi:
                    break
                row, text = group[r]
                # Bands of the joined text are re-based: this text's own diagonals start at its first character.
                for own in {(band * stride - starts[r]) // stride, (band * stride - starts[r]) // stride + 1}:
                    if found := verify(index, text, item, own):
                        hits, place = per_row.setdefault(row, {}), (item, found[0], found[1])
                        hits[place] = min(found[2], hits.get(place, found[2]))
        out.extend((row, best_hits(h)) for row, h in per_row.items())

    for row, text in enumerate(texts):
        if len(text) > PIECE:
            if hits := scan(index, text):
                out.append((row, hits))
            continue
        if size + len(text) > PIECE:
            together()
            group, size = [], 0
        group.append((row, text))
        size += len(text) + 1
    together()
    if index.short:
        out.extend((row, best_hits(h)) for row, text in enumerate(texts) if (h := index.whole_words(text)))
    return sorted(out)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of about ``block_chars`` characters, one at a time on the driver."""
    items = benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")
    ).distinct()
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r["i"], r["t"]) for r in part.toLocalIterator()]


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """As find_leaks, with the key of the row (id and text) besides."""
    source = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    out = None
    for block in blocks(benchmark, item_col, item_text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, q, edit_share)
            for batch in batches:
                ids, k_id, k_text = (batch.column(c) for c in (0, 2, 3))
                texts = [fold(t) for t in batch.column(1).to_pylist()]
                rows = [(ids[r].as_py(), index.ids[i], s, e, d, k_id[r].as_py(), k_text[r].as_py()) for r, hits in scan_many(index, texts) for i, s, e, d in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _KEYED, strict=True)], schema=_KEYED)

        found = source.mapInArrow(search, f"{MATCH_SCHEMA}, k_id long, k_text long")
        out = found if out is None else out.unionByName(found)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each benchmark item found in a document: doc_id, item_id, start, end, edits."""
    return _leaks(docs, benchmark, id_col, text_col, item_col, item_text, q, edit_share, block_chars).drop("k_id", "k_text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns; rows are told apart by id and text."""
    leaked = _leaks(docs, benchmark, **how).select(F.col("k_id").alias("_k_id"), F.col("k_text").alias("_k_text")).distinct()
    own = row_key(how.get("id_col", "doc_id"), how.get("text_col", "text"))
    return docs.join(leaked, (own[0] == F.col("_k_id")) & (own[1] == F.col("_k_text")), "left_anti")


def op1_qgram_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item found in any document."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
