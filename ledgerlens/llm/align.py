"""Alignment of two tokenizations of the same texts, by lockstep merging.

Tokenizer A is a byte-level BPE (it gets a blank and the text), B a sentence-piece model (it adds the blank itself). Places
where a token of either ends cut a text into groups, and every A token of a group is linked with every B token of it.

Encoding: a blank between two characters that are no white space always begins a token of both, so texts are split there
and each distinct piece is encoded once a worker, by the two libraries. The pieces' ids are strung together again.

Merging: one NumPy state vector holds the A and B places of all documents of a batch (of long ones, of each stretch of
``LANE`` A tokens). A step emits the link of every place, compares the two ends, advances the token that ends first or
both, and marks a cut where they end together; documents that are finished leave the vector. The links so emitted
are the overlaps. They are all links of a group that has one token of A or of B; groups with several of both are completed
from their distinct ids.

Counting: a task packs documents into blocks of bounded size, each with its distinct pairs of ids. Only these pairs, with the number
of documents that hold them, are shuffled and summed. Each block then gets the counts of its own pairs back, and documents
are scored inside their block. Nothing reaches the driver, a pair's group holds one row a block, and blocks are
written to the shared folder once, so no lost task makes them anew with other numbers.

Memory: about 25 times the text of a batch or of the longest document. Defined results: a text that is null, empty, or not given back by the
bytes of either tokenizer has no tokens: zeros and an empty digest; names of special tokens are plain text; a null id
keeps its row; repeated rows are documents of their own, also in the counts; an empty table stays empty; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

MARK = "▁"
#: A tokens that one place of the state vector goes through; characters of a batch; links that a block holds.
LANE, BATCH_CHARS, BLOCK_LINKS = 256, 1 << 21, 1 << 21
#: Pieces and ids remembered by a worker.
MEMO_PIECES, MEMO_IDS = 600_000, 1 << 23
#: Pairs of a group expanded at once.
AT_ONCE = 1 << 22


def default_files() -> tuple[str, str]:
    """The byte-level and the sentence-piece vocabulary among the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Tokens:
    """Tokens of a batch: ids and ends (bytes from the start of the batch) of A and B, and where each document begins in either."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray


#: Fixed value: how byte-level vocabularies of this kind split texts before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text by which the quick encoder of ASCII pieces is held against the library, when a worker begins.
PROBE = " It's  we'll DON'T 12345 a_b(c)==<d>; \t\n\n aaaaaaaaaaaaa %%%%% <|endoftext|> http://x.yz/?q=1&r=%20"
#: Longest piece that the quick encoder takes.
QUICK = 64


class Tokenizers:
    """Both vocabularies, and what is remembered of pieces that were encoded."""

    #: A blank that begins a token of either, whatever stands around; two or more white characters make no such place.
    apart = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.quick = self.quick_encoder()
        self.forget()

    def quick_encoder(self):
        """A faster encoder of the same merges, where ids follow the order of merging; only for ASCII, where all libraries split alike."""
        import tiktoken

        special = set(self.a.get_added_tokens_decoder())
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
        try:
            encode = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            return encode if encode(PROBE) == self.a.encode(PROBE, add_special_tokens=False).ids else None
        except (ValueError, KeyError):  # merges of another order
            return None

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.a_ids, self.b_ids = array("i"), array("i")
        self.a_from, self.b_from, self.fits = array("q", [0]), array("q", [0]), bytearray()

    def a_of(self, pieces: list[str]) -> list[list[int]]:
        """Ids of A of each piece, a blank before it."""
        if self.quick is None:
            return [x.ids for x in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        quick = self.quick
        out = [quick(" " + p) if len(p) <= QUICK and p.isascii() else None for p in pieces]
        slow = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(slow, self.a.encode_batch_fast([" " + pieces[k] for k in slow], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces; ``fits`` says whether both vocabularies give a blank and the piece again."""
        of_a, of_b = self.a_of(pieces), self.b.encode(pieces, num_threads=1)
        raw = [b" " + p.encode("utf-8", "surrogatepass") for p in pieces]
        want = b"".join(raw)
        a, b = list(chain.from_iterable(of_a)), list(chain.from_iterable(of_b))
        lengths = lambda ids, flat, size: np.bincount(np.repeat(np.arange(len(ids)), list(map(len, ids))), size[flat], len(ids))
        sizes = np.array(list(map(len, raw)))
        good = b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))
        if good and (lengths(of_a, a, self.a_size) == sizes).all() and (lengths(of_b, b, self.b_size) == sizes).all():
            fits = [True] * len(pieces)
        else:
            fits = [b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(of_a, of_b, raw, strict=True)]
            of_a, of_b = ([x if f else [] for x, f in zip(of, fits, strict=True)] for of in (of_a, of_b))
            a, b = list(chain.from_iterable(of_a)), list(chain.from_iterable(of_b))
        self.known.update(zip(pieces, range(len(self.fits), len(self.fits) + len(pieces)), strict=True))
        self.fits.extend(fits)
        self.a_ids.extend(a)
        self.b_ids.extend(b)
        for starts, ids in ((self.a_from, of_a), (self.b_from, of_b)):
            starts.frombytes((starts[-1] + np.cumsum(np.array(list(map(len, ids)), np.int64))).tobytes())

    def pieces(self, text: str | None) -> list[str]:
        """A text cut at the blanks that begin a token of either."""
        if not text:
            return []
        # Where every white run is one blank or line end, all blanks do.
        return text.split(" ") if " ".join(text.split()) == text.replace("\n", " ") else self.apart.split(text)

    def encode(self, texts: list[str | None]) -> Tokens:
        """Tokens of each text; none for one that either tokenizer does not give back."""
        if len(self.known) > MEMO_PIECES or len(self.a_ids) + len(self.b_ids) > MEMO_IDS:
            self.forget()
        split = list(map(self.pieces, texts))
        sizes = np.array(list(map(len, split)), np.int64)
        flat = list(chain.from_iterable(split))
        found = list(map(self.known.get, flat))
        missing = [k for k, x in enumerate(found) if x is None]
        new = list(dict.fromkeys(flat[k] for k in missing))
        for k in range(0, len(new), 4096):
            self.learn(new[k : k + 4096])
        for k in missing:
            found[k] = self.known[flat[k]]
        which = np.array(found, np.int64)
        del split, flat, found
        owner = np.repeat(np.arange(len(texts)), sizes)
        unfit = owner[np.frombuffer(bytes(self.fits), np.uint8)[which] == 0]
        if len(unfit):
            keep = ~np.isin(owner, unfit)
            which, owner = which[keep], owner[keep]
        out = []
        for ids, starts, size in ((self.a_ids, self.a_from, self.a_size), (self.b_ids, self.b_from, self.b_size)):
            starts = np.array(starts)
            count = starts[which + 1] - starts[which]
            at = np.concatenate([[0], np.cumsum(count)])
            place = np.arange(at[-1]) - np.repeat(at[:-1] - starts[which], count)
            mine = np.array(ids, np.int64)[place] if len(place) else np.zeros(0, np.int64)
            per = np.bincount(owner, count, len(texts)).astype(np.int64)
            out.append((mine, np.cumsum(size[mine]), np.concatenate([[0], np.cumsum(per)])))
        (a, a_end, a_at), (b, b_end, b_at) = out
        return Tokens(a, b, a_end, b_end, a_at, b_at)


_loaded: dict[tuple[str, str], Tokenizers] = {}


def loaded(files: tuple[str, str]) -> Tokenizers:
    """Both vocabularies, read once by each worker process."""
    if files not in _loaded:
        _loaded[files] = Tokenizers(*files)
    return _loaded[files]


def lockstep(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A place, B place, whether both end there) of all overlaps, by advancing one state vector over all documents."""
    total = len(t.a) + len(t.b)
    of_a, of_b, ends = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
    counts = np.diff(t.a_at)
    lanes = -(-counts // LANE)
    first = np.repeat(t.a_at[:-1], lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    i, stop = first, np.minimum(first + LANE, np.repeat(t.a_at[1:], lanes))
    j = np.searchsorted(t.b_end, np.where(i > 0, t.a_end[i - 1], 0), side="right") if len(i) else i
    n = 0
    while len(i):
        a, b = t.a_end[i], t.b_end[j]
        now = slice(n, n + len(i))
        of_a[now], of_b[now], ends[now] = i, j, a == b
        n += len(i)
        i, j = i + (a <= b), j + (b <= a)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    return of_a[:n], of_b[:n], ends[:n]


@dataclass
class Groups:
    """Groups of a batch: sizes in tokens of A and B, group of each token, first group of each document, and the overlaps."""

    na: np.ndarray
    nb: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    at: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def groups(t: Tokens) -> Groups:
    i, j, ends = lockstep(t)
    last_a, last_b = np.sort(i[ends]), np.sort(j[ends])
    na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    number = np.arange(len(na))
    return Groups(na, nb, np.repeat(number, na), np.repeat(number, nb), np.searchsorted(last_a, t.a_at), i, j)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the weights of each."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


def links(t: Tokens, g: Groups, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair code a * width + b, how many links) of each distinct pair of each document."""
    n_docs = len(t.a_at) - 1
    doc_of = np.repeat(np.arange(n_docs), np.diff(g.at))  # by group
    code_bits = 40
    plain = (g.na == 1) | (g.nb == 1)
    mine = plain[g.of_a[g.link_a]]
    a, b = g.link_a[mine], g.link_b[mine]
    keys = (doc_of[g.of_a[a]] << code_bits) + t.a[a] * width + t.b[b]
    keys, weights = _counted(keys)
    if not plain.all():
        # Distinct ids of each group of several tokens on both sides.
        pick = lambda of, ids: _counted((of[~plain[of]] << 32) + ids[~plain[of]])
        (ka, ca), (kb, cb) = pick(g.of_a, t.a), pick(g.of_b, t.b)
        low = np.searchsorted(kb, (ka >> 32) << 32)
        many = np.searchsorted(kb, ((ka >> 32) + 1) << 32) - low
        begin = 0
        steps = np.cumsum(many)
        while begin < len(ka):
            end = max(begin + 1, int(np.searchsorted(steps, (steps[begin - 1] if begin else 0) + AT_ONCE, side="right")))
            count = many[begin:end]
            x = np.repeat(np.arange(begin, end), count)
            y = np.repeat(low[begin:end] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            more = (doc_of[ka[x] >> 32] << code_bits) + (ka[x] & 0xFFFFFFFF) * width + (kb[y] & 0xFFFFFFFF)
            keys, weights = _summed(np.concatenate([keys, more]), np.concatenate([weights, ca[x] * cb[y]]))
            begin = end
    return keys >> code_bits, keys & ((1 << code_bits) - 1), weights


def signatures(t: Tokens, g: Groups, marked: tuple[np.ndarray, np.ndarray]) -> list[memoryview]:
    """``a1,a2|b1;a3|b2,b3`` of each document: the ids of its groups in order. ``marked`` is what ``marked_ids`` gives."""
    table, width = marked
    size = len(width) // 3
    last = lambda of: np.diff(of, append=-1) != 0
    codes = np.zeros(len(t.a) + len(t.b), np.int64)
    before_b, after_a = np.cumsum(g.nb) - g.nb, np.cumsum(g.na)
    codes[np.arange(len(t.a)) + before_b[g.of_a]] = t.a + size * last(g.of_a)
    codes[np.arange(len(t.b)) + after_a[g.of_b]] = t.b + 2 * size * last(g.of_b)
    chars = table[codes]
    text = memoryview(chars[chars > 0])
    at = np.concatenate([[0], np.cumsum(width[codes])])[t.a_at + t.b_at].tolist()
    return [text[x : max(x, y - 1)] for x, y in zip(at[:-1], at[1:], strict=True)]


def marked_ids(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below n as digits with ``,``, with ``|`` and with ``;`` after them, as rows of bytes filled up with zeros, and their lengths."""
    names = [f"{i}{mark}".encode() for mark in ",|;" for i in range(n)]
    longest = max(map(len, names))
    return np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in names), np.uint8).reshape(-1, longest), np.array(list(map(len, names)))


def _batches(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list]]:
    """Ids and texts, so many characters at once."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            size = len(text or "")
            if held and held + size > chars:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc)
            texts.append(text)
            held += size + 16
    if ids:
        yield ids, texts


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


ALIGNED = "doc_id long, groups array<struct<a:array<int>,b:array<int>,end:bigint>>"


def aligned(docs: DataFrame, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its groups: ids of A, ids of B, and the byte of blank + text where the group ends."""
    files = files or default_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = loaded(files)
        for ids, texts in _batches(batches, BATCH_CHARS):
            t = tools.encode(texts)
            g = groups(t)
            ragged = lambda x, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(x, pa.int32()))
            ends = t.a_end[np.cumsum(g.na) - 1]
            start = np.concatenate([[0], t.a_end])[t.a_at[:-1]]
            struct = pa.StructArray.from_arrays([ragged(t.a, g.na), ragged(t.b, g.nb), pa.array(ends - np.repeat(start, np.diff(g.at)))], names=["a", "b", "end"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(g.at, pa.int32()), struct)], names=["doc_id", "groups"])

    return _source(docs, id_col, text_col).mapInArrow(run, ALIGNED)


_STATS = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, sizes array<int>"
BLOCKS = f"block long, {_STATS}, links binary, codes array<long>, held array<int>"


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte by byte, compressed."""
    planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(data: bytes, n: int, k: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, 4 * n * k)), np.uint8)
    return [np.ascontiguousarray(raw[4 * n * c : 4 * n * (c + 1)].reshape(4, n).T).view("<u4").ravel() for c in range(k)]


def blocks(docs: DataFrame, files: tuple[str, str], id_col: str, text_col: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Documents packed in blocks: figures of each, its pairs as places in the block's own list of pairs, and that list with the documents that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = loaded(files)
        width, marked = len(tools.b_bytes), marked_ids(max(len(tools.a_bytes), len(tools.b_bytes)))
        base, number = TaskContext.get().partitionId() << 32, 0
        stats: list[list] = [[] for _ in range(7)]
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            codes = np.concatenate([p[0] for p in pairs])
            known, place, count = np.unique(codes, return_inverse=True, return_counts=True)
            data = _packed(place, np.concatenate([p[1] for p in pairs]))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.int32()]
            cells = [pa.array([base + number]), *[pa.array([x], pa.list_(k)) for x, k in zip(stats, kinds, strict=True)]]
            cells += [pa.array([data], pa.binary()), pa.array([known], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(cells, names=[f.split()[0] for f in BLOCKS.split(", ")])

        for ids, texts in _batches(batches, BATCH_CHARS):
            t = tools.encode(texts)
            g = groups(t)
            doc, code, weight = links(t, g, width)
            shas = [hashlib.sha256(s).hexdigest() if len(s) else "" for s in signatures(t, g, marked)]
            whole = np.concatenate([[0], np.cumsum(g.na * g.nb)])[g.at]
            for column, x in zip(stats, (ids, np.diff(t.a_at), np.diff(t.b_at), np.diff(g.at), np.diff(whole), shas, np.bincount(doc, minlength=len(ids))), strict=True):
                column.extend(x if isinstance(x, list) else x.tolist())
            pairs.append((code, weight))
            held += len(code)
            if held >= block_links:
                yield emit()
                number, held, pairs, stats = number + 1, 0, [], [[] for _ in range(7)]
        if stats[0]:
            yield emit()

    return cut(_source(docs, id_col, text_col).mapInArrow(run, BLOCKS))


def pair_counts(packed: DataFrame, width: int) -> DataFrame:
    """(code, a, n, best): documents that hold each pair linked, and whether no pair of its A id is in more."""
    each = packed.select(F.explode(F.arrays_zip("codes", "held")).alias("x")).select(F.col("x.codes").alias("code"), F.col("x.held").alias("held"))
    counts = each.groupBy("code").agg(F.sum("held").alias("n")).withColumn("a", F.floor(F.col("code") / width))
    return counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("a")))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment_scores(docs: DataFrame, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", block_links: int = BLOCK_LINKS) -> DataFrame:
    """Figures of each document's alignment, its links weighed by the documents of the corpus that hold the same pair.

    n_best: links whose pair is in as many documents as any pair of its A id; count_sum: the counts of all links, summed.
    """
    files = files or default_files()
    packed = blocks(docs, files, id_col, text_col, block_links)
    counts = pair_counts(packed, loaded(files).b.get_piece_size())
    asked = packed.select(F.col("block").alias("of"), F.posexplode("codes").alias("place", "code"))
    told = asked.join(counts, "code").select("of", "place", "n", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["place"].to_numpy(), kind="stable")
        n, best = right["n"].to_numpy()[order], right["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        row = {c: left[c][0].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "sizes")}
        sizes = row["sizes"].to_numpy()
        place, weight = (x.astype(np.int64) for x in _unpacked(left["links"][0].as_py(), int(sizes.sum()), 2))
        at = np.concatenate([[0], np.cumsum(sizes)])
        per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        n_best, total = (per(weight * best[place]), per(weight * n[place])) if len(place) else (np.zeros(len(sizes), np.int64),) * 2
        return pa.table([row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], pa.array(n_best), pa.array(total), row["groups_sha256"]], names=[f.split()[0] for f in SCORED.split(", ")])

    figures = packed.drop("codes", "held")
    return figures.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(score, SCORED)


def op11_lockstep_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents aligned, with corpus-wide counts of their pairs."""
    return alignment_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
