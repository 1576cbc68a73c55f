"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model is a byte-pair one, so the best path is not the one of the largest score sum but the one that
merging in score order would reach. That path also has a left-to-right recursion: the encoding of each
prefix ends in exactly one piece, the piece whose pair with the last piece before it would survive
merging. The pass keeps, for the last ``longest`` places, that piece as a backpointer, and commits ids as
soon as the backpointer paths of every place in the window run through one boundary. Between a
character and a following word mark no piece can reach across, so there all paths converge; pieces between
two such points are remembered, since words repeat.

Model: identity normalisation, a word mark before the text, blanks as word marks, bytes for characters
that the vocabulary lacks. The file is read with the sentencepiece library only for its pieces and scores.

Defined results: a null text has null ids; an empty one has none; the word mark itself decodes as a blank;
repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Entries remembered by each worker: words (in two generations) and pairs of pieces; longest word remembered.
MEMO_WORDS, MEMO_PAIRS, MEMO_LENGTH = 300_000, 500_000, 48
#: Places after which a long run without word marks is tested for convergence.
TEST_EVERY = 64
ENCODED = "doc_id long, n_tokens int, ids array<int>, round_trip boolean"


def default_model() -> str:
    """Path of the 32k byte-pair model among the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary of a model: ids and ranks by piece, bytes by id."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, self.ranks, self.byte_ids = {}, {}, {}
        self.data: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.data.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.data.append(b"")
            else:
                self.ids[piece] = i
                self.ranks[piece] = -model.get_score(i)
                self.data.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids))
        #: Cuts a marked text where all paths converge: before word marks, and round line ends that no piece holds.
        stop = "" if any("\n" in p for p in self.ids) else "\n"
        self.chunks = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + (f"|{stop}" if stop else "")).findall
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches across a word mark")
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                tails.setdefault(p[-2:], set()).add(len(p))
        #: Lengths of the pieces that end in two given characters, longest first.
        self.tails = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), p, i))
        self.automaton.make_automaton()
        self.alphabet = {p for p in self.ids if len(p) == 1}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def survives(self, left: str, right: str, key=None) -> bool:
        """Whether merging the joined text ends in exactly these two pieces."""
        key = key or (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def token_ids(self, piece: str) -> Iterable[int]:
        found = self.ids.get(piece)
        return (found,) if found is not None else (self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters; the window holds ``longest`` places and what is not yet committed."""
        ids, tails, longest, survives = self.ids, self.tails, self.longest, self.survives
        window, last = "", [""]  # last[j]: piece that ends the encoding of the first j window characters
        before = ""  # the piece committed before the window
        for c in chars:
            window += c
            n = len(window)
            chosen = None
            for size in tails.get(window[-2:], ()):
                if size > n:
                    continue
                left = last[n - size] if n > size else before
                if left is None:
                    continue
                piece = window[n - size :]
                if piece in ids and (not left or survives(left, piece)):
                    chosen = piece
                    break
            else:
                left = last[n - 1] if n > 1 else before
                if left is not None and (not left or survives(left, c)):
                    chosen = c
            last.append(chosen)
            if n % TEST_EVERY == 0 and n > longest:
                at = self.converged(last)
                if at:
                    path = self.path(last, at)
                    for piece in path:
                        yield from self.token_ids(piece)
                    before, window, last = path[-1], window[at:], [""] + last[at + 1 :]
        for piece in self.path(last, len(window)):
            yield from self.token_ids(piece)

    def short(self, chunk: str) -> bytes:
        """Ids of a word from its convergence point to the next; all its characters are pieces.

        An automaton lists the pieces that end at each place, longest first; the first that survives with
        the backpointer before it becomes the backpointer of the place.
        """
        pairs, survives = self.pairs, self.survives
        last: list = [None] * (len(chunk) + 1)
        for end, found in self.automaton.iter(chunk):
            if last[end + 1] is None:
                size, piece, i = found
                begin = end + 1 - size
                if not begin:
                    last[end + 1] = found
                elif (left := last[begin]) is not None:
                    known = pairs.get(left[2] << 20 | i)
                    if known if known is not None else survives(left[1], piece, left[2] << 20 | i):
                        last[end + 1] = found
        out, at = [], len(chunk)
        while at:
            size, _, i = last[at]
            out.append(i)
            at -= size
        return array("i", out[::-1]).tobytes()

    def converged(self, last: list[str]) -> int:
        """The latest boundary that the paths of all places still in reach run through, or 0."""
        n = len(last) - 1
        fronts = {j for j in range(max(1, n - self.longest + 1), n + 1) if last[j] is not None}
        while len(fronts) > 1:
            j = max(fronts)
            fronts.remove(j)
            fronts.add(j - len(last[j]))
        return fronts.pop() if fronts else 0

    @staticmethod
    def path(last: list[str], at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def word(self, chunk: str) -> bytes:
        """Ids between two convergence points, as 32-bit integers, remembered if short."""
        known = self.words.get(chunk) or self.old_words.get(chunk)
        if known is None:
            plain = len(chunk) <= MEMO_LENGTH and self.alphabet.issuperset(chunk)
            known = self.short(chunk) if plain else array("i", self.stream(chunk)).tobytes()
        if len(chunk) <= MEMO_LENGTH:
            if len(self.words) >= MEMO_WORDS:
                self.old_words = dict(self.words)
                self.words.clear()
            self.words[chunk] = known
        return known

    def encode(self, text: str) -> array:
        """Ids of a text, committed from one convergence point to the next."""
        out = array("i")
        if text:
            known, word = self.words.get, self.word
            out.frombytes(b"".join([known(c) or word(c) for c in self.chunks(MARK + text.replace(" ", MARK))]))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the first word mark goes, bytes are read as UTF-8."""
        raw = b"".join(map(self.data.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}


def loaded(model_file: str) -> Pieces:
    """The vocabulary, read once by each worker process."""
    if model_file not in _loaded:
        _loaded[model_file] = Pieces(model_file)
    return _loaded[model_file]


_IDS = pa.list_(pa.int32())
#: Ids gathered before a batch is passed on.
OUT_TOKENS = 1 << 21


def encode(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding the ids gives the text again."""
    model_file = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_file)
        for batch in batches:
            ids = batch.column(0)
            start, counts, flat, same = 0, [], array("i"), []

            def emit(end: int) -> pa.RecordBatch:
                offsets = [None if n is None else 0 for n in counts] + [0]
                at = 0
                for k, n in enumerate(counts):
                    offsets[k] = None if n is None else at
                    at += n or 0
                offsets[-1] = at
                values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(memoryview(flat))])
                return pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "round_trip"],
                )

            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                if text is None:
                    counts.append(None)
                    same.append(None)
                else:
                    found = pieces.encode(text)
                    counts.append(len(found))
                    same.append(pieces.decode(found) == text)
                    flat.extend(found)
                if len(flat) >= OUT_TOKENS:
                    yield emit(k + 1)
                    start, counts, flat, same = k + 1, [], array("i"), []
            if counts:
                yield emit(batch.num_rows)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_file: str | None = None, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Texts of encoded rows; null ids give a null text, other columns stay."""
    model_file = model_file or default_model()
    keep = [c for c in encoded.columns if c not in (ids_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_file)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, out])

    source = encoded.select(*keep, ids_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}{', ' if fields else ''}`{out}` string")


def op8_streaming_pieces(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole document, checked by decoding."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
