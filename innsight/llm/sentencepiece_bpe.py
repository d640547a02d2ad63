"""SentencePiece BPE encoding and decoding with a prefix table (operator 10).

For every prefix of a word the table stores the one token with which the encoding of that prefix
ends. An automaton over the pieces gives all pieces that end at a position; the right one is
the only one compatible with the last token of the prefix before it, where two
tokens are compatible if their concatenation encodes to just these two. The ids are then read
backwards from the end of the word. The work is linear in the text, however long a word is.

Texts are cut where no piece can reach across: before a run of spaces, after it but for
the last space, and around line ends. Runs of spaces have pieces of their own, which all rank
below every other merge and among themselves alike, so they merge greedily from the left.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from string import ascii_letters

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.common import documents, slices, text_or_empty

SPACE_MARK = "▁"
#: Entries of a worker's caches; a full one is emptied, but words used since the one before stay.
CACHE_WORDS, CACHE_PAIRS = 120_000, 400_000
#: Longer words are encoded without being kept.
CACHE_CHARS = 48
_CHUNKS = re.compile(r" *[^ \n]+| *\n| +$").findall


class _Words(dict):
    """Ids of the words met lately, packed as 32-bit integers: smaller than tuples, and joined by one copy."""

    def __init__(self, coder: PieceCodec):
        self.coder = coder

    def __missing__(self, chunk: str) -> bytes:
        return self.coder.word_ids(chunk)


class PieceCodec:
    """Encoder and decoder of one model: BPE pieces, byte fallback, a leading dummy space."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.end = lib.eos_id()
        special = {i for i in range(len(self.pieces)) if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        normal = [i for i in range(len(self.pieces)) if i not in special and i not in self.byte_of]
        self.ids = {self.pieces[i]: i for i in normal}
        self.runs = {len(p): i for p, i in self.ids.items() if p.strip(SPACE_MARK) == ""}
        words = {p: i for p, i in self.ids.items() if p.strip(SPACE_MARK) or p == SPACE_MARK}
        if any(SPACE_MARK in p[1:] or "\n" in p for p in words) or len(self.byte_ids) != 256:
            raise ValueError("a model whose pieces reach across words, or that lacks byte fallback")
        self.score = {p: lib.get_score(i) for p, i in words.items()}
        self.automaton = ahocorasick.Automaton()
        self._splits: dict[str, tuple[str, str] | None] = {}
        self._lefts: dict[str, dict[str, bool]] = {p: {} for p in words if self.split(p)}
        self._tested = 0
        for p, lefts in self._lefts.items():
            self.automaton.add_word(p, (p, len(p), lefts))
        self.automaton.make_automaton()
        self._encoded, self._before = _Words(self), {}
        across = {p[i:i + 2] for p in words for i in range(len(p) - 1)}
        #: Packed id of a comma or full stop behind a letter, if no piece reaches across: the word before it is encoded for itself.
        self._stops = {a + b: self.chunk_ids(b) for a in ascii_letters for b in ".," if a + b not in across}
        self._packed_end = array("i", [self.end]).tobytes()
        self._bytes = pa.array([self._bytes_of(i) for i in range(len(self.pieces))], pa.binary())
        self._marked = np.array([p.startswith(SPACE_MARK) for p in self.pieces])

    def _bytes_of(self, i: int) -> bytes:
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        return b"" if i == self.end else self.pieces[i].replace(SPACE_MARK, " ").encode()

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes ``piece``; None if plain BPE of its text ends otherwise.

        The best-scored adjacent pair merges first, the leftmost of equals.
        """
        if piece in self._splits:
            return self._splits[piece]
        parts, made = list(piece), ("", piece)
        while len(parts) > 1:
            scores = [self.score.get(x + y, -np.inf) for x, y in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -np.inf:
                break
            at = scores.index(best)
            made = (parts[at], parts[at + 1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        self._splits[piece] = out = made if len(parts) == 1 else None
        return out

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens can stand side by side: nothing merges across the border between them.

        The merges next to the border are undone, the latest first. A pair across the border that
        ranks before the merge just undone would have been merged by then.
        """
        a, b, score, undone, known = left, right, self.score, -np.inf, True
        after_left = True
        while True:
            across = score.get(a + b)
            if across is not None and (across > undone or across == undone and not after_left):
                known = False  # equal scores merge from the left
                break
            late_a = score[a] if len(a) > 1 else np.inf
            late_b = score[b] if len(b) > 1 else np.inf
            if late_a == late_b == np.inf:
                break
            after_left = late_a < late_b
            if after_left:
                undone, a = late_a, self.split(a)[1]
            else:
                undone, b = late_b, self.split(b)[0]
        return known

    def _test(self, left: str, right: str, lefts: dict[str, bool]) -> bool:
        self._tested += 1
        if self._tested >= CACHE_PAIRS:
            self._tested = 0
            for known in self._lefts.values():
                known.clear()
        lefts[left] = out = self.compatible(left, right)
        return out

    def word_pieces(self, word: str) -> list[str]:
        """Tokens of a word, at most its first character a space mark."""
        last: list[str | None] = [None] * len(word)
        for end, (piece, size, lefts) in self.automaton.iter(word):
            if last[end] is None:
                if end < size:  # from the start of the word
                    last[end] = piece
                    continue
                left = last[end - size] or word[end - size]
                fits = lefts.get(left)
                if fits or fits is None and self._test(left, piece, lefts):
                    last[end] = piece
        out, i = [], len(word) - 1
        while i >= 0:
            out.append(last[i] or word[i])  # no piece: a character for byte fallback
            i -= len(out[-1])
        return out[::-1]

    def run_ids(self, n: int) -> list[int]:
        """Ids of ``n`` spaces: from the left, each token grows while a longer run is a piece."""
        parts: list[int] = []
        for _ in range(n):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                parts[-2:] = [parts[-2] + parts[-1]]
        return [self.runs[k] for k in parts]

    def chunk_ids(self, chunk: str) -> bytes:
        """Packed ids of a run of spaces and the word or line end behind it."""
        word = chunk.lstrip(" ")
        spaces = len(chunk) - len(word)
        pieces = self.word_pieces(SPACE_MARK + word if spaces else word)
        ids: list[int] = []
        if spaces and pieces[0] == SPACE_MARK:
            ids, pieces = self.run_ids(spaces), pieces[1:]
        elif spaces > 1:
            ids = self.run_ids(spaces - 1)
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            else:
                ids.extend([self.byte_ids[b] for b in p.encode()])
        return array("i", ids).tobytes()

    def word_ids(self, chunk: str) -> bytes:
        """``chunk_ids`` by way of the caches."""
        out = self._before.get(chunk)
        if out is None:
            mark = self._stops.get(chunk[-2:])
            out = self._encoded[chunk[:-1]] + mark if mark else self.chunk_ids(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self._encoded) >= CACHE_WORDS:
                self._before, self._encoded = self._encoded, _Words(self)
            self._encoded[chunk] = out
        return out

    def chunks(self, text: str) -> list[str]:
        return _CHUNKS(" " + text.replace(SPACE_MARK, " ")) if text else []

    def packed(self, text: str) -> bytes:
        """All ids of a text, with the end id, packed as 32-bit integers."""
        return b"".join([*map(self._encoded.__getitem__, self.chunks(text)), self._packed_end])

    def encode(self, text: str) -> list[int]:
        """All ids of a text, with the end id."""
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, bytes joined to characters, the leading dummy space dropped."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if i == self.end:
                continue
            piece = self.pieces[i]
            if not out and piece.startswith(SPACE_MARK):
                piece = piece[1:]
                out.append("")
            out.append(piece.replace(SPACE_MARK, " "))
        out.append(raw.decode(errors="replace"))
        return "".join(out)

    def decode_all(self, ids: pa.ListArray) -> list[str]:
        """``decode`` of lists that end with the end id: their pieces are joined as bytes, without a step per id."""
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self._bytes.take(ids.values)), b"").to_pylist()
        first = self._marked[ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]].tolist()
        return [(b[1:] if m else b).decode(errors="replace") for b, m in zip(joined, first, strict=True)]


@functools.lru_cache(maxsize=2)
def codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int, the end id last) and decoded (their text) for every row of ``docs``.

    The ids and the decoded text are those of the sentencepiece library with an end id only, without
    sampling. Defined cases: a null text is empty; an empty text has just the end id and decodes
    to empty text; ids, nulls and repeated rows pass as they are; an empty table gives no
    rows; other columns are left out. The model is read on the driver and sent to the tasks.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model.value)
        for batch in chain.from_iterable(slices(b, "text") for b in batches):
            texts = batch.column("text").to_pylist()
            encoded = [coder.packed(text) for text in texts]
            ends = np.cumsum([0, *(len(e) >> 2 for e in encoded)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(coder.decode_all(ids), pa.string())], ["doc_id", "ids", "decoded"])

    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text"))
    return own.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    return digests(encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *more,
    )
