"""SentencePiece encoding and decoding for merge-type (BPE) models, by a prefix table.

The encoding of every prefix of a text is unique, so it has one last token. The table stores that
token per prefix: an Aho-Corasick automaton yields the tokens that end at a place, and of these the
one is right that is compatible with the last token of the prefix before it. Two tokens are
compatible if their joint text encodes to just these two; a sequence of tokens is an encoding if and
only if all neighbours in it are compatible, since a merge that would cross a border depends on the
two tokens beside it alone. The ids of the whole are recovered backwards from the last place.

A compatibility is worked out once by running the merges over the pair, then remembered. A text is
cut where no token can reach across (before a run of space marks, and around characters that occur in
no longer token); the pieces between are encoded apart, and a bounded memory of pieces spares
encoding frequent ones again.

Only models are taken whose normaliser changes nothing but spaces (identity, a leading space mark, no
removal of repeated spaces, byte fallback); others raise an error.

Defined cases: null and empty texts have no tokens; other columns stay out; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Entries of each of the two generations of remembered pieces, and of compatibilities.
PIECES_KEPT = 350_000
PAIRS_KEPT = 1_000_000
#: Notes of pieces whose decoded text is not their own; beyond that all is forgotten.
ODD_KEPT = 50_000
#: Longer pieces are not remembered.
LONGEST_KEPT = 64


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: plain pieces with scores, and the byte tokens."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read with the sentencepiece library; checks that the model is of the kind taken here."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = [i for i in range(size) if model.is_byte(i)]
        probe = "ﬁ é é  　x\t\n\x00 "
        if len(byte_ids) != 256 or model.decode(model.encode(probe)) != probe or model.encode("") != []:
            raise ValueError("only BPE models with byte fallback and an identity normaliser are supported")
        return cls({pieces[i]: i for i in plain}, {pieces[i]: model.get_score(i) for i in plain}, byte_ids)


class Codec:
    """Encodes and decodes texts; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.tokens = list(vocabulary.ids)  # token number -> text; single characters are appended as they are met
        self.number = {t: k for k, t in enumerate(self.tokens)}
        self.automaton = ahocorasick.Automaton()
        for text, k in self.number.items():
            if len(text) > 1:
                self.automaton.add_word(text, (k, len(text)))
        self.automaton.make_automaton()
        if any(MARK in t.lstrip(MARK) for t in self.tokens):
            raise ValueError("tokens with a space mark inside are not supported")
        joint = {c for t in self.tokens if len(t) > 1 for c in t} - {MARK}
        inner = "".join(map(re.escape, sorted(joint)))
        self.cutter = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|.", re.DOTALL)
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.text_of = {i: t for t, i in vocabulary.ids.items()}
        self.byte_of = {i: k for k, i in enumerate(vocabulary.bytes_)}

    def _single(self, char: str) -> int:
        k = self.number.get(char)
        if k is None:  # not in the vocabulary: a token of its own here, bytes in the output
            k = self.number[char] = len(self.tokens)
            self.tokens.append(char)
        return k

    def merged(self, text: str) -> list[str]:
        """The merges themselves: the best-scored adjacent pair first, the leftmost of equals."""
        parts, scores = list(text), self.vocabulary.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joint text of two tokens encodes to just these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.tokens[left], self.tokens[right]
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def prefix_table(self, text: str) -> list[int]:
        """For each prefix but the empty one, the number of the last token of its encoding."""
        last = [-1] * len(text)
        pairs, compatible = self.pairs, self.compatible
        for end, (k, length) in self.automaton.iter(text):  # places in ascending order
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0:
                left = last[before]
                if left < 0:  # no longer token ends there
                    left = last[before] = self._single(text[before])
                known = pairs.get(left << 32 | k)
                if known or (known is None and compatible(left, k)):
                    last[end] = k
            elif self._alone(k):
                last[end] = k
        return [self._single(text[at]) if k < 0 else k for at, k in enumerate(last)]

    def _alone(self, k: int) -> bool:
        """Whether the token's own text encodes to it."""
        known = self.pairs.get(-1 - k)
        if known is None:
            known = self.pairs[-1 - k] = self.merged(self.tokens[k]) == [self.tokens[k]]
        return known

    def piece_ids(self, piece: str) -> list[int]:
        """The ids of a piece no token reaches out of."""
        last, ids, at = self.prefix_table(piece), [], len(piece)
        by_text, byte_ids = self.vocabulary.ids, self.vocabulary.bytes_
        while at:
            token = self.tokens[last[at - 1]]
            known = by_text.get(token)
            if known is not None:
                ids.append(known)
            else:
                ids.extend(byte_ids[b] for b in reversed(token.encode("utf-8", "surrogatepass")))
            at -= len(token)
        return ids[::-1]

    def _remembered(self, piece: str) -> str:
        """The ids of a piece, joined by commas; notes the decoded text where it isn't the piece's own."""
        found = self.old.get(piece)
        if found is None:
            ids = self.piece_ids(piece)
            found = ",".join(map(str, ids))
            plain = self._plain(ids)
            if plain != piece.replace(MARK, " "):
                self.odd[piece] = plain
        if len(piece) <= LONGEST_KEPT:
            if len(self.young) >= PIECES_KEPT:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def pieces(self, text: str | None) -> list[str]:
        """The text with its leading mark, cut where no token reaches across."""
        return self.cutter.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        joined = [self._remembered(p) for p in self.pieces(text)]
        return [int(i) for i in ",".join(joined).split(",")] if joined else []

    def _plain(self, ids: list[int]) -> str:
        """The text of ids, space marks as spaces, without dropping the leading one."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i >= 0:
                out.append(self.text_of.get(i, ""))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the leading space that encoding adds is dropped again."""
        return self._plain(ids).removeprefix(" ")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(count of ids, ids joined by commas, decoded text) by way of remembered pieces."""
        if len(self.odd) > ODD_KEPT:  # all three, as a remembered piece relies on its note
            self.odd, self.young, self.old = {}, {}, {}
        pieces, young, remembered = self.pieces(text), self.young, self._remembered
        if not pieces:
            return 0, "", ""
        ids = ",".join([young.get(p) or remembered(p) for p in pieces])
        if self.odd:
            pieces = [self.odd.get(p, p) for p in pieces]
        return ids.count(",") + 1, ids, "".join(pieces).replace(MARK, " ").removeprefix(" ")


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec for a broadcast vocabulary; only the latest is held."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value)
    return _CODECS[shared.id]


class _Shared:
    """A broadcast with a name that survives pickling."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.held = spark.sparkContext.broadcast(vocabulary)
        self.id = self.held._jbroadcast.id() if self.held._jbroadcast is not None else id(self)

    @property
    def value(self) -> Vocabulary:
        return self.held.value


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    shared = _share(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids = pa.array([codec.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null decodes to the empty text."""
    shared = _share(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = pa.array([codec.decode(x.as_py() or []) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")


def round_trip_digest(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``): encoded and decoded again, as digests."""
    shared = _share(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for cell in batch.column(1):
                n, ids, plain = codec.digest(cell.as_py())
                counts.append(n)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _share(df: DataFrame, model_path: str) -> _Shared:
    return _Shared(df.sparkSession, Vocabulary.load(model_path))
