"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become ids with an end id; longer ones are cut so that all pieces but the first are full.
Packing is online best-fit in bounded space: a fixed number of bins is open, kept in a bitset whose
bit f is set if a bin with f free tokens is open. A piece goes to the open bin it leaves the least
space in (the lowest set bit from its length on). If it fits nowhere and all bins are in use, the
fullest bin closes, and a new one opens.

Tokenising is a map over the input; packing needs only lengths, so the shuffle carries a few numbers
per piece, dealt by a hash of document and piece and ordered by it. Pieces thus arrive at random
lengths, as best-fit likes them, no key is hot, and a task that is run again packs the same way. Each
task packs its own share; memory per task is the open bins and a batch.

Defined cases: null text is empty, and empty documents are one piece of just the end id; repeated ids
are packed as documents of their own; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.byte_bpe import ByteBpe

SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 512
#: Sequence numbers of a task begin at its partition number times this.
TASK_SPAN = 1 << 40


class BestFit:
    """Bounded-space online best-fit."""

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.size, self.limit, self.open, self.made, self.free = size, open_bins, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``size`` tokens."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.size, self.made
            self.made += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.size - space

    def _take(self, space: int) -> int:
        """Remove an open bin with that much space."""
        held = self.bins[space]
        number = held.pop()
        if not held:
            self.free &= ~(1 << space)
        self.open -= 1
        return number


_TOKENIZERS: dict[int, ByteBpe] = {}


def _tokenizer(definition: bytes) -> ByteBpe:
    key = zlib.crc32(definition)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = ByteBpe(definition)
    return _TOKENIZERS[key]


def cuts(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def tokenised_pieces(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, size: int = SEQUENCE
) -> DataFrame:
    """(id, piece, start, length, ids_crc32 and, if asked, ids) of every piece of every document."""
    with open(tokenizer_path, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    end = END_ID.to_bytes(4, "little")
    kind = df.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                data = tokenizer.encode(text.as_py()) + end
                for n, (s, size_) in enumerate(cuts(len(data) // 4, size)):
                    part = data[4 * s : 4 * (s + size_)]
                    row.append(k)
                    piece.append(n)
                    start.append(s)
                    length.append(size_)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, fields)


#: Characters of text for each task: its open bins, left unfilled at its end, are then few of its sequences.
TASK_CHARS = 100_000_000


def tasks_for(df: DataFrame, text_col: str = "text") -> int:
    """How many tasks the texts are packed in: one number is asked for."""
    return 1 + (df.agg(F.sum(F.length(text_col))).first()[0] or 0) // TASK_CHARS


def pack(pieces: DataFrame, id_col: str = "doc_id", size: int = SEQUENCE, open_bins: int = OPEN_BINS, tasks: int | None = None) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``length`` must be 1 to ``size``.

    Pieces are dealt by their content as well as their id, so no id and no text makes a task larger. Each task leaves up to
    ``open_bins`` sequences unfilled; ``tasks_for`` gives a number at which those count for little.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    key = F.xxhash64(id_col, "piece", *(c for c in ("start", "ids_crc32") if c in columns))
    dealt = pieces.select(*columns)
    dealt = (dealt.repartition(tasks, key) if tasks else dealt.repartition(key)).sortWithinPartitions(key, *(c for c in columns if c != "ids"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, packer = TaskContext.get().partitionId() * TASK_SPAN, BestFit(size, open_bins)
        for batch in batches:
            places = [packer.place(n) for n in batch.column("length").to_pylist()]
            sequence = pa.array([base + b for b, _ in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sequence, pa.array([o for _, o in places], pa.int64())], names=[*columns, "sequence_id", "offset"])

    return dealt.mapInArrow(run, fields)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the token sequences themselves, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col("ids").alias("ids"), F.col(id_col).alias("doc"))))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.flatten(F.col("p.ids")).alias("ids"),
        F.col("p.doc").alias("doc_ids"),
        F.col("p.offset").alias("starts"),
    )
