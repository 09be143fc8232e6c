"""Conversation prefix trie: what conversations share from their first turn on.

A conversation is an array of turns; a turn is known by the SHA-256 of its role and text and by its length
in code points. The arrays are sorted over all tasks (range partitions; equal arrays by id), so that the
conversations below a node of the trie stand next to each other. The longest common prefix (LCP) of
neighbours gives the nodes: a task sweeps its rows with a stack of the nodes that are still open, and sends
a node once the next row leaves it.

A node may reach over borders of tasks. The first and last rows of all tasks tell how deep it can: the
driver gets two arrays a task in turn, keeps one, and notes one number for every border. Nodes no deeper
than a border's number are sent in parts, named by the task where they begin and their depth
(``Borders.begun``), and parts are added up by name. Everything but the digest of ids is a sum or a
minimum; the ids of a node that ends conversations in several tasks are sent as pieces of text in order,
and pass through the hash one after another.

Memory: a task holds two arrays, the open nodes and their finished children (one at most for each row);
one conversation's array (40 bytes a turn) must fit a row.

Defined cases: rows without a conversation id take no part; turns are ordered by number (null first), then
role and text; null role or text is empty; repeated rows are turns of their own; a conversation without turns
belongs to the root alone; no conversations, no nodes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.llm.common import durable, whole_text

#: Bytes that stand for a turn.
WIDTH = 32
#: Ids of a piece of text, and rows of a batch that is sent.
PIECE, BATCH = 50_000, 4096


def turn_rows(df: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, chars): a row for every turn, in order within its conversation."""
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").alias("at"), whole_text("role").alias("role"), whole_text("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), digest.alias("digest"), F.length("text").alias("chars"))


def turn_arrays(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array of (pos, digest, chars)) of ``turn_rows``."""
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("turns"))


def rebuilt(df: DataFrame, per_family: int = 100, shared: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns of the family's first conversation, then a conversation's own after its first h.

    A conversation c belongs to the family of ``c - c % per_family``; h is the CRC-32 of its decimal id
    modulo ``shared``. A family's first conversation gives at most ``shared - 1`` turns to fewer than
    ``2 * per_family`` others, so the join has no key that grows with the data.
    """
    own = turn_arrays(turn_rows(df))
    head = own.where(F.col("conv_id") % per_family == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    keyed = own.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % per_family).alias("family"), h.alias("h")).join(head, "family", "left")
    kept = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return keyed.select("conv_id", F.concat(first, kept).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two arrays begin with alike."""
    most = min(len(a), len(b)) // WIDTH
    low, step = 0, 1
    while low < most:  # steps that grow, then shrink: few comparisons whether much or little is shared
        step = min(step, most - low)
        if a[low * WIDTH : (low + step) * WIDTH] == b[low * WIDTH : (low + step) * WIDTH]:
            low += step
            step *= 2
        elif step == 1:
            break
        else:
            most, step = low + step, max(1, step // 2)
    return low


@dataclass
class Borders:
    """LCPs at the borders of tasks that have rows: of a task's first row with the row before, its last with the row after."""

    before: dict[int, int] = field(default_factory=dict)
    after: dict[int, int] = field(default_factory=dict)
    #: By task, for every depth up to ``before``: the task where that node begins.
    begun: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, ends: Iterator[tuple[int, bytes, bytes]]) -> Borders:
        """From (task, first, last) in order of tasks; sorted rows share what their first and last row share."""
        made, task, last, through = cls(), None, b"", 0
        for now, first, final in ends:
            if task is None:
                made.before[now], made.begun[now] = -1, []
            else:
                lcp = shared_turns(last, first)
                made.after[task] = made.before[now] = lcp
                old = made.begun[task]
                made.begun[now] = [old[d] if d < len(old) and d <= through else task for d in range(lcp + 1)]
            task, last, through = now, final, shared_turns(first, final)
        if task is not None:
            made.after[task] = -1
        return made


class _Node:
    """An open node: what its rows have added so far, its finished children, and the ids that end in it."""

    __slots__ = ("children", "ends", "least", "leaves", "mass", "members", "name", "once", "waiting")

    def __init__(self, name: int | None):
        self.name = name  # the task where it begins, of a node that an earlier task has too
        self.members = self.children = self.leaves = self.mass = self.once = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.waiting: list[list] = []


#: What a sweep sends. ``begin`` (of parts alone) and ``depth`` name a node; ``up`` names its parent where the parent is sent in parts.
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
FIELDS = f"begin long, depth long, conv_id long, parent_conv_id long, up long, {', '.join(f'{c} long' for c in SUMS)}, ends_sha256 string, piece string"
_SCHEMA = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in FIELDS.split(", ")])
_PARENT, _UP = 3, 4


def _sent(rows: Iterator[Sequence], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches."""
    while out := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _closed(stack: list[_Node], depth: int, task: int, right: int) -> Iterator[list]:
    """Close the nodes deeper than ``depth``; those no deeper than ``right`` go on in the next task."""
    while len(stack) > depth + 1:
        d, node = len(stack) - 1, stack.pop()
        name = node.name if node.name is not None else task if d <= right else None
        for child in node.waiting:  # now their parent's least id is known, or that only all tasks know it
            child[_UP if name is not None else _PARENT] = node.least if name is None else name
            yield child
        sums = [node.members, node.children, node.leaves, node.mass - node.once]
        up = stack[-1] if stack else None
        if up is not None:
            up.leaves, up.mass, up.once = up.leaves + node.leaves, up.mass + node.mass, up.once + node.once
        if name is not None:
            above = None if up is None else task if up.name is None else up.name
            for k in range(0, max(len(node.ends), 1), PIECE):
                piece = ",".join(map(str, node.ends[k : k + PIECE]))
                yield [name, d, node.least, None, above, *(sums if not k else [0] * len(SUMS)), None, piece or None]
            continue
        row = [None, d, node.least, None, None, *sums, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest(), None]
        if up is None:
            yield row
        elif up.name is not None:
            row[_UP] = up.name
            yield row
        else:
            up.waiting.append(row)


def _sweep(rows: Iterator[tuple[int, bytes, list[int]]], task: int, borders: Borders) -> Iterator[list]:
    """The finished nodes and the parts of a task's rows (conv_id, turns, chars of each).

    ``saved_tokens`` of a node is what its members' turns weigh from the node on, less what the turns of
    its nodes weigh once. Both are sums over rows: the first takes all turns of a row, the second those that
    its predecessor does not share. A node holds them for its own turn, and adds its children's as they close.
    """
    left, begun = borders.before[task], borders.begun[task]
    stack: list[_Node] = []
    previous: bytes | None = None
    for conv_id, turns, chars in rows:
        old = left if previous is None else shared_turns(previous, turns)
        if previous is not None:
            if len(previous) > old * WIDTH:
                stack[-1].leaves += 1
            yield from _closed(stack, old, task, -1)
        for d in range(len(stack), len(chars) + 1):
            if d > old:
                if stack:
                    stack[-1].children += 1
                stack.append(_Node(None))
            else:
                stack.append(_Node(begun[d]))
        for d, node in enumerate(stack):
            node.members += 1
            node.least = conv_id if node.least is None else min(conv_id, node.least)
            if d:
                node.mass += chars[d - 1]
                node.once += chars[d - 1] if d > old else 0
        stack[-1].ends.append(conv_id)
        previous = turns
    right = borders.after[task]
    if len(stack) - 1 > right:
        stack[-1].leaves += 1
    yield from _closed(stack, -1, task, right)


def prefix_trie(arrays: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``arrays`` has (conv_id, turns array of (digest, chars)). A node is named by the least id among its members.
    """
    spark = arrays.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    flat = arrays.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["chars"].cast("int")).alias("chars"))
    by = ["key", "conv_id"]
    ranged = flat.repartitionByRange(partitions, *by) if partitions else flat.repartitionByRange(*by)
    rows = durable(ranged.sortWithinPartitions(*by)).select("conv_id", "key", "chars", F.spark_partition_id().alias("task"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = task = None
        for batch in batches:
            if batch.num_rows:
                task = batch.column(1)[0].as_py()
                first = batch.column(0)[0].as_py() if first is None else first
                last = batch.column(0)[-1].as_py()
        if task is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["task", "first", "last"])

    found = rows.select("key", "task").mapInArrow(ends, "task int, first binary, last binary").orderBy("task")
    borders = spark.sparkContext.broadcast(Borders.of((r.task, bytes(r.first), bytes(r.last)) for r in found.toLocalIterator()))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (b for b in batches if b.num_rows)
        head = next(full, None)
        if head is not None:
            each = (row for b in chain([head], full) for row in zip(*(c.to_pylist() for c in b.columns[:3])))
            yield from _sent(_sweep(each, head.column(3)[0].as_py(), borders.value), _SCHEMA)

    nodes = durable(rows.mapInArrow(sweep, FIELDS))
    parts = nodes.where("begin IS NOT NULL")

    # the ids of a node in several tasks pass through one hash: its pieces in order, one at a time
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            name, digest, some = None, hashlib.sha256(), False
            for batch in batches:
                for *now, piece in zip(*(c.to_pylist() for c in batch.columns)):
                    if now != name:
                        if name is not None:
                            yield *name, digest.hexdigest()
                        name, digest, some = now, hashlib.sha256(), False
                    digest.update((("," if some else "") + piece).encode())
                    some = True
            if name is not None:
                yield *name, digest.hexdigest()

        yield from _sent(each(), pa.schema([("begin", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())]))

    pieces = parts.where("piece IS NOT NULL").select("begin", "depth", "piece", F.substring_index("piece", ",", 1).cast("long").alias("from"))
    ordered = pieces.repartition("begin", "depth").sortWithinPartitions("begin", "depth", "from").select("begin", "depth", "piece")
    digests = ordered.mapInArrow(hashed, "begin long, depth long, ends string")
    open_nodes = parts.groupBy("begin", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("up").alias("up"), *(F.sum(c).alias(c) for c in SUMS))
    whole = open_nodes.join(digests, ["begin", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())))
    columns = ["depth", "conv_id", "parent_conv_id", "up", *SUMS, "ends_sha256"]
    every = whole.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns).unionByName(nodes.where("begin IS NULL").select(columns))
    named = open_nodes.select(F.col("begin").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up_id"))
    out = every.join(named, ["up", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_id"))
    return out.select("conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256")
