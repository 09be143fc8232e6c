"""Key/value page files as a Spark data source: B+trees of fixed pages, as memory-mapped stores keep them.

A file has two copies of its head (pages 0 and 1; the one of the later transaction counts), branch pages,
leaf pages with keys in byte order, and runs of overflow pages for large values. Reading:

    spark.read.format("pagefile").schema("key string, fts array<array<float>>").load(path)

The driver reads the head and as many levels of branches as give enough subtrees; a task walks its own
subtrees. Options ``from`` and ``until`` (keys) and ``keys`` (a JSON list) leave out the subtrees, pages and
values that can't hold them. The column ``key`` is the key, ``value`` the raw value; others are fields of
the value, a MessagePack record, by name; absent ones are null.

``written`` writes a folder: a file per task, rows sorted over all tasks, and a list of the files that the driver
writes when all tasks have succeeded. What a failed attempt left is not in the list, so it is never read.
"""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trailweave.sources.records import packed, unpacked

# Fixed values of the format.
MAGIC, VERSION = 0xBEEFC0DE, 1
BRANCH, LEAF, OVERFLOW, META = 1, 2, 4, 8
BIG, PLAIN_NODE = 1, 0
NO_PAGE = 2**64 - 1
PAGE_HEAD = struct.Struct("<QHHHH")  # number, pad, flags, end of the pointers, start of the nodes
RUN_HEAD = struct.Struct("<QHHI")  # number, pad, flags, pages
NODE_HEAD = struct.Struct("<HHHH")  # low and high half of a size (leaf) or page (branch), flags, length of the key
HEAD = struct.Struct("<IIQQ")  # magic, version, address, size of the map
TREE = struct.Struct("<IHHQQQQQ")  # page size, flags, depth, branch, leaf and overflow pages, entries, root
TAIL = struct.Struct("<QQ")  # last page, transaction

PAGE, MOST_KEY = 4096, 511
LIST = "_files.json"
ROWS = 512


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, local or any that Arrow knows, and the path in it."""
    from pyarrow import fs

    plain = path[5:] if path.startswith("file:") else path
    return (fs.LocalFileSystem(), "/" + plain.lstrip("/")) if plain != path or "://" not in path else fs.FileSystem.from_uri(path)


class PageFile:
    """One open file. Only pages that are asked for are read."""

    def __init__(self, path: str):
        files, at = filesystem(path)
        self.file = files.open_input_file(at)
        first = self._head(0)
        self.page = first[0]
        self.root, self.entries = max((first, self._head(self.page)), key=lambda h: h[1])[2:]

    def _head(self, at: int) -> tuple[int, int, int, int]:
        """(page size, transaction, root, entries)."""
        raw = self.file.read_at(PAGE_HEAD.size + HEAD.size + 2 * TREE.size + TAIL.size, at)
        if len(raw) < PAGE_HEAD.size + HEAD.size + 2 * TREE.size + TAIL.size or HEAD.unpack_from(raw, PAGE_HEAD.size)[:2] != (MAGIC, VERSION):
            raise ValueError("not a page file")
        free, main = (TREE.unpack_from(raw, PAGE_HEAD.size + HEAD.size + k * TREE.size) for k in (0, 1))
        return free[0], TAIL.unpack_from(raw, PAGE_HEAD.size + HEAD.size + 2 * TREE.size)[1], main[7], main[6]

    def nodes(self, number: int) -> tuple[int, bytes, list[tuple[bytes, int, int, int, int]]]:
        """(flags, page, [(key, low, high, node flags, place of the data)])."""
        raw = self.file.read_at(self.page, number * self.page)
        _, _, flags, lower, _ = PAGE_HEAD.unpack_from(raw)
        out = []
        for (at,) in struct.iter_unpack("<H", raw[PAGE_HEAD.size : lower]):
            low, high, node, size = NODE_HEAD.unpack_from(raw, at)
            data = at + NODE_HEAD.size + size
            out.append((raw[at + NODE_HEAD.size : data], low, high, node, data))
        return flags, raw, out

    def below(self, number: int, first: bytes | None, until: bytes | None) -> list[tuple[int, bytes | None, bytes | None]] | None:
        """The pages below a branch that may hold keys of a range, each with the range of its keys; None of a leaf."""
        flags, _, nodes = self.nodes(number)
        if not flags & BRANCH:
            return None
        keys = [n[0] for n in nodes[1:]]  # the first key of a branch is empty: it stands for all lower ones
        lo = 0 if first is None else bisect_right(keys, first)
        hi = len(nodes) if until is None else bisect_left(keys, until) + 1
        return [(nodes[k][1] | nodes[k][2] << 16 | nodes[k][3] << 32, max((x for x in (first, keys[k - 1] if k else None) if x is not None), default=None), min((x for x in (until, keys[k] if k < len(keys) else None) if x is not None), default=None)) for k in range(lo, hi)]

    def entries_of(self, number: int, first: bytes | None, until: bytes | None) -> Iterator[tuple[bytes, bytes]]:
        """(key, value) below a page, from ``first`` and before ``until``."""
        pages = self.below(number, first, until)
        if pages is not None:
            for page, a, b in pages:
                yield from self.entries_of(page, a, b)
            return
        _, raw, nodes = self.nodes(number)
        for key, low, high, flags, at in nodes:
            if (first is None or key >= first) and (until is None or key < until):
                size = low | high << 16
                if flags & ~BIG:
                    raise ValueError("stores in a store, and several values of a key, are not read")
                if flags & BIG:
                    start = struct.unpack_from("<Q", raw, at)[0] * self.page + RUN_HEAD.size
                    yield key, self.file.read_at(size, start)
                else:
                    yield key, raw[at : at + size]

    def subtrees(self, least: int, first: bytes | None, until: bytes | None) -> list[tuple[int, bytes | None, bytes | None]]:
        """Roots of subtrees that hold a range of keys: ``least`` at least, if the tree has so many."""
        if self.root == NO_PAGE:
            return []
        now = [(self.root, first, until)]
        while len(now) < least:
            deeper = [self.below(*x) for x in now]
            if any(x is None for x in deeper):  # leaves are all on one level
                break
            now = [x for pages in deeper for x in pages]
        return now


def _files(path: str) -> list[str]:
    """The files of a folder by its list, else its one data file; or the path itself."""
    from pyarrow import fs

    files, at = filesystem(path)
    if files.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    if files.get_file_info(f"{at}/{LIST}").type == fs.FileType.File:
        with files.open_input_stream(f"{at}/{LIST}") as f:
            return [f"{path}/{x['file']}" for x in json.loads(f.read())]
    return [f"{path}/data.mdb"]


@dataclass
class Subtrees(InputPartition):
    path: str
    roots: list[tuple[int, bytes | None, bytes | None]]


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        bound = lambda name: options[name].encode() if name in options else None
        self.first, self.until = bound("from"), bound("until")
        self.keys = sorted({k.encode() for k in json.loads(options["keys"])}) if "keys" in options else None
        self.tasks = int(options.get("tasks", 32))

    def partitions(self) -> list[InputPartition]:
        if self.keys is not None:
            self.first = max(x for x in (self.first, self.keys[0] if self.keys else b"") if x is not None)
            last = self.keys[-1] + b"\0" if self.keys else b""
            self.until = last if self.until is None else min(self.until, last)
        paths = _files(self.path)
        out = []
        for path in paths:
            roots = PageFile(path).subtrees(-(-self.tasks // len(paths)), self.first, self.until)
            if self.keys is not None:
                roots = [r for r in roots if self._held(r[1], r[2])]
            size = max(1, -(-len(roots) * len(paths) // self.tasks))
            out += [Subtrees(path, roots[k : k + size]) for k in range(0, len(roots), size)]
        return out

    def _held(self, first: bytes | None, until: bytes | None) -> list[bytes]:
        """The asked keys within a range."""
        return self.keys[bisect_left(self.keys, first or b"") : len(self.keys) if until is None else bisect_left(self.keys, until)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none to read
            return
        form = to_arrow_schema(self.schema)
        fields, rows, file = [f for f in form.names if f not in ("key", "value")], [], PageFile(partition.path)
        for root, first, until in partition.roots:
            ranges = [(first, until)] if self.keys is None else [(k, k + b"\0") for k in self._held(first, until)]
            for a, b in ranges:
                for key, value in file.entries_of(root, a, b):
                    record = unpacked(value) if fields else {}
                    rows.append({"key": key if pa.types.is_binary(form.field("key").type) else key.decode(), **{f: record.get(f) for f in fields}} | ({"value": value} if "value" in form.names else {}))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, form)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, form)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Pages:
    """Pages of a file being written, in a spool of the task until their number is known."""

    def __init__(self) -> None:
        self.spool, self.number, self.counts = tempfile.TemporaryFile(), 2, {BRANCH: 0, LEAF: 0, OVERFLOW: 0}  # noqa: SIM115

    def add(self, kind: int, nodes: list[bytes]) -> int:
        """A page of nodes; its number."""
        at, pointers, body = PAGE, [], b""
        for node in nodes:
            at -= len(node)
            pointers.append(at)
            body = node + body
        lower = PAGE_HEAD.size + 2 * len(nodes)
        head = PAGE_HEAD.pack(self.number, 0, kind, lower, at) + struct.pack(f"<{len(nodes)}H", *pointers)
        self.spool.write(head + bytes(at - lower) + body)
        self.counts[kind] += 1
        self.number += 1
        return self.number - 1

    def run(self, value: bytes) -> int:
        """A large value on pages of its own; the first one's number."""
        pages, first = -(-(RUN_HEAD.size + len(value)) // PAGE), self.number
        self.spool.write((RUN_HEAD.pack(first, 0, OVERFLOW, pages) + value).ljust(pages * PAGE, b"\0"))
        self.counts[OVERFLOW] += pages
        self.number += pages
        return first


def _even(node: bytes) -> bytes:
    return node + bytes(len(node) % 2)


def _load(rows: Iterator[tuple[bytes, bytes]], path: str) -> int:
    """Write a file of rows in order of their keys; how many."""
    pages, n, last = _Pages(), 0, None
    room = PAGE - PAGE_HEAD.size
    page: list[bytes] = []
    used, first = 0, b""
    level: list[tuple[bytes, int]] = []
    for key, value in rows:
        if not key or len(key) > MOST_KEY:
            raise ValueError(f"a key must have 1 to {MOST_KEY} bytes, not {len(key)}")
        if last is not None and key <= last:
            raise ValueError(f"keys must be distinct and in order: {key!r} after {last!r}")
        last = key
        big = NODE_HEAD.size + len(key) + len(value) > room // 2 - 2
        held = struct.pack("<Q", pages.run(value)) if big else value
        node = _even(NODE_HEAD.pack(len(value) & 0xFFFF, len(value) >> 16, BIG if big else PLAIN_NODE, len(key)) + key + held)
        if page and used + len(node) + 2 > room:
            level.append((first, pages.add(LEAF, page)))
            page, used = [], 0
        first = first if page else key
        page.append(node)
        used += len(node) + 2
        n += 1
    if page:
        level.append((first, pages.add(LEAF, page)))
    depth = 1 if level else 0
    while len(level) > 1:
        above: list[tuple[bytes, int]] = []
        page, used = [], 0
        for key, number in level:
            short = key if page else b""
            node = _even(NODE_HEAD.pack(number & 0xFFFF, number >> 16 & 0xFFFF, number >> 32, len(short)) + short)
            if page and used + len(node) + 2 > room:
                above.append((first, pages.add(BRANCH, page)))
                node, page, used = _even(NODE_HEAD.pack(number & 0xFFFF, number >> 16 & 0xFFFF, number >> 32, 0)), [], 0
            first = first if page else key
            page.append(node)
            used += len(node) + 2
        above.append((first, pages.add(BRANCH, page)))
        level, depth = above, depth + 1
    files, at = filesystem(path)
    with files.open_output_stream(at) as out:
        for k in (0, 1):
            trees = TREE.pack(PAGE, 0, 0, 0, 0, 0, 0, NO_PAGE) + TREE.pack(0, 0, depth, *(pages.counts[x] for x in (BRANCH, LEAF, OVERFLOW)), n, level[0][1] if level else NO_PAGE)
            head = PAGE_HEAD.pack(k, 0, META, 0, 0) + HEAD.pack(MAGIC, VERSION, 0, pages.number * PAGE) + trees + TAIL.pack(pages.number - 1, k)
            out.write(head.ljust(PAGE, b"\0"))
        pages.spool.seek(0)
        while part := pages.spool.read(1 << 20):
            out.write(part)
    pages.spool.close()
    return n


class PageWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.fields = options["path"], [f for f in schema.names if f != "key"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        name = f"part-{uuid.uuid4().hex}.mdb"
        files, at = filesystem(self.path)
        files.create_dir(at, recursive=True)
        raw = self.fields == ["value"]
        rows = ((r["key"].encode() if isinstance(r["key"], str) else bytes(r["key"]), bytes(r["value"]) if raw else packed({f: _plain(r[f]) for f in self.fields})) for r in iterator)
        n = _load(rows, f"{self.path}/{name}")
        return Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at = filesystem(self.path)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{LIST}") as out:
            out.write(json.dumps([{"file": m.file, "rows": m.rows} for m in messages if m and m.rows]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at = filesystem(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{at}/{m.file}")


def _plain(value: object) -> object:
    """Rows as maps."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagefile"

    def schema(self) -> str:
        return "key string, value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PageWriter(schema, dict(self.options))


def read(spark: SparkSession, path: str, schema: str = "key string, value binary", **options: str) -> DataFrame:
    """All records of a file or folder; ``options``: from_, until, keys, tasks."""
    spark.dataSource.register(PageSource)
    given = {k.rstrip("_"): json.dumps(v) if k == "keys" else str(v) for k, v in options.items()}
    return spark.read.format("pagefile").schema(schema).options(**given).load(path)


def written(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write (key, value binary) or (key, fields...) to a new folder of ``files`` files, or as many as suits the size; keys are distinct."""
    df.sparkSession.dataSource.register(PageSource)
    ranged = df.repartitionByRange(files, "key") if files else df.repartitionByRange("key")
    ranged.sortWithinPartitions("key").write.format("pagefile").mode("append").save(path)
