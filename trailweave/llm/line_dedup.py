"""Line dedup: chunks of lines with content-defined borders; repeated ones go, but for the first.

Lines without a word don't count for borders. Where a mixed rolling hash over the hashes of the last ``WINDOW``
lines is less than at the lines before and after, a chunk ends; what lies between two such ends is cut into
twos, the last being two or three. Ends are never next to each other, so every chunk has two lines with a
word and counts, unless its document has no more than one; and they depend on nearby lines only, so a passage
is cut alike wherever it stands, but for the lines about its two edges. For these a text is cut in
``CUTTINGS`` ways, each by a hash mixed differently: a line counts as repeated if any way has it in a
repeated chunk.

1. Every chunk gives a row with its 128-bit hash and place. Hashes that occur twice are repeated; the
   occurrence with the smallest (id, row, place) is the first and stays.
2. Occurrences learn of that by a join on the hash: the ``HOT_CHUNKS`` most frequent hashes are broadcast,
   so that what is left has none with more than 1 / HOT_CHUNKS of all rows.
3. The bytes are compared: of all chunks with one hash the least and the greatest text must be the same,
   an aggregation that keeps two texts a hash on the map side. A hash that two texts share removes nothing.
4. All other occurrences are cut out of their documents. Both joins with the texts use one exchange.

A removed line has an equal line at an earlier (id, row, place), so at least the first of it is left.

Defined cases: a null text stays null and an empty one empty; a document that loses every line is
empty; null ids come after all others; rows with the same id come by hashes of their texts; of rows that
repeat id and text one counts as the first and the others lose what is repeated; an empty table gives an
empty result; other columns stay out (``deduplicated`` keeps them), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import durable, whole_text

WINDOW = 2
LEAST_LINES = 2
#: In how many ways a text is cut.
CUTTINGS = 6
#: Hashes that are broadcast, the most frequent first: so many rows of some 100 bytes at any scale.
HOT_CHUNKS = 1000
SALTS = 64
_WHITE = " \t\n\v\f\r"
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(1).integers(1, 1 << 63, CUTTINGS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _rolled(lines: list[str]) -> np.ndarray:
    """The rolling hash over the last WINDOW lines at each line."""
    h = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], dtype=np.uint64)
    out = h.copy()
    for back in range(1, min(WINDOW, len(h))):
        out[back:] = out[back:] + h[:-back] * _PRIME**_U(back)
    return out


def _ends(value: np.ndarray) -> list[bool]:
    """Where the value is less than on both sides."""
    out = np.zeros(len(value), bool)
    if len(value) > 2:
        out[1:-1] = (value[1:-1] < value[:-2]) & (value[1:-1] <= value[2:])
    return out.tolist()


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk that counts, of all cuttings together, in order."""
    worded = [k for k, x in enumerate(lines) if x.strip(_WHITE)]
    n = len(worded)
    if n < LEAST_LINES:
        return []
    rolled, found = _rolled([lines[k] for k in worded]), set()
    for seed in _SEEDS:
        ends, start, held = _ends(_mixed(rolled ^ seed)), 0, 0
        for k in range(n - LEAST_LINES):
            held += 1
            if held >= LEAST_LINES and (ends[k] or not ends[k + 1]):
                found.add((start, worded[k] + 1))
                start, held = worded[k] + 1, 0
        found.add((start, len(lines)))
    return sorted(found)


def candidates(lines: list[str]) -> list[tuple[int, int, bytes]]:
    """(first line, line after the last, text in UTF-8) of the chunks that count."""
    return [(a, b, "\n".join(lines[a:b]).encode("utf-8", "surrogatepass")) for a, b in chunks(lines)]


def _rows(df: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """(r1, r2, id, text, rest): r1 and r2 are hashes of id and text, by which a row's parts find each other again."""
    text = whole_text(text_col)
    others = F.struct(*(F.col(c) for c in rest)) if rest else F.lit(0)
    return df.select(F.xxhash64(id_col, text).alias("r1"), F.xxhash64(F.lit(1), text, id_col).alias("r2"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), others.alias("rest"))


def _places(rows: DataFrame, id_type: str) -> DataFrame:
    """(r1, r2, id, at, hash): the first line and the hash of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, at, digest = [], [], []
            for k, cell in enumerate(batch.column(3)):
                for a, _, data in candidates((cell.as_py() or "").split("\n")):
                    source.append(k)
                    at.append(a)
                    digest.append(xxhash.xxh3_128_digest(data))
            taken = pa.array(source, pa.int64())
            columns = [*(batch.column(k).take(taken) for k in range(3)), pa.array(at, pa.int32()), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["r1", "r2", "id", "at", "hash"])

    return rows.select("r1", "r2", "id", "text").mapInArrow(run, f"r1 long, r2 long, id {id_type}, at int, hash binary")


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """(r1, r2, hash, kept_at): the repeated hashes of each row; kept_at is the line of the first occurrence, -1 if that is elsewhere."""
    each = durable(_places(rows, rows.schema["id"].dataType.simpleString()))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2", "at")).alias("first")
    groups = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    groups = durable(groups.select(F.col("hash").alias("h"), "n", "first.r1", "first.r2", "first.at").toDF("h", "n", "f1", "f2", "first_at"))
    hot = F.broadcast(groups.orderBy(F.desc("n"), "h").limit(HOT_CHUNKS))
    same = F.col("hash") == F.col("h")
    found = each.join(hot, same).unionByName(each.join(hot, same, "left_anti").join(groups, same))
    mine = (F.col("r1") == F.col("f1")) & (F.col("r2") == F.col("f2"))
    return durable(found.select("r1", "r2", "hash", F.when(mine, F.col("first_at")).otherwise(-1).alias("kept_at")))


def _of_rows(found: DataFrame, values: str) -> DataFrame:
    return found.groupBy(F.col("r1").alias("s1"), F.col("r2").alias("s2")).agg(F.expr(f"collect_set({values})").alias("repeated"))


def _met(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Rows with their lists; takes all columns along, so that the texts' exchange is the same in every join."""
    joined = rows.join(lists, (F.col("r1") == F.col("s1")) & (F.col("r2") == F.col("s2")), how)
    return joined.select("r1", "r2", "id", "text", "rest", "repeated")


def unequal_chunks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(hash) that two different chunks share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_hash = []
            for cell, wanted in zip(batch.column(3), batch.column(5)):
                held = set(wanted.as_py())
                own = ((xxhash.xxh3_128_digest(data), data) for _, _, data in candidates((cell.as_py() or "").split("\n")))
                of_hash += {x for x in own if x[0] in held}
            columns = list(zip(*of_hash)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["hash", "chunk"])

    texts = _met(rows, _of_rows(found, "hash"), "inner").mapInArrow(run, "hash binary, chunk binary")
    return texts.groupBy("hash").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("least <> most").select("hash")


def without(lines: list[str], kept_at: dict[bytes, int], again: bool = False) -> tuple[list[str], int]:
    """The lines left and the number of chunks cut: all repeated ones but those that stand where ``kept_at`` says.

    ``again``: the row was there before, so that nothing of it is the first.
    """
    drop: set[int] = set()
    cut = 0
    for a, b, data in candidates(lines):
        at = kept_at.get(xxhash.xxh3_128_digest(data))
        if at is not None and (again or at != a):
            drop.update(range(a, b))
            cut += 1
    return [x for k, x in enumerate(lines) if k not in drop], cut


def _left(text: str | None, repeated: list[dict] | None, copy: int) -> tuple[int, int, int, str | None]:
    """(lines, lines cut, chunks cut, text left)."""
    lines = text.split("\n") if text else []
    kept, cut = without(lines, {x["hash"]: x["kept_at"] for x in repeated}, copy > 1) if repeated else (lines, 0)
    return len(lines), len(lines) - len(kept), cut, "\n".join(kept) if text else text


def _judged(df: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """(id, text, rest, repeated, copy) of every row; copy numbers rows that repeat id and text."""
    rows = _rows(df, id_col, text_col, rest)
    found = repeated_chunks(rows)
    # dealt by row as well, as a hash may be very frequent; what it is joined with is next to nothing
    unequal = unequal_chunks(rows, found).select(F.col("hash").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    sure = found.join(unequal, (F.col("hash") == F.col("h")) & (F.pmod("r1", F.lit(SALTS)) == F.col("s")), "left_anti")
    met = _met(rows, _of_rows(sure, "struct(hash, kept_at)"), "left")
    return met.withColumn("copy", F.row_number().over(Window.partitionBy("r1", "r2").orderBy("r1"))).select("id", "text", "rest", "repeated", "copy")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed_lines, n_removed_chunks, text) of every row; ``text`` is what is left."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_left(t.as_py(), x.as_py(), c) for t, x, c in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist())]
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=[id_col, "n_lines", "n_removed_lines", "n_removed_chunks", "text"],
            )

    judged = _judged(df, id_col, text_col, []).select("id", "text", "repeated", "copy")
    return judged.mapInArrow(run, f"`{id_col}` {kind}, n_lines long, n_removed_lines long, n_removed_chunks long, text string")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with what is left of each text."""
    rest = [c for c in df.columns if c not in (id_col, text_col)]

    @F.pandas_udf("string")
    def left(text: pd.Series, repeated: pd.Series, copy: pd.Series) -> pd.Series:
        # all rows come here, those without repeated chunks too
        return pd.Series([t if x is None else _left(t, list(x), c)[3] for t, x, c in zip(text, repeated, copy)], dtype=object)

    judged = _judged(df, id_col, text_col, rest)
    changed = F.when(F.col("repeated").isNull(), F.col("text")).otherwise(left("text", "repeated", "copy"))
    made = judged.select(F.col("id").alias(id_col), changed.alias(text_col), *(F.col("rest")[c].alias(c) for c in rest))
    return made.select(*(F.col(f"`{c}`") for c in df.columns))
