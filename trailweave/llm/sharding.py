"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (a start and a stride taken
from two hashes of its name). The shards take turns, each claiming the first slot of its permutation
that is still free, until the table is full. A row goes to the shard that owns slot
``hash(key) mod size``: one hash and one look-up, whatever the number of shards. All shards own
nearly the same number of slots, and when a shard comes or goes few slots change hands.

The table has ``size`` rows by construction, whatever the data, so broadcasting it is safe. Rows are
placed by DataFrame operators only; placing does not shuffle them.

Defined cases: null key columns hash as a marker of their own, so null, the empty text and missing
values are three different keys and rows with null keys all share a shard; an empty table gives an
empty result; columns of the input with the names of the result's are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime: far more slots than shards keep the shares even.
TABLE_SIZE = 65_537
#: Hex digits of the key's MD5 that choose the slot: 60 bits, a non-negative long.
KEY_DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:KEY_DIGITS], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """slot -> index of the owning shard; runs on the driver in time proportional to the slots claimed.

    The order of ``shards`` is their order of turns. ``size`` must be a prime not below their number.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < max(2, len(shards)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime not below the number of shards")
    at = [_number(f"start:{s}") % size for s in shards]
    stride = [_number(f"stride:{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    left = size
    while left:
        for k in range(len(shards)):
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + stride[k]) % size
            owner[slot] = k
            at[k] = (slot + stride[k]) % size
            left -= 1
            if not left:
                break
    return owner


def key_text(keys: list[str]) -> Column:
    """The key columns as one text; null differs from every value."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for k in keys))


def slot_of(keys: list[str], size: int = TABLE_SIZE) -> Column:
    """The slot of a row: the first 60 bits of the key's MD5, modulo the table's size."""
    digits = F.substring(F.md5(key_text(keys)), 1, KEY_DIGITS)
    return (F.conv(digits, 16, 10).cast("long") % F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as ``size`` rows (slot, shard): one literal that is exploded, no local data."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    names = F.array(*(F.lit(s) for s in shards))
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
        .select("slot", F.col("owner").cast("int").alias("shard"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard_name"))
    )


def assign_shards(df: DataFrame, keys: list[str], shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The input with ``slot``, ``shard`` (index) and ``shard_name``.

    A key that holds many rows puts them on one shard, as a placement by key must; choose keys that
    are unique (a document's id) where even shards matter.
    """
    placed = df.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(keys, size))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard. Rows need no shuffle: each task adds its own file to every shard it holds."""
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
