"""Which feature stores a task reads, from a configuration of names and paths."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.sources import matrixstore, pagefile
from trailweave.sources.annotations import resolved

Reader = Callable[[SparkSession, str], DataFrame]

#: Object stores that there are readers for.
OBJECT_STORES = ("reverie", "soon")


def parquet_store(spark: SparkSession, path: str) -> DataFrame:
    """A feature store is a Parquet table by default."""
    return spark.read.parquet(path)


def store_of(first: int | None = None, record: str = "key string, value binary") -> Reader:
    """A reader that takes a store by its path's ending: ``.matrix`` (the first columns of matrices), ``.pages`` (records), else Parquet."""

    def read(spark: SparkSession, path: str) -> DataFrame:
        if path.endswith(".matrix"):
            return matrixstore.read(spark, path, first)
        return pagefile.read(spark, path, record) if path.endswith(".pages") else parquet_store(spark, path)

    return read


class Catalog:
    """Stores by name; each is read when it is first asked for, and the same frame is given again."""

    def __init__(self, spark: SparkSession, config: dict[str, str], data_dir: str, reader: Reader = parquet_store, known: Iterable[str] | None = None):
        """``known``: names there is a reader for; others are left out silently."""
        self.spark, self.reader = spark, reader
        self.paths = {k: resolved(data_dir, v, "").rstrip("/") for k, v in config.items() if known is None or k in set(known)}
        self._frames: dict[str, DataFrame] = {}

    def __contains__(self, name: str) -> bool:
        return name in self.paths

    def store(self, name: str) -> DataFrame:
        """The store of a name; an unknown one raises."""
        if name not in self.paths:
            raise ValueError(f"no feature store {name!r}, known: {sorted(self.paths)}")
        if name not in self._frames:
            self._frames[name] = self.reader(self.spark, self.paths[name])
        return self._frames[name]


def object_catalog(spark: SparkSession, config: dict[str, str], data_dir: str, reader: Reader = parquet_store) -> Catalog:
    """The object stores of a configuration; names that are no object store are skipped."""
    return Catalog(spark, config, data_dir, reader, OBJECT_STORES)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(place, answer) of a JSON array of answers."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "answer"))


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration file, JSON or (where the YAML library is there) YAML, read by Spark so that any file system will do."""
    text = spark.read.text(path, wholetext=True).first()[0]  # one small file
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML takes the yaml library; JSON needs none") from e
    return yaml.safe_load(text)


def images(spark: SparkSession, wanted: DataFrame, folders: list[str]) -> DataFrame:
    """``wanted`` (with ``image``, a file's name) and ``content``: the file's bytes from the first of the folders that has it; null if none has."""
    found = None
    for place, folder in enumerate(folders):
        files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("image"), F.lit(place).alias("place"), "content")
        found = files if found is None else found.unionByName(files)
    best = found.join(wanted.select("image").distinct(), "image", "left_semi").groupBy("image").agg(F.min_by("content", "place").alias("content"))
    return wanted.join(best, "image", "left")


def decoded_images(spark: SparkSession, wanted: DataFrame, folders: list[str]) -> DataFrame:
    """``wanted`` (with ``image``, a file's name) and ``height``, ``width``, ``channels`` and ``pixels`` (bytes, row by row) from the first of the folders that has it.

    Decoded by Spark's image source. All are null if no folder has it, or what is there is no image.
    """
    found = None
    for place, folder in enumerate(folders):
        i = F.col("image")
        files = spark.read.format("image").load(folder).select(F.regexp_extract(i["origin"], r"([^/]+)$", 1).alias("name"), F.lit(place).alias("place"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("pixels"))
        found = files if found is None else found.unionByName(files)
    best = found.join(wanted.select(F.col("image").alias("name")).distinct(), "name", "left_semi").groupBy("name").agg(F.min_by(F.struct("height", "width", "channels", "pixels"), "place").alias("i"))
    ok = F.col("i.height") > 0
    return wanted.join(best, wanted["image"] == best["name"], "left").select(*wanted.columns, *(F.when(ok, F.col(f"i.{c}")).alias(c) for c in ("height", "width", "channels", "pixels")))


def as_text(raw: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))
