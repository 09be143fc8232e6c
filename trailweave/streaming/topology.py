"""The topology memory of trajectories as keyed stream state: one entry per viewpoint.

An entry holds the status (visited, place in the walk, first step that met it), what was last written of scene and
objects, sums of the values seen in its visits, and its links. A trajectory's entries are one text of bytes, which comes and goes
with those of others (``shards``): a call to the store for each entry took most of the time. A step changes the entries of its viewpoint
and of that one's neighbours, and those alone are emitted. Entries that get no news for ``ttl_ms`` are dropped.
"""

from __future__ import annotations

import pickle
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from trailweave.streaming.shards import SHARDS, by_shard

#: The state store that keeps states outside the executors' heap.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

OUT = "instr_id string, node long, visited boolean, traj_order long, first_seen long, s_env long, d_env long, mean double, most double, n long, n_links long"
FIELDS = ["pos", "node", "nbrs", "value", "rewrite", "scene", "thing"]
#: The values of an entry that was just met; ``links`` is a set of its own.
NEW = {"visited": False, "traj_order": None, "s_env": None, "d_env": None, "total": 0.0, "most": None, "n": 0, "news": None, "first_seen": None, "links": None}


def walked(entries: dict[int, dict], rows: pd.DataFrame | list[tuple]) -> dict[int, dict]:
    """The entries that some steps touch, changed in ``entries``.

    Rows: (instr_id, pos, node, nbrs array<long>, value, rewrite, scene, thing); the last two may be null: not written.
    As tuples they begin with pos and are in order.
    """
    if isinstance(rows, pd.DataFrame):
        rows = list(rows.sort_values("pos")[FIELDS].itertuples(index=False, name=None))
    touched: dict[int, dict] = {}
    for pos, node, nbrs, value, rewrite, scene, thing in rows:
        at = touched[node] = entries.get(node) or entries.setdefault(node, NEW | {"first_seen": pos, "links": set()})
        at["visited"], at["traj_order"] = True, pos
        if rewrite:
            at["total"], at["most"], at["n"] = 0.0, None, 0
        at["total"], at["n"] = at["total"] + value, at["n"] + 1
        at["most"] = value if at["most"] is None else max(at["most"], value)
        for field, given in (("s_env", scene), ("d_env", thing)):
            if not pd.isna(given):
                at[field] = int(given)
        nbrs = [int(to) for to in nbrs]
        for to in nbrs:
            e = entries.get(to)
            if e is None:
                e = entries[to] = NEW | {"first_seen": pos, "links": {node}}
            else:
                e["links"].add(node)
            touched[to] = e
        at["links"].update(nbrs)
    return touched


def _written(entries: dict[int, dict]) -> bytes:
    """As bytes, made and read some times faster than text."""
    return zlib.compress(pickle.dumps(entries, 5), 1)


def _read(data: bytes) -> dict[int, dict]:
    return pickle.loads(zlib.decompress(data))


def topology_memory(observations: DataFrame, ttl_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """The entries that each trigger has touched, as they are after it. ``keyed_maps`` keeps the states out of the heap."""

    def step(instr: str, held: bytes | None, rows: list[tuple], now: int | None) -> tuple[bytes, list[tuple]]:
        entries = _read(held) if held else {}
        if ttl_ms:
            entries = {node: e for node, e in entries.items() if e["news"] > now - ttl_ms}
        touched = walked(entries, rows)
        if ttl_ms:
            for e in touched.values():
                e["news"] = now
        made = [(instr, node, e["visited"], e["traj_order"], e["first_seen"], e["s_env"], e["d_env"], e["total"] / e["n"] if e["n"] else None, e["most"], e["n"], len(e["links"])) for node, e in touched.items()]
        return _written(entries), made

    return by_shard(observations.select("instr_id", *FIELDS), step, OUT, ttl_ms, shards)


class keyed_maps:  # noqa: N801
    """While it is entered, streams of the session keep their state outside the heap."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER[0], None)
        self.spark.conf.set(*PROVIDER)

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER[0])
        else:
            self.spark.conf.set(PROVIDER[0], self.before)
