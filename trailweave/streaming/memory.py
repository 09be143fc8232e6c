"""Agents' memories as Structured Streaming state, keyed by trajectory.

State is as small as what a trajectory has seen. With a timeout, a trajectory without news is dropped;
a stream that is drained once takes none, as timeouts would keep it running. The batch form of the same state is ``operators.memory``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators.memory import UNKNOWN, GraphMemory
from trailweave.streaming.shards import SHARDS, by_shard

OUT = "user_id long, n_visits long, n_nodes long, mean_value double, last_event long"
STATE = "n long, total double, last long, nodes array<long>"


def visit_memory(events: DataFrame, nodes: int = 50, timeout_ms: int | None = None) -> DataFrame:
    """Running visits of each user: how many, to how many viewpoints, the mean value and the last event.

    events: (event_id, user_id, value); the viewpoint is the event's number modulo ``nodes``. A row is
    emitted per user and trigger, with the state after it.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last, seen = state.get if state.exists else (0, 0.0, -1, [])
        seen = set(seen)
        for pdf in parts:
            n += len(pdf)
            total += float(pdf["value"].sum())
            last = max(last, int(pdf["event_id"].max()))
            seen |= set((pdf["event_id"] % nodes).tolist())
        state.update((n, total, last, sorted(seen)))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"user_id": [key[0]], "n_visits": [n], "n_nodes": [len(seen)], "mean_value": [total / max(n, 1)], "last_event": [last]})

    rows = events.select("event_id", "user_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(run, OUT, STATE, "update", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")


GRAPH_OUT = "instr_id string, n_known long, n_visited long, total double, last long"


#: A step of a trajectory: its place, its viewpoint, the neighbours seen there and how far they are.
Step = tuple[int, int, np.ndarray, np.ndarray]


def written(steps: list[Step]) -> bytes:
    """Steps as bytes: 24 of each and 16 of each neighbour; what a viewpoint sees is kept once, as long as it sees the same."""
    known, heads, kept = {}, [], []
    for pos, node, dst, w in steps:
        old = known.get(node)
        if old is not None and np.array_equal(old[0], dst) and np.array_equal(old[1], w):
            heads += (pos, node, -1)
            continue
        heads += (pos, node, len(dst))
        kept.append((dst, w))
        known[node] = dst, w
    parts = [np.array([len(steps), *heads], np.int64), *(np.asarray(x[0], np.int64) for x in kept), *(np.asarray(x[1], np.float64) for x in kept)]
    return b"".join(x.tobytes() for x in parts)


def read(data: bytes) -> list[Step]:
    """The steps that were ``written``."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    heads = np.frombuffer(data, np.int64, 3 * n, 8).tolist()
    total = sum(max(size, 0) for size in heads[2::3])
    start = 8 + 24 * n
    dst, w = np.frombuffer(data, np.int64, total, start), np.frombuffer(data, np.float64, total, start + 8 * total)
    known, steps, at = {}, [], 0
    for pos, node, size in zip(heads[::3], heads[1::3], heads[2::3]):
        if size >= 0:
            known[node] = dst[at : at + size], w[at : at + size]
            at += size
        steps.append((pos, node, *known[node]))
    return steps


def graph_memory(observations: DataFrame, timeout_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """The whole graph memory of each trajectory as stream state: distances among viewpoints seen, relaxed step by step.

    observations: (instr_id, pos, node, nbrs array<struct<dst,w>>), a trajectory's steps in order over the
    triggers. A row is emitted per trajectory and trigger: viewpoints known and visited, the sum of the
    known distances, and the last step. State is the steps and what each saw, which grows with the walk; the matrix
    of distances, which grows with the square of what is known, is made of them anew in each trigger. Neighbours come
    and stay as arrays of numbers, and trajectories share the state's entries (``shards``).
    """

    def step(instr: str, held: bytes | None, rows: list[tuple], now: int | None) -> tuple[bytes, list[tuple]]:
        steps = (read(held) if held else []) + rows
        memory = GraphMemory()
        for pos, node, dst, w in steps:
            memory.look(node, dst.tolist(), w)
            memory.visit(node, pos)
        n = len(memory.names)
        above = np.triu(memory.d[:n, :n], 1)
        total = float(above[(above > 0) & (above < UNKNOWN)].sum())
        return written(steps), [(instr, n, len(memory.visited), total, max(s[0] for s in steps))]

    rows = observations.select("instr_id", "pos", "node", F.col("nbrs.dst").alias("dsts"), F.col("nbrs.w").alias("ws"))
    return by_shard(rows, step, GRAPH_OUT, timeout_ms, shards)


def windowed_visits(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Visits by event type and window of event time; windows close once the watermark has passed them."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drained(spark: SparkSession, stream: DataFrame, folder: str, mode: str, out: str) -> DataFrame:
    """Run a stream over all that is there now, once, and read what it wrote.

    Each micro-batch is written to its own folder, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{out}, batch int").parquet(f"{folder}/out")
