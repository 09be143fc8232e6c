"""Stream state of trajectories, many of which share an entry of the state store.

A call for a key of its own costs some milliseconds of frames, whatever it does, and took most of the time of streams
that bring little for each of many trajectories. So trajectories are dealt by hash to a stated number of shards; a shard's entry
holds a text of bytes for each of its trajectories, of which only those with news are read and written anew. A trigger moves
the entries of the shards that it touches as a whole: streams that bring few trajectories at a time may take more shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shards of a stream. A checkpoint goes on with the number that it began with.
SHARDS = 4096
STATE = "ids array<string>, held array<binary>, news array<long>"
#: Rows of a frame that goes back to Spark, about.
FRAME_ROWS = 20_000

#: (trajectory, its bytes or None, its new rows by place, now or None) to its bytes and the rows to emit.
Step = Callable[[str, bytes | None, list[tuple], int | None], tuple[bytes, list[tuple]]]


def runner(step: Step, columns: list[str], names: list[str], timeout_ms: int | None) -> Callable:
    """What a shard does in a trigger. ``columns`` of a row: its trajectory, its place, and what else ``step`` gets."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, held, times = state.get if state.exists else ([], [], [])
        known = {i: (bytes(h), t) for i, h, t in zip(ids, held, times)}
        now = state.getCurrentProcessingTimeMs() if timeout_ms else None
        if timeout_ms:
            known = {i: k for i, k in known.items() if k[1] > now - timeout_ms}
        rows: dict[str, list[tuple]] = {}
        for pdf in parts:
            for r in zip(*(pdf[c].tolist() for c in columns)):
                rows.setdefault(r[0], []).append(r[1:])
        made: list[tuple] = []
        for i, mine in rows.items():
            after, out = step(i, known[i][0] if i in known else None, sorted(mine, key=lambda r: r[0]), now)
            known[i] = after, now or 0
            made += out
            if len(made) >= FRAME_ROWS:
                yield pd.DataFrame(made, columns=names, dtype=object)
                made = []
        if made:
            yield pd.DataFrame(made, columns=names, dtype=object)
        if not known:
            state.remove()
            return
        state.update((list(known), [h for h, _ in known.values()], [t for _, t in known.values()]))
        if timeout_ms:
            state.setTimeoutDuration(max(1, min(t for _, t in known.values()) + timeout_ms - now))

    return run


def by_shard(rows: DataFrame, step: Step, out: str, timeout_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """What ``step`` emits of each trajectory and trigger. rows: (instr_id, pos, ...).

    With a timeout, a trajectory that got no row for so long is dropped.
    """
    run = runner(step, rows.columns, [f.split()[0] for f in out.split(", ")], timeout_ms)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("instr_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandasWithState(run, out, STATE, "update", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")
