"""Spatial navigation graphs: edges, symmetry, all-pairs shortest distances and paths.

A graph is keyed by ``scan``; nodes are (scan, vp, x, y, z) and edges (scan, src, dst, w), both ways.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from trailweave.sources.durable import durable
from trailweave.sources.spread import spread

#: A scan is one building: its matrix of nodes x nodes must fit a task. More nodes are an error, not a cut.
MOST_NODES = 6000


def translation(pose: str) -> list:
    """x, y, z of a row-major 4x4 pose given as 16 numbers."""
    return [F.element_at(pose, k).alias(a) for k, a in ((4, "x"), (8, "y"), (12, "z"))]


def connectivity_edges(connectivity: DataFrame) -> DataFrame:
    """Edges from rows (scan, pos, vp, included, unobstructed array<boolean>, x, y, z).

    ``unobstructed[k]`` speaks of the scan's node at position k. Both ends must be included. One
    ordinal join, no comparison of all pairs.
    """
    able = connectivity.where("included")
    seen = able.select("scan", F.col("vp").alias("src"), *(F.col(c).alias(f"{c}a") for c in "xyz"), F.posexplode("unobstructed").alias("pos", "open")).where("open")
    far = able.select("scan", "pos", F.col("vp").alias("dst"), "x", "y", "z")
    w = F.sqrt(sum((F.col(c) - F.col(f"{c}a")) * (F.col(c) - F.col(f"{c}a")) for c in "xyz"))
    return seen.join(far, ["scan", "pos"]).where("src <> dst").select("scan", "src", "dst", w.alias("w"))


def checked_symmetric(edges: DataFrame) -> DataFrame:
    """The edges; a row whose reverse is missing raises when it is read."""
    back = edges.select("scan", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_back")).distinct()
    joined = edges.join(back, ["scan", "src", "dst"], "left")
    ok = F.when(F.col("_back"), F.col("w")).otherwise(F.raise_error(F.concat(F.lit("graph is not symmetric at "), F.col("src").cast("string"))).cast("double"))
    return joined.select("scan", "src", "dst", ok.alias("w"))


def radius_edges(nodes: DataFrame, radius: float) -> DataFrame:
    """Both directions of every pair of a scan's nodes closer than ``radius``.

    A range join as an equi-join: nodes fall into cells as wide as the radius, and each node is sent to
    its cell and the 26 around it.
    """
    cell = {c: F.floor(F.col(c) / radius).cast("int") for c in "xyz"}
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    a = nodes.select("scan", F.col("vp").alias("src"), *(F.col(c).alias(f"{c}a") for c in "xyz"), *(cell[c].alias(f"c{c}") for c in "xyz"))
    for c in "xyz":
        a = a.withColumn(f"d{c}", F.explode(near)).withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"d{c}")).drop(f"d{c}")
    b = nodes.select("scan", F.col("vp").alias("dst"), "x", "y", "z", *(cell[c].alias(f"c{c}") for c in "xyz"))
    w = F.sqrt(sum((F.col(f"{c}a") - F.col(c)) * (F.col(f"{c}a") - F.col(c)) for c in "xyz"))
    pairs = a.join(b, ["scan", "cx", "cy", "cz"]).withColumn("w", w)
    return pairs.where((F.col("src") != F.col("dst")) & (F.col("w") < radius)).select("scan", "src", "dst", "w")


def weights(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, weights with inf for absent) of one scan's edges; rows with a null ``dst`` are lone nodes."""
    nodes = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].dropna().to_numpy().astype(pdf["src"].dtype)]))
    if len(nodes) > MOST_NODES:
        raise ValueError(f"a scan has {len(nodes)} nodes; more than {MOST_NODES} need min_plus_distances, or distances for both kinds")
    w = np.full((len(nodes), len(nodes)), np.inf)
    np.fill_diagonal(w, 0.0)
    real = pdf["dst"].notna().to_numpy()
    a, b = np.searchsorted(nodes, pdf["src"].to_numpy()[real]), np.searchsorted(nodes, pdf["dst"].to_numpy()[real])
    np.minimum.at(w, (a, b), pdf["w"].to_numpy()[real])
    return nodes, w


def relaxed(w: np.ndarray) -> np.ndarray:
    """Shortest distances from weights."""
    d = w.copy()
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    return d


def _with_lone(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    rows = edges.select("scan", "src", "dst", "w")
    if nodes is None:
        return rows
    return rows.unionByName(nodes.select("scan", F.col("vp").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"), F.lit(None).cast("double").alias("w")))


def shortest_distances(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(scan, src, dst, d) of all pairs that are connected, each node with itself included.

    One task per scan relaxes the whole matrix by vector operations.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, w = weights(pdf)
        d = relaxed(w)
        a, b = np.nonzero(np.isfinite(d))
        return pd.DataFrame({"scan": pdf["scan"].iloc[0], "src": ids[a], "dst": ids[b], "d": d[a, b]})

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return _with_lone(edges, nodes).groupBy("scan").applyInPandas(run, f"scan {kinds['scan']}, src {kinds['src']}, dst {kinds['dst']}, d double")


def shortest_paths(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(scan, src, dst, d, hops, path array): nodes from src to dst.

    Of equally short ways the one whose last step comes from the smallest node is taken, at each step.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, w = weights(pdf)
        d = relaxed(w)
        step = w.copy()
        np.fill_diagonal(step, np.inf)
        before = np.full(d.shape, -1)
        for t in range(len(ids)):
            via = d + step[:, t][None, :]  # by way of each neighbour of t
            best = via.min(axis=1)
            before[:, t] = np.argmax(via <= best[:, None] + 1e-12, axis=1)
        out = []
        for a, b in zip(*np.nonzero(np.isfinite(d))):
            way, at = [b], b
            while at != a:
                at = before[a, at]
                way.append(at)
            out.append((ids[a], ids[b], d[a, b], len(way) - 1, ids[way[::-1]].tolist()))
        made = pd.DataFrame(out, columns=["src", "dst", "d", "hops", "path"])
        made.insert(0, "scan", pdf["scan"].iloc[0])
        return made

    return _with_lone(edges, nodes).groupBy("scan").applyInPandas(
        run, f"scan {kinds['scan']}, src {kinds['src']}, dst {kinds['dst']}, d double, hops long, path array<{kinds['src']}>"
    )


#: Nodes of a block: the distances between two blocks' nodes are a tile, and a task holds three tiles at most.
BLOCK_NODES = 512


def _through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least ways from a's rows to b's columns by way of what lies between."""
    out = np.full((a.shape[0], b.shape[1]), np.inf)
    for k in range(a.shape[1]):
        np.minimum(out, a[:, k, None] + b[None, k], out=out)
    return out


def _as_tile(row: object, name: str, i: str, j: str) -> np.ndarray:
    return np.frombuffer(getattr(row, name)).reshape(getattr(row, i), getattr(row, j))


def _on_tiles(rows: DataFrame, make: Callable[[object], np.ndarray], kind: str) -> DataFrame:
    """Tiles made of rows that have one or more: a group is one row, so that a task never holds a batch of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = next(pdf.itertuples(index=False))
        return pdf[["scan", "parts", "i", "j", "ni", "nj"]].assign(t=[np.ascontiguousarray(make(r)).tobytes()])

    return rows.groupBy("scan", "i", "j").applyInPandas(run, f"scan {kind}, parts long, i long, j long, ni long, nj long, t binary")


def min_plus_distances(edges: DataFrame, nodes: DataFrame, block: int = BLOCK_NODES) -> DataFrame:
    """The same distances for scans too large for a task, by joins of tiles.

    A scan's nodes are dealt by hash to blocks of some ``block`` nodes; a tile holds the distances from a block's nodes
    to another's. The blocks are passed through one after another, as Floyd's rule passes through nodes: the block's
    own tile is relaxed, then the tiles of its row and column through it, then all others through those two. A round is
    two joins of tiles and ends in a checkpoint; there are as many as the largest scan has blocks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    edges = durable(edges.select("scan", "src", "dst", "w"))
    ends = nodes.select("scan", "vp").unionByName(edges.select("scan", F.col("src").alias("vp"))).unionByName(edges.select("scan", F.col("dst").alias("vp"))).distinct()
    parts = ends.groupBy("scan").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"))
    dealt = ends.join(parts, "scan").withColumn("b", F.pmod(F.xxhash64("vp"), "parts"))
    blocks = durable(dealt.groupBy("scan", "parts", "b").agg(F.array_sort(F.collect_list("vp")).alias("ids")))
    at = blocks.select("scan", "parts", "b", F.size("ids").cast("long").alias("n"), F.posexplode("ids").alias("k", "vp"))
    one, two = (at.select("scan", *(["parts"] if m == "i" else []), F.col("b").alias(m), F.col("n").alias(f"n{m}"), F.col("k").alias(f"k{m}"), F.col("vp").alias(c)) for m, c in (("i", "src"), ("j", "dst")))
    same = at.select("scan", "parts", F.col("b").alias("i"), F.col("n").alias("ni"), F.col("k").alias("ki"), F.col("b").alias("j"), F.col("n").alias("nj"), F.col("k").alias("kj"), F.lit(0.0).alias("w"))
    cells = same.unionByName(edges.join(one, ["scan", "src"]).join(two, ["scan", "dst"]).drop("src", "dst"))

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1]
        t = np.full((int(first["ni"].iloc[0]), int(first["nj"].iloc[0])), np.inf)
        np.minimum.at(t, (pdf["ki"].to_numpy(), pdf["kj"].to_numpy()), pdf["w"].to_numpy())
        return first[["scan", "parts", "i", "j", "ni", "nj"]].assign(t=[t.tobytes()])

    tiles = durable(cells.groupBy("scan", "i", "j").applyInPandas(filled, f"scan {kinds['scan']}, parts long, i long, j long, ni long, nj long, t binary"))
    made = []  # tiles of scans whose blocks have all been passed through
    for k in range(blocks.agg(F.max("parts")).first()[0] or 0):
        here = tiles.where((F.col("i") == k) & (F.col("j") == k))
        pivot = durable(_on_tiles(here, lambda r: relaxed(_as_tile(r, "t", "ni", "nj")), kinds["scan"]))
        made.append(pivot.where(F.col("parts") == 1))
        tiles = tiles.where(F.col("parts") > 1)
        if not tiles.limit(1).count():
            break
        by = pivot.where(F.col("parts") > 1).select("scan", F.col("t").alias("p"), F.col("ni").alias("np"))
        into = _on_tiles(tiles.where((F.col("j") == k) & (F.col("i") != k)).join(by, "scan"), lambda r: _through(_as_tile(r, "t", "ni", "nj"), _as_tile(r, "p", "np", "np")), kinds["scan"])
        out = _on_tiles(tiles.where((F.col("i") == k) & (F.col("j") != k)).join(by, "scan"), lambda r: _through(_as_tile(r, "p", "np", "np"), _as_tile(r, "t", "ni", "nj")), kinds["scan"])
        into, out = durable(into), durable(out)
        a = into.select("scan", "parts", "i", "ni", F.col("nj").alias("nk"), F.col("t").alias("a"))
        pairs = a.join(out.select("scan", "j", "nj", F.col("t").alias("b")), "scan")
        rest = tiles.where((F.col("i") != k) & (F.col("j") != k)).select("scan", "parts", "i", "j", "ni", "nj", "t")
        met = pairs.join(rest, ["scan", "parts", "i", "j", "ni", "nj"], "full")

        def better(r: object) -> np.ndarray:
            if r.a is None:
                return _as_tile(r, "t", "ni", "nj")
            way = _through(_as_tile(r, "a", "ni", "nk"), _as_tile(r, "b", "nk", "nj"))
            return way if r.t is None else np.minimum(way, _as_tile(r, "t", "ni", "nj"))

        met = met.withColumn("nk", F.coalesce("nk", F.lit(0).cast("long")))  # whole numbers, so that pandas has no floats of them
        tiles = durable(reduce(DataFrame.unionByName, [pivot.where(F.col("parts") > 1), into, out, _on_tiles(met, better, kinds["scan"])]))
        over = tiles.where(F.col("parts") == k + 1)
        made.append(over)
        tiles = tiles.where(F.col("parts") > k + 1)
    ids = lambda m: blocks.select("scan", F.col("b").alias(m), F.col("ids").alias(f"{m}ids"))

    def unfolded(pdf: pd.DataFrame) -> pd.DataFrame:
        r = next(pdf.itertuples(index=False))
        t = _as_tile(r, "t", "ni", "nj")
        a, b = np.nonzero(np.isfinite(t))
        return pd.DataFrame({"scan": r.scan, "src": np.asarray(r.iids)[a], "dst": np.asarray(r.jids)[b], "d": t[a, b]})

    every = reduce(DataFrame.unionByName, made) if made else tiles
    return every.join(ids("i"), ["scan", "i"]).join(ids("j"), ["scan", "j"]).groupBy("scan", "i", "j").applyInPandas(unfolded, f"scan {kinds['scan']}, src {kinds['src']}, dst {kinds['dst']}, d double")


def _large(nodes: DataFrame, most: int) -> DataFrame | None:
    """(scan) of more than ``most`` nodes; None if there is none."""
    large = nodes.groupBy("scan").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("scan")
    return large if large.limit(1).count() else None


def distances(edges: DataFrame, nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(scan, src, dst, d) for scans of any size: those of up to ``most`` nodes by ``shortest_distances``, larger ones by joins."""
    large = _large(nodes, most)
    if large is None:
        return shortest_distances(edges, nodes)
    part = lambda df, how: df.join(large, "scan", how)
    small = shortest_distances(part(edges, "left_anti"), part(nodes, "left_anti"))
    return small.unionByName(min_plus_distances(part(edges, "left_semi"), part(nodes, "left_semi")))


def paths(edges: DataFrame, nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(scan, src, dst, d, hops, path) of all pairs for scans of any size, larger ones by labels that spread from every node."""
    large = _large(nodes, most)
    if large is None:
        return shortest_paths(edges, nodes)
    part = lambda df, how: df.join(large, "scan", how)
    ends = part(nodes, "left_semi").select("scan", F.col("vp").alias("src"))
    every = ends.join(ends.withColumnRenamed("src", "dst"), "scan")  # the pairs of a scan are what is asked for
    small = shortest_paths(part(edges, "left_anti"), part(nodes, "left_anti"))
    return small.unionByName(_asked_by_joins(part(edges, "left_semi"), every))


#: Edges of a scan up to which one task holds them all; of more, rows are relaxed by joins. Scores of one block of sources.
MOST_EDGES = 2_000_000
BLOCK = 4_000_000


class _Relaxed:
    """A scan's edges, and least distances from some of its nodes to all."""

    def __init__(self, steps: pd.DataFrame, sources: np.ndarray):
        order = np.lexsort((steps["src"].to_numpy(), steps["dst"].to_numpy()))
        src, dst, self.w = (steps[c].to_numpy()[order] for c in ("src", "dst", "w"))
        self.names = np.unique(np.concatenate([src, dst, sources]))
        self.src, self.dst = np.searchsorted(self.names, src), np.searchsorted(self.names, dst)
        self.first = np.flatnonzero(np.r_[True, self.dst[1:] != self.dst[:-1]]) if len(src) else np.zeros(0, int)
        self.rows = {s: k for k, s in enumerate(sources.tolist())}
        self.d = np.full((len(sources), len(self.names)), np.inf)
        self.d[np.arange(len(sources)), np.searchsorted(self.names, sources)] = 0.0
        while len(src):
            better = np.minimum.reduceat(self.d[:, self.src] + self.w, self.first, axis=1)
            ends = self.dst[self.first]
            if not (better < self.d[:, ends]).any():
                break
            self.d[:, ends] = np.minimum(self.d[:, ends], better)
        self.into = dict(zip(self.dst[self.first].tolist(), zip(self.first, [*self.first[1:], len(src)])))

    def distances(self, sources: np.ndarray, goals: np.ndarray) -> np.ndarray:
        """Of pairs; infinite where there is no way."""
        at = np.minimum(np.searchsorted(self.names, goals), len(self.names) - 1)
        rows = np.array([self.rows[s] for s in sources.tolist()], dtype=int)
        return np.where(self.names[at] == goals, self.d[rows, at], np.inf)

    def way(self, source: object, goal: object) -> tuple[float, list] | None:
        """(distance, nodes); of equally short ways the one whose last step comes from the smallest node, at each step."""
        at = np.searchsorted(self.names, goal)
        d = self.d[self.rows[source]]
        if at == len(self.names) or self.names[at] != goal or not np.isfinite(d[at]):
            return None
        way, total = [at], float(d[at])
        while self.names[way[-1]] != source:
            lo, hi = self.into[int(way[-1])]
            via = d[self.src[lo:hi]] + self.w[lo:hi]
            ok = (via <= via.min() + 1e-12) & (self.src[lo:hi] != way[-1])
            way.append(self.src[lo:hi][ok].min())
        return total, self.names[way[::-1]].tolist()


def _asked_in_tasks(edges: DataFrame, asked: DataFrame, buckets: int, ways: bool) -> DataFrame:
    """Distances of asked pairs, and paths if ``ways``, the sources of a scan dealt to some tasks that each get its edges."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    dealt = asked.withColumn("bucket", F.pmod(F.xxhash64("src"), F.lit(buckets)).cast("int"))
    wanted = dealt.select(F.col("scan").alias("scan"), F.col("bucket").alias("part")).distinct()
    near = edges.select("scan", "src", "dst", "w").join(wanted, "scan")

    def run(pairs: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        out = []
        sources = np.unique(pairs["src"].to_numpy()) if len(pairs) else np.zeros(0)
        size = max(1, BLOCK // max(1, len(steps)))
        for k in range(0, len(sources), size):
            known = _Relaxed(steps, sources[k : k + size])
            mine = pairs[pairs["src"].isin(sources[k : k + size])]
            if not ways:
                out.append(mine[["scan", "src", "dst"]].assign(d=known.distances(mine["src"].to_numpy(), mine["dst"].to_numpy())))
                continue
            for r in mine.itertuples(index=False):
                if found := known.way(r.src, r.dst):
                    out.append((r.scan, r.src, r.dst, found[0], len(found[1]) - 1, found[1]))
        if not ways:
            every = pd.concat(out) if out else pd.DataFrame({"scan": [], "src": [], "dst": [], "d": []})
            return every[np.isfinite(every["d"])]
        return pd.DataFrame(out, columns=["scan", "src", "dst", "d", "hops", "path"])

    form = f"scan {kinds['scan']}, src {kinds['src']}, dst {kinds['dst']}, d double" + (f", hops long, path array<{kinds['src']}>" if ways else "")
    return dealt.groupBy("scan", "bucket").cogroup(near.groupBy("scan", "part")).applyInPandas(run, form)


#: Beyond all numbers of nodes: no node before.
_NONE = np.iinfo(np.int64).max
_CANDIDATE = np.dtype([("row", np.int32), ("col", np.int32), ("d", np.float64), ("before", np.int64), ("still", np.bool_)])
_STEP = np.dtype([("src", np.int64), ("dst", np.int64), ("w", np.float64)])


def _blob(kind: np.dtype, *columns: np.ndarray) -> bytes:
    out = np.empty(len(columns[0]), kind)
    for name, x in zip(kind.names, columns):
        out[name] = x
    return out.tobytes()


class _Tile:
    """Least distances from some sources to a block's nodes, and the node before each on the way.

    Of equally short ways the one whose last step comes from the smallest node is taken. A step of no length (two
    nodes at one place) is taken only where it shortens a way, so that no way goes round in a circle.
    """

    def __init__(self, row: object, block: int):
        rows, width = len(row.sources), min(block, row.nodes - row.b * block)
        self.lo, self.size = row.b * block, block
        self.d = np.full((rows, width), np.inf) if row.d is None else np.frombuffer(row.d).reshape(rows, width).copy()
        self.before = np.full((rows, width), _NONE) if row.before is None else np.frombuffer(row.before, np.int64).reshape(rows, width).copy()

    def take(self, met: np.ndarray) -> None:
        """Candidates, of each cell the best."""
        met = met[np.lexsort((met["before"], met["still"], met["d"], met["col"], met["row"]))]
        met = met[np.r_[True, (np.diff(met["row"]) != 0) | (np.diff(met["col"]) != 0)][: len(met)]]
        at = met["row"], met["col"]
        d, before = self.d[at], self.before[at]
        less, same = met["d"] < d, (met["d"] == d) & ~met["still"]
        self.before[at] = np.where(less, met["before"], np.where(same, np.minimum(before, met["before"]), before))
        self.d[at] = np.minimum(d, met["d"])

    def relax(self, steps: np.ndarray) -> None:
        """Through the steps inside the block until nothing changes."""
        if not len(steps):
            return
        steps = steps[np.argsort(steps["dst"], kind="stable")]
        first = np.flatnonzero(np.r_[True, np.diff(steps["dst"]) != 0])
        part = np.repeat(np.arange(len(first)), np.diff([*first, len(steps)]))
        src, ends = steps["src"] - self.lo, steps["dst"][first] - self.lo
        many = max(1, BLOCK // len(steps))
        for lo in range(0, len(self.d), many):
            rows, less = np.arange(lo, min(lo + many, len(self.d))), np.ones(1, bool)
            while len(rows):
                begin = self.d[rows][:, src]
                via = begin + steps["w"]
                best = np.minimum.reduceat(via, first, axis=1)
                hit = via == best[:, part]
                least = lambda ok: np.minimum.reduceat(np.where(ok, steps["src"], _NONE), first, axis=1)
                moved, any_ = least(hit & (begin < via)), least(hit)
                at = np.ix_(rows, ends)
                d, before = self.d[at], self.before[at]
                less = best < d
                self.before[at] = np.where(less, np.where(moved < _NONE, moved, any_), np.where(best == d, np.minimum(before, moved), before))
                self.d[at] = np.minimum(best, d)
                rows = rows[less.any(axis=1)]

    def sent(self, new: np.ndarray, steps: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(block, candidates) for the nodes that steps lead to out of the block, from its ``new`` cells."""
        steps = steps[np.argsort(steps["dst"] // self.size, kind="stable")]
        cuts = np.flatnonzero(np.diff(steps["dst"] // self.size)) + 1
        for part in np.split(steps, cuts) if len(steps) else []:
            best = np.empty(0, _CANDIDATE)
            many = max(1, BLOCK // len(part))
            for lo in range(0, len(self.d), many):
                row, k = np.nonzero(new[lo : lo + many][:, part["src"] - self.lo])
                d = self.d[row + lo, part["src"][k] - self.lo]
                found = np.frombuffer(_blob(_CANDIDATE, row + lo, part["dst"][k] % self.size, d + part["w"][k], part["src"][k], d + part["w"][k] == d), _CANDIDATE)
                found = found[np.lexsort((found["before"], found["still"], found["d"], found["col"], found["row"]))]
                best = np.concatenate([best, found[np.r_[True, (np.diff(found["row"]) != 0) | (np.diff(found["col"]) != 0)][: len(found)]]])
            if len(best):
                yield int(part["dst"][0] // self.size), best.tobytes()


def _asked_by_joins(edges: DataFrame, asked: DataFrame, block: int = BLOCK_NODES) -> DataFrame:
    """The same for scans of any size: distances spread from the asked sources in tiles, a block's sources to a block's nodes.

    A scan's nodes are numbered in their order and cut into blocks. In a round a tile takes what others send it, is relaxed
    through the steps inside its block, and sends what has become shorter along the steps that leave it, while
    that is shorter than the longest way its source still needs: the greatest distance to an asked goal, once all
    of them are reached. A round is joins of tiles and ends in checkpoints; a scan of one block needs one round.
    At last ways are walked back from their goals, from tile to tile.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    goals, edges = durable(asked.select("scan", "src", "dst")), durable(edges.select("scan", "src", "dst", "w"))
    ends = reduce(DataFrame.unionByName, [x.select("scan", F.col(c).alias("vp")) for x in (edges, goals) for c in ("src", "dst")]).distinct()
    names = durable(ends.withColumn("k", (F.row_number().over(Window.partitionBy("scan").orderBy("vp")) - 1).cast("long")))
    as_numbers = lambda x: reduce(lambda y, c: y.withColumnRenamed(c, "vp").join(names, ["scan", "vp"]).drop("vp").withColumnRenamed("k", c), ["src", "dst"], x)
    of = lambda c: F.floor(F.col(c) / block)
    key, tile = ["scan", "g", "b"], f"scan {kinds['scan']}, g long, b long"

    def apart(df: DataFrame) -> GroupedData:
        """Grouped by the key under other names: both sides of a cogroup come from the same rows."""
        return spread(df.select(*(F.col(c).alias(f"_{c}") for c in key), *(c for c in df.columns if c not in key), F.col("b").alias("b")), *(f"_{c}" for c in key)).groupBy(*(f"_{c}" for c in key))

    # the edges of a block in one row, those that leave it apart and in parts of bounded size
    packed = lambda f, **to: f.iloc[:1][["scan", "b"]].assign(**{next(iter(to)): [_blob(_STEP, *(f[c].to_numpy() for c in _STEP.names))]})
    numbered = as_numbers(edges).withColumn("b", of("src"))
    inner = durable(numbered.where(of("dst") == F.col("b")).groupBy("scan", "b").applyInPandas(lambda f: packed(f, inner=0), f"scan {kinds['scan']}, b long, inner binary"))
    outer = numbered.where(of("dst") != F.col("b")).withColumn("part", F.floor(of("dst") / block))
    outer = durable(outer.groupBy("scan", "b", "part").applyInPandas(lambda f: packed(f, outer=0), f"scan {kinds['scan']}, b long, outer binary"))

    goals = durable(as_numbers(goals).withColumn("g", of("src")).withColumn("b", of("dst")))
    nodes = names.groupBy("scan").agg(F.count(F.lit(1)).alias("nodes"))
    sources = durable(goals.groupBy("scan", "g").agg(F.array_sort(F.collect_set("src")).alias("sources")).join(nodes, "scan"))
    wanted = durable(goals.groupBy(*key).agg(F.collect_list(F.struct("src", "dst")).alias("wanted")))
    own = sources.select("scan", "g", F.col("g").alias("b"), F.transform("sources", lambda k: k % block).alias("cols"), "sources")

    def begun(f: pd.DataFrame) -> pd.DataFrame:
        at = [(np.arange(len(c)), np.asarray(c), 0.0, np.asarray(k), False) for c, k in zip(f["cols"], f["sources"])]
        return f[key].assign(met=[_blob(_CANDIDATE, *x) for x in at])

    def merged(f: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        r = next(f.itertuples(index=False))
        t = _Tile(r, block)
        old = t.d.copy()
        t.take(np.concatenate([np.empty(0, _CANDIDATE), *(np.frombuffer(x, _CANDIDATE) for x in met["met"])]))
        t.relax(np.frombuffer(r.inner or b"", _STEP))
        new, far = t.d < old, np.full(len(r.sources), -np.inf)
        if r.wanted is not None:
            src, dst = (np.array([w[c] for w in r.wanted], np.int64) for c in ("src", "dst"))
            np.maximum.at(far, np.searchsorted(np.asarray(r.sources), src), t.d[np.searchsorted(np.asarray(r.sources), src), dst - t.lo])
        return pd.DataFrame({"scan": [r.scan], "g": r.g, "b": r.b, "d": t.d.tobytes(), "before": t.before.tobytes(), "new": new.tobytes() if new.any() else None, "far": [far.tolist()]})

    def passed(f: pd.DataFrame) -> pd.DataFrame:
        r = next(f.itertuples(index=False))
        t = _Tile(r, block)
        new = np.frombuffer(r.new, bool).reshape(t.d.shape) & (t.d < np.asarray(r.far)[:, None])
        found = [(j, c) for blob in f["outer"] for j, c in t.sent(new, np.frombuffer(blob, _STEP))]
        return pd.DataFrame({"scan": r.scan, "g": r.g, "b": [j for j, _ in found], "met": [c for _, c in found]})

    form = f"{tile}, d binary, before binary, new binary, far array<double>"
    met = own.groupBy(*key).applyInPandas(begun, f"{tile}, met binary").unionByName(wanted.select(*key, F.lit(b"").alias("met")))
    tiles = goals.sparkSession.createDataFrame([], form)
    while True:
        met = durable(met)
        if not met.limit(1).count():
            break
        touched = met.select(*key).distinct()
        full = touched.join(sources, ["scan", "g"]).join(inner, ["scan", "b"], "left").join(wanted, key, "left").join(tiles.select(*key, "d", "before"), key, "left")
        now = durable(spread(full, *key).groupBy(*key).cogroup(apart(met)).applyInPandas(merged, form))
        tiles = tiles.join(touched, key, "left_anti").unionByName(now)
        leaving = now.where(F.col("new").isNotNull()).drop("far").join(outer, ["scan", "b"])
        # how far a source has to go: to the last of its goals, without bound while one is unknown
        far = tiles.select("scan", "g", F.posexplode("far").alias("row", "far")).groupBy("scan", "g", "row").agg(F.max("far").alias("far"))
        far = far.groupBy("scan", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "far"))), lambda x: x["far"]).alias("far"))
        met = leaving.join(far, ["scan", "g"]).join(sources, ["scan", "g"]).groupBy(*key).applyInPandas(passed, f"{tile}, met binary")

    def walked(ways: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        r = next(f.itertuples(index=False), None)
        t = None if r is None else _Tile(r, block)
        for w in ways.itertuples(index=False) if t else ():
            row, back = int(np.searchsorted(np.asarray(r.sources), w.src)), list(w.back)
            d = t.d[row, back[0] - t.lo] if len(back) == 1 else w.d
            if not np.isfinite(d):
                continue
            while back[-1] != w.src and back[-1] // block == r.b:
                back.append(int(t.before[row, back[-1] - t.lo]))
            out.append((w.scan, w.g, back[-1] // block, w.src, w.dst, d, back, back[-1] == w.src))
        return pd.DataFrame(out, columns=["scan", "g", "b", "src", "dst", "d", "back", "done"])

    tiles = durable(tiles.select(*key, "d", "before").join(sources, ["scan", "g"]))
    ways, made = goals.withColumn("d", F.lit(None).cast("double")).withColumn("back", F.array("dst")), []
    while True:
        ways = durable(spread(ways, *key).groupBy(*key).cogroup(apart(tiles)).applyInPandas(walked, f"{tile}, src long, dst long, d double, back array<long>, done boolean"))
        made.append(ways.where("done"))
        ways = ways.where("NOT done").drop("done")
        if not ways.limit(1).count():
            break
    whole = reduce(DataFrame.unionByName, made)
    places = whole.select("scan", "src", "dst", "d", F.posexplode(F.reverse("back")).alias("pos", "k")).join(names, ["scan", "k"])
    path = places.groupBy("scan", "src", "dst", "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vp"))), lambda x: x["vp"]).alias("path"))
    return path.select("scan", F.col("path")[0].alias("src"), F.element_at("path", -1).alias("dst"), "d", (F.size("path") - 1).cast("long").alias("hops"), "path")


def _asked(edges: DataFrame, asked: DataFrame, most_edges: int, buckets: int, ways: bool) -> DataFrame:
    pairs = asked.select("scan", "src", "dst").distinct()
    large = edges.groupBy("scan").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_edges).select("scan")
    if not large.limit(1).count():
        return _asked_in_tasks(edges, pairs, buckets, ways)
    part = lambda df, how: df.join(large, "scan", how)
    small = _asked_in_tasks(part(edges, "left_anti"), part(pairs, "left_anti"), buckets, ways)
    return small.unionByName(_asked_by_joins(part(edges, "left_semi"), part(pairs, "left_semi")).select(small.columns))


def asked_paths(edges: DataFrame, asked: DataFrame, most_edges: int = MOST_EDGES, buckets: int = 4) -> DataFrame:
    """(scan, src, dst, d, hops, path) of the asked (scan, src, dst) that are connected, each once, for scans of any size.

    The work follows the asked sources, not all pairs. Scans whose edges fit a task are relaxed there; those
    of more than ``most_edges``, if there are any, by joins.
    """
    return _asked(edges, asked, most_edges, buckets, ways=True)


def asked_distances(edges: DataFrame, asked: DataFrame, most_edges: int = MOST_EDGES, buckets: int = 4) -> DataFrame:
    """(scan, src, dst, d) of the same."""
    return _asked(edges, asked, most_edges, buckets, ways=False)


def _reached_in_tasks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf["src"].to_numpy())
        real = pdf["dst"].notna().to_numpy()
        a, b = (np.searchsorted(names, pdf[c].to_numpy()[real]) for c in ("src", "dst"))
        least, before = np.arange(len(names)), None
        while before is None or (least != before).any():
            before = least.copy()
            np.minimum.at(least, b, least[a])
            least = least[least]
        return pd.DataFrame({"scan": pdf["scan"].iloc[0], "vp": names, "reach": np.bincount(least, minlength=len(names))[least]})

    return _with_lone(edges, nodes).groupBy("scan").applyInPandas(run, f"scan {kinds['scan']}, vp {kinds['src']}, reach long")


def _reached_by_joins(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The least node of a part spreads over its nodes; each then takes the label of its label, so few rounds are needed.

    A round is joins and a minimum and ends in a checkpoint; two numbers tell whether it changed anything.
    """
    rows = durable(nodes.select("scan", F.col("vp").alias("node"), F.col("vp").alias("least")))
    links = durable(edges.select("scan", F.col("src").alias("node"), F.col("dst").alias("to")).distinct())
    mark = None
    while (now := tuple(rows.agg(F.count_if(F.col("node") == F.col("least")), F.sum(F.xxhash64("scan", "node", "least").cast("decimal(38,0)"))).first())) != mark:
        mark = now
        spread = links.join(rows, ["scan", "node"]).select("scan", F.col("to").alias("node"), "least").unionByName(rows).groupBy("scan", "node").agg(F.min("least").alias("least"))
        jump = spread.select("scan", F.col("node").alias("least"), F.col("least").alias("further"))
        rows = durable(spread.join(jump, ["scan", "least"]).select("scan", "node", F.least("least", "further").alias("least")))
    size = rows.groupBy("scan", "least").agg(F.count(F.lit(1)).alias("reach"))
    return rows.join(size, ["scan", "least"]).select("scan", F.col("node").alias("vp"), "reach")


def reached(edges: DataFrame, nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(scan, vp, reach): how many nodes each can come to, itself included, for scans of any size and edges both ways."""
    large = _large(nodes, most)
    if large is None:
        return _reached_in_tasks(edges, nodes)
    part = lambda df, how: df.join(large, "scan", how)
    return _reached_in_tasks(part(edges, "left_anti"), part(nodes, "left_anti")).unionByName(_reached_by_joins(part(edges, "left_semi"), part(nodes, "left_semi")))


def adjacent_pairs(path: str) -> Column:
    """A path as an array of (pos, prev, node); ``prev`` is null at the start."""
    return F.transform(path, lambda x, k: F.struct(k.alias("pos"), F.get(path, k - 1).alias("prev"), x.alias("node")))


def degree(edges: DataFrame) -> DataFrame:
    """(scan, vp, degree, nearest): neighbours of each node and the distance of the closest."""
    return edges.groupBy("scan", F.col("src").alias("vp")).agg(F.count(F.lit(1)).alias("degree"), F.min("w").alias("nearest"))
