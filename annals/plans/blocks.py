"""Values carried along edges by blocks of vertices: each block of some million edges is one task's arrays, and rounds pass on only what crosses.

Vertices are cut into ranges of ids with about as many edges each. A block runs when others have sent it something, from its edges, its
state after its last run and the news; what it finds for vertices of other blocks is its news to them. Where all edges that cross go to lower
ranges, as those of commits to their parents do, only the highest block with news runs, so that each runs once; where all go to higher ones,
the lowest; else all with news run side by side. A task holds one block whatever the input's size, but for vertices with more edges than a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.plans.shared import written

BLOCK = 2_000_000  # edges
ROW = "block int, what int, a long, b long, v long, w long, s string, r string"
EDGE, START, STATE, NEWS = range(4)
COLUMNS = {"a": "long", "b": "long", "v": "long", "w": "long", "s": "string", "r": "string"}


def _full(rows: DataFrame, what: int) -> DataFrame:
    return rows.select(F.lit(what).alias("what"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _numbers(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy().astype(np.int64, copy=False) for c in columns]


class Part:
    """One block in a task: vertices (ids), inner edges from each (starts, to, value), edges that leave (out: from, id, value), and rows by kind."""

    def __init__(self, table: pa.Table, inside):
        what = table.column("what").to_numpy()
        self.rows = {k: table.filter(pa.array(what == k)) for k in (START, STATE, NEWS)}
        a, b, v = _numbers(table.filter(pa.array(what == EDGE)), "a", "b", "v")
        inner = inside(b)
        self.ids = np.unique(np.concatenate([a, b[inner], *(_numbers(rows, "a")[0] for rows in self.rows.values())]))
        order = np.argsort(a[inner], kind="stable")
        self.starts = np.searchsorted(a[inner][order], self.ids)
        self.starts = np.append(self.starts, len(order))
        self.to, self.value = self.at(b[inner][order]), v[inner][order]
        self.out = self.at(a[~inner]), b[~inner], v[~inner]

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def of(self, kind: int, *columns: str) -> list[np.ndarray]:
        """Places of the rows of a kind, and their columns."""
        a, *rest = _numbers(self.rows[kind], "a", *columns)
        return [self.at(a), *rest]

    def next(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in nodes, vertex) of every inner edge out of nodes."""
        n = self.starts[nodes + 1] - self.starts[nodes]
        which = np.repeat(np.arange(len(nodes)), n)
        return which, self.to[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[nodes], n)]


def grouped(ids: np.ndarray, values: np.ndarray, how) -> tuple[np.ndarray, np.ndarray]:
    """Each id once with its values put together by a ufunc."""
    if not len(ids):
        return ids, values
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
    return ids[order][first], how.reduceat(values[order], first)


class Blocks:
    """The blocks of edges (a, b, v): from, to, a value."""

    def __init__(self, edges: DataFrame, block: int = BLOCK):
        rows = written(edges.select("a", "b", "v").where("a is not null and b is not null"), "edges")
        self.count = max(1, -(-rows.count() // block))
        cuts = rows.stat.approxQuantile("a", [k / self.count for k in range(1, self.count)], 0.01 / self.count) if self.count > 1 else []
        bounds = self.bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))
        number = self._placed(rows, EDGE)
        self.edges = written(number.repartitionByRange(self.count, "block"), "blocks")
        self.crossing, self.step = 0, 0
        if self.count > 1:

            def run(it):
                up = down = n = 0
                for batch in it:
                    a, b = (np.searchsorted(bounds, batch.column(c).to_numpy(), side="right") for c in ("a", "b"))
                    up, down, n = up + int((b > a).sum()), down + int((b < a).sum()), n + len(a)
                yield pa.RecordBatch.from_pydict({"up": [up], "down": [down], "n": [n]})

            up, down, n = self.edges.select("a", "b").mapInArrow(run, "up long, down long, n long").agg(F.sum("up"), F.sum("down"), F.sum("n")).first()
            self.crossing = (up + down) / n
            self.step = 0 if up and down else 1 if up else -1

    def _placed(self, rows: DataFrame, what: int) -> DataFrame:
        bounds = self.bounds

        def run(it):
            for batch in it:
                block = np.searchsorted(bounds, batch.column("a").to_numpy(), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", *batch.schema.names])

        return _full(rows, what).where("a is not null").mapInArrow(run, ROW)

    def run(self, starts: DataFrame, work, what: int = NEWS) -> DataFrame:
        """The state (a, v, w, s, r) of all vertices that starts (a, ...) lead to. work(part) gives two dicts of columns: the block's state, and its news."""
        bounds = self.bounds

        def one(key, table):
            mine = key[0].as_py()
            inside = lambda ids: np.searchsorted(bounds, ids, side="right") == mine
            state, news = work(Part(table, inside))
            made = []
            for kind, found in ((STATE, state), (NEWS, news)):
                n = len(found["a"])
                block = np.full(n, mine, np.int32) if kind == STATE else np.searchsorted(bounds, np.asarray(found["a"], np.int64), side="right").astype(np.int32)
                columns = [pa.array(found[c], pa.string() if t == "string" else pa.int64()) if c in found else pa.nulls(n, pa.string() if t == "string" else pa.int64()) for c, t in COLUMNS.items()]
                made.append(pa.Table.from_arrays([pa.array(block), pa.array(np.full(n, kind, np.int32)), *columns], names=["block", "what", *COLUMNS]))
            return pa.concat_tables(made)

        rounds = [written(self._placed(starts, what), "starts")]
        waiting = {r.block: [0] for r in rounds[0].select("block").distinct().collect()}
        latest: dict[int, int] = {}
        while waiting:
            now = [max(waiting)] if self.step < 0 else [min(waiting)] if self.step > 0 else list(waiting)
            rows = self.edges.where(F.col("block").isin(now))
            for k, made in enumerate(rounds):
                news, old = [x for x in now if k in waiting[x]], [x for x in now if latest.get(x) == k]
                if news:
                    rows = rows.unionByName(made.where(F.col("block").isin(news) & F.col("what").isin(START, NEWS)))
                if old:
                    rows = rows.unionByName(made.where(F.col("block").isin(old) & (F.col("what") == STATE)))
            rounds.append(written(rows.groupBy("block").applyInArrow(one, ROW), "round"))
            for x in now:
                latest[x] = len(rounds) - 1
                del waiting[x]
            for r in rounds[-1].where(F.col("what") == NEWS).select("block").distinct().collect():  # a number a block
                waiting.setdefault(r.block, []).append(len(rounds) - 1)
        out = rounds[0].where("false")
        for k, made in enumerate(rounds):
            if mine := [x for x, at in latest.items() if at == k]:
                out = out.unionByName(made.where(F.col("block").isin(mine) & (F.col("what") == STATE)))
        return out.select("a", "v", "w", "s", "r")


def carried(part: Part):
    """Bits: every vertex has those of all that lead to it."""
    mask = np.zeros(len(part.ids), np.int64)
    at, v = part.of(STATE, "v")
    mask[at] = v
    before = mask.copy()
    at, v = part.of(NEWS, "v")
    np.bitwise_or.at(mask, at, v)
    front = np.flatnonzero(mask != before)
    while len(front):
        which, to = part.next(front)
        old = mask[to]
        np.bitwise_or.at(mask, to, mask[front][which])
        front = np.unique(to[mask[to] != old])
    source, to, _ = part.out
    sent = (mask != before)[source]
    a, v = grouped(to[sent], mask[source[sent]], np.bitwise_or)
    keep = mask != 0
    return {"a": part.ids[keep], "v": mask[keep]}, {"a": a, "v": v}


def nearest(most: int | None):
    """The fewest steps to every vertex; with most, those farther away aren't walked."""

    def work(part: Part):
        far = np.iinfo(np.int64).max
        value = np.full(len(part.ids), far)
        at, v = part.of(STATE, "v")
        value[at] = v
        before = value.copy()
        at, v = part.of(NEWS, "v")
        np.minimum.at(value, at, v)
        fresh = np.flatnonzero(value < before)
        fresh = fresh[np.argsort(value[fresh], kind="stable")]
        begun, done, front = value[fresh].copy(), 0, np.zeros(0, np.int64)
        k = begun[0] if len(begun) else 0
        while len(front) or done < len(fresh):
            if not len(front):
                k = max(k, begun[done])
            end = np.searchsorted(begun, k, side="right")
            mine = fresh[done:end]
            front, done = np.union1d(front, mine[value[mine] == k]), end
            if most is not None and k >= most:
                front = front[:0]
                continue
            _, to = part.next(front)
            front = np.unique(to[value[to] > k + 1])
            k += 1
            value[front] = k
        source, to, _ = part.out
        sent = (value < before)[source]
        if most is not None:
            sent &= value[source] < most
        a, v = grouped(to[sent], value[source[sent]] + 1, np.minimum)
        keep = value < far
        return {"a": part.ids[keep], "v": value[keep]}, {"a": a, "v": v}

    return work


def longest(part: Part):
    """One more than the largest of those that lead to a vertex, once all of them (w: how many aren't known yet) are known; each edge is told once."""
    value, missing = np.ones(len(part.ids), np.int64), np.zeros(len(part.ids), np.int64)
    ready = np.ones(len(part.ids), bool)
    at, w = part.of(START, "w")
    missing[at] = w
    at, v, w = part.of(STATE, "v", "w")
    value[at], missing[at], ready[at] = v, w, w > 0
    at, v, w = part.of(NEWS, "v", "w")
    np.maximum.at(value, at, v)
    np.subtract.at(missing, at, w)
    told = np.zeros(len(part.ids), bool)
    front = np.flatnonzero(ready & (missing == 0))
    while len(front):
        told[front] = True
        which, to = part.next(front)
        np.maximum.at(value, to, value[front][which] + 1)
        np.subtract.at(missing, to, 1)
        to = np.unique(to)
        front = to[missing[to] == 0]
    source, to, _ = part.out
    sent = told[source]
    a, v = grouped(to[sent], value[source[sent]] + 1, np.maximum)
    _, w = grouped(to[sent], np.ones(sent.sum(), np.int64), np.add)
    return {"a": part.ids, "v": value, "w": missing}, {"a": a, "v": v, "w": w}
