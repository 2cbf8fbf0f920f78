"""Closures over a commit graph.

Each has two ways with the same result. Up to SMALL edges and as many commits asked for (both counted first), the graph goes to one task that
walks arrays: few jobs, no rounds. Beyond it, blocks of edges do so, a task each, and rounds pass on what crosses (annals.plans.blocks);
nothing is collected. Where most edges cross, as with ids that don't follow the history, ``carry`` and ``reach`` first contract lines of commits
with one child and one parent by pointer jumping, so that a line of n commits takes log2(n) rounds instead of n.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.plans.blocks import BLOCK, START, Blocks, carried, longest, nearest
from annals.plans.jump import ends
from annals.plans.shared import written

SMALL = 5_000_000


def _is_small(edges: DataFrame, small: int, *others: DataFrame) -> bool:
    return all(rows.limit(small + 1).count() <= small for rows in (edges.select("child"), *(o.select("oid") for o in others)))


def _indexed(table: pa.Table):
    """(ids, edge starts by child, parents as indices, tips as indices, tip values) of rows (child, parent, value); tips have no parent."""
    child, parent, value = (table.column(k).to_numpy(zero_copy_only=False) for k in ("child", "parent", "value"))
    is_tip = np.isnan(parent.astype(float)) if parent.dtype.kind == "f" or parent.dtype == object else np.zeros(len(parent), bool)
    c, p = child[~is_tip].astype(np.int64), parent[~is_tip].astype(np.int64)
    t = child[is_tip].astype(np.int64)
    ids = np.unique(np.concatenate([c, p, t]))
    ci, pi, ti = (np.searchsorted(ids, x) for x in (c, p, t))
    order = np.argsort(ci, kind="stable")
    starts = np.searchsorted(ci[order], np.arange(len(ids) + 1))
    return ids, starts, pi[order], ti, value[is_tip].astype(np.int64)


def _out(starts, parents, nodes):
    """(position in nodes, parent) of every edge out of nodes."""
    n = starts[nodes + 1] - starts[nodes]
    which = np.repeat(np.arange(len(nodes)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[nodes], n)
    return which, parents[at]


def _one_task(edges: DataFrame, tips: DataFrame, step, schema: str) -> DataFrame:
    rows = edges.select("child", "parent", F.lit(0).cast("long").alias("value")).unionByName(tips.select(F.col("oid").alias("child"), F.lit(None).cast("long").alias("parent"), "value"))

    def run(it):
        batches = list(it)
        if batches:
            ids, values, keep = step(*_indexed(pa.Table.from_batches(batches)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(values[keep])], names=["oid", "value"])

    return rows.repartition(1).mapInArrow(run, schema)


def _carry(ids, starts, parents, tips, values):
    mask = np.zeros(len(ids), np.int64)
    np.bitwise_or.at(mask, tips, values)
    front = np.unique(tips)
    while len(front):
        which, to = _out(starts, parents, front)
        before = mask[to]
        np.bitwise_or.at(mask, to, mask[front][which])
        front = np.unique(to[mask[to] != before])
    return ids, mask, mask != 0


def _edges(edges: DataFrame, up: bool = True) -> DataFrame:
    a, b = ("child", "parent") if up else ("parent", "child")
    return edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.lit(0).cast("long").alias("v"))


def _valued(found: DataFrame) -> DataFrame:
    return found.select(F.col("a").alias("oid"), F.col("v").alias("value"))


def _contracted(edges: DataFrame, tips: DataFrame, small: int, block: int) -> DataFrame:
    """carry with lines contracted: a commit with one child and one parent that is no tip has just its child's bits."""
    pairs = written(edges.select("child", "parent").distinct(), "edges")
    up = pairs.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1").select(F.col("child").alias("node"), "parent")
    down = pairs.groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("child")).where("n = 1").select(F.col("parent").alias("node"), "child")
    inner = written(up.join(down, "node").join(tips.select(F.col("oid").alias("node")), "node", "left_anti"), "inner")
    above = ends(inner.select("node", F.col("parent").alias("to")))
    below = ends(inner.select("node", F.col("child").alias("to")))
    outer = pairs.join(inner.select(F.col("node").alias("child")), "child", "left_anti")
    short = outer.join(above.select(F.col("node").alias("parent"), "to"), "parent", "left").select("child", F.coalesce("to", "parent").alias("parent"))
    found = written(carry(written(short, "short"), tips, small, block, contract=False), "outer")
    return found.unionByName(below.join(found.select(F.col("oid").alias("to"), "value"), "to").select(F.col("node").alias("oid"), "value"))


def carry(edges: DataFrame, tips: DataFrame, small: int = SMALL, block: int = BLOCK, contract: bool = True) -> DataFrame:
    """(oid, value): for every commit reachable from tips (oid, value: flag bits) the bits of the tips that reach it."""
    tips = tips.select(F.col("oid").cast("long"), F.col("value").cast("long"))
    if _is_small(edges, small, tips):
        return _one_task(edges, tips, _carry, "oid long, value long")
    blocks = Blocks(_edges(edges), block)
    if contract and blocks.crossing > 0.5:
        return _contracted(blocks.edges.select(F.col("a").alias("child"), F.col("b").alias("parent")), tips, small, block)
    return _valued(blocks.run(tips.select(F.col("oid").alias("a"), F.col("value").alias("v")), carried))


def reach(edges: DataFrame, start: list[int] | DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(oid) of all commits reachable from the start, itself included."""
    tips = start if isinstance(start, DataFrame) else edges.sparkSession.createDataFrame([(int(s),) for s in start], "oid long")
    return carry(edges, tips.select("oid", F.lit(1).alias("value")), small, block).select("oid")


def _depths(ids, starts, parents, tips, values, most=None):
    depth = np.full(len(ids), -1, np.int64)
    depth[tips] = 0
    front, k = np.unique(tips), 0
    while len(front) and (most is None or k < most):
        k += 1
        _, to = _out(starts, parents, front)
        front = np.unique(to[depth[to] < 0])
        depth[front] = k
    return ids, depth, depth >= 0


def depths(edges: DataFrame, start: list[int], small: int = SMALL, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """(oid, value): the fewest steps from the start; with most, commits farther away aren't walked."""
    spark = edges.sparkSession
    tips = spark.createDataFrame([(int(s), 0) for s in start], "oid long, value long")
    if _is_small(edges, small):
        return _one_task(edges, tips, lambda *graph: _depths(*graph, most=most), "oid long, value long")
    return _valued(Blocks(_edges(edges), block).run(tips.select(F.col("oid").alias("a"), F.col("value").alias("v")), nearest(most)))


def _generations(ids, starts, parents, tips, values):
    n = len(ids)
    waiting = np.diff(starts)
    child = np.repeat(np.arange(n), waiting)
    order = np.argsort(parents, kind="stable")
    down, first = child[order], np.searchsorted(parents[order], np.arange(n + 1))
    value = np.zeros(n, np.int64)
    front, k = np.flatnonzero(waiting == 0), 0
    waiting = waiting.copy()
    while len(front):
        k += 1
        value[front] = k
        _, to = _out(first, down, front)
        np.subtract.at(waiting, to, 1)
        to = np.unique(to)
        front = to[waiting[to] == 0]
    return ids, value, value > 0


def generations(edges: DataFrame, commits: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(oid, value): 1 for roots, else one more than the largest of the parents."""
    nodes = commits.select(F.col("oid").cast("long"), F.lit(0).cast("long").alias("value"))
    if _is_small(edges, small, nodes):
        return _one_task(edges, nodes, _generations, "oid long, value long")
    blocks = Blocks(_edges(edges, up=False), block)
    count = lambda c, n: blocks.edges.select(F.col(c).alias("a"), F.lit(n).cast("long").alias("w"))
    every = nodes.select(F.col("oid").alias("a"), F.lit(0).cast("long").alias("w")).unionByName(count("b", 1)).unionByName(count("a", 0))
    return _valued(blocks.run(every.groupBy("a").agg(F.sum("w").alias("w")), longest, START).where("w = 0"))
