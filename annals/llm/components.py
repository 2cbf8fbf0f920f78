"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a pair of aggregations and joins over links; nothing is collected, and a node with
very many links is only ever reduced by a partial minimum. Steps are O(log n) in practice. Each
round is written to the shared folder, so that a lost executor repeats one round at most.

Up to FEW links go to one task instead, which walks arrays: every round costs the driver some ten queries
(plans, broadcasts, threads), however few the links are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.llm.common import saved

#: The links up to which one task joins them; beyond, they are never in one place.
FEW = 1 << 20


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _is_settled(links: DataFrame) -> bool:
    """Whether links are stars: no node has two centres, no centre has a centre of its own."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node each one reaches) over links a - b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[x], top[y])
        now = top.copy()
        np.minimum.at(now, top[x], low)
        np.minimum.at(now, top[y], low)
        while not np.array_equal(up := now[now], now):
            now = up
        if np.array_equal(now, top):
            return nodes, nodes[top]
        top = now


def _at_once(links: DataFrame) -> DataFrame:
    """(node, component) of links that one task holds."""

    def run(it):
        ends = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in it if batch.num_rows]
        if ends:
            nodes, least = smallest_reached(*(np.concatenate(x) for x in zip(*ends)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    links: (a, b), in any direction, repeated rows and a = b allowed. Empty links give no rows.
    """
    now = saved(links.select("a", "b").where("a <> b").distinct(), "links")
    if now.count() <= FEW:
        return saved(_at_once(now), "components")
    while True:
        now = saved(_small(_large(now)), "links")
        if _is_settled(now):
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
