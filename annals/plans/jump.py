"""Pointer jumping: where chains of single steps end, in rounds that double what a step spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.plans.shared import written


def ends(steps: DataFrame) -> DataFrame:
    """(node, to) of where each node's chain ends; steps: (node, to), one a node, without cycles. A chain of n steps takes log2(n) rounds of one join."""
    now = written(steps.select("node", "to"), "steps")
    while True:
        far = now.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = written(now.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "steps")
        if new.where("moved").isEmpty():
            return new.select("node", "to")
        now = new.select("node", "to")
