"""Walks of tree objects by level: rows (tree, name, mode, oid) of all trees, from roots down; equal subtrees are never entered."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annals.plans.history import trees
from annals.plans.shared import written
from annals.registry import query
from annals.sources import staging

FOLDER = staging.FOLDER


def _parsed(it):
    """(tree, name, mode, oid) of rows (oid, data); as many rows at once as make some thousand entries."""
    out = ([], [], [], [])

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["tree", "name", "mode", "oid"])
        for column in out:
            column.clear()
        return batch

    for batch in it:
        for tree, data in zip(batch.column("oid"), batch.column("data")):
            tree = tree.as_py()
            for name, mode, oid in staging.read_tree(data.as_py()):
                out[0].append(tree)
                out[1].append(name.decode("utf-8", "replace"))
                out[2].append(mode)
                out[3].append(oid)
            if len(out[0]) >= 10_000:
                yield flush()
    yield flush()


def entries_of(objects: DataFrame) -> DataFrame:
    """(tree, name, mode, oid) of tree objects (oid, data), each tree once; with a column part also of those in several rows, as ``trees_of`` makes them."""
    schema = "tree string, name string, mode int, oid string"
    if "part" not in objects.columns:
        return objects.select("oid", "data").dropDuplicates(["oid"]).mapInArrow(_parsed, schema)
    whole, rest = objects.where("part = 0").select("oid", "data"), objects.where("part <> 0").select("oid", "data")
    # a tree may have been made twice, with other parts or once whole; there are few trees in parts
    known = whole.select("oid").join(F.broadcast(rest.select("oid").distinct()), "oid", "left_semi").distinct()
    parts = rest.join(F.broadcast(known), "oid", "left_anti").mapInArrow(_parsed, schema).dropDuplicates(["tree", "name"])
    return whole.dropDuplicates(["oid"]).mapInArrow(_parsed, schema).unionByName(parts)


def diff(entries: DataFrame, old: str | None, new: str | None) -> DataFrame:
    """(path, old_mode, new_mode, old_id, new_id) of files that differ between two root trees; a round a level, and only folders whose ids differ go on.

    A folder on one side and a file of its name on the other are two changes.
    """
    spark = entries.sparkSession
    front = spark.createDataFrame([("", old, new)], "path string, a string, b string")
    out = None
    while True:
        one = entries.select(F.col("tree").alias("a"), "name", F.struct("mode", "oid").alias("x"))
        two = entries.select(F.col("tree").alias("b"), "name", F.struct("mode", "oid").alias("y"))
        left = front.where("a is not null").join(one, "a").select("path", "name", "x")
        right = front.where("b is not null").join(two, "b").select("path", "name", "y")
        both = left.join(right, ["path", "name"], "full").where("not (x <=> y)")
        rows = written(both.select(F.concat("path", "name").alias("path"), "x", "y"), "level")
        is_folder = lambda c: F.coalesce(F.col(f"{c}.mode") == FOLDER, F.lit(False))
        file = lambda c: F.when(~is_folder(c), F.col(c))
        part = rows.select("path", file("x").alias("x"), file("y").alias("y")).where("x is not null or y is not null").select("path", F.col("x.mode").alias("old_mode"), F.col("y.mode").alias("new_mode"), F.col("x.oid").alias("old_id"), F.col("y.oid").alias("new_id"))
        out = part if out is None else out.unionByName(part)
        front = rows.where(is_folder("x") | is_folder("y")).select(F.concat("path", F.lit("/")).alias("path"), F.when(is_folder("x"), F.col("x.oid")).alias("a"), F.when(is_folder("y"), F.col("y.oid")).alias("b"))
        if front.isEmpty():
            return out


def walk(entries: DataFrame, root: str, folders: bool = False, below: str = "") -> DataFrame:
    """(path, mode, oid) of all files of a root tree, and folders if asked for; with below only what can lie in that path is entered."""
    spark = entries.sparkSession
    front, out = spark.createDataFrame([("", root)], "path string, tree string"), None
    while True:
        rows = front.join(entries, "tree").select(F.concat("path", "name").alias("path"), "mode", "oid")
        if below:
            rows = rows.where((F.col("path") == below) | F.startswith("path", F.lit(below.rstrip("/") + "/")) | F.startswith(F.lit(below), F.concat("path", F.lit("/"))))
        rows = written(rows, "level")
        part = rows if folders else rows.where(F.col("mode") != FOLDER)
        out = part if out is None else out.unionByName(part)
        front = rows.where(F.col("mode") == FOLDER).select(F.concat("path", F.lit("/")).alias("path"), F.col("oid").alias("tree"))
        if front.isEmpty():
            return out


def look_up(entries: DataFrame, root: str, path: str):
    """(mode, oid) of a single path, or None: one point lookup a part."""
    at = (FOLDER, root)
    for name in path.strip("/").split("/"):
        if at is None or at[0] != FOLDER:
            return None
        found = entries.where((F.col("tree") == at[1]) & (F.col("name") == name)).limit(1).collect()
        at = (found[0].mode, found[0].oid) if found else None
    return at


def post_order(walked: DataFrame) -> DataFrame:
    """(path, mode, oid, pos): folders behind what they hold; walked: with folders."""
    key = F.when(F.col("mode") == FOLDER, F.concat("path", F.lit("/\U0010ffff"))).otherwise(F.col("path"))
    rows = walked.withColumn("key", key)
    parts = written(rows.repartitionByRange("key").sortWithinPartitions("key").select("path", "mode", "oid", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sorted")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    base = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return parts.join(F.broadcast(base), "part").select("path", "mode", "oid", (F.col("base") + F.col("at") - F.col("first") + 1).alias("pos"))


def closure(entries: DataFrame, roots: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(oid, mode) of all trees and blobs below roots (oid), each once, but for those in without (oid), below which nothing is looked for."""
    front = roots.select("oid", F.lit(FOLDER).alias("mode")).distinct()
    front = written(front if without is None else front.join(without, "oid", "left_anti"), "objects")
    seen = front
    while not front.where(F.col("mode") == FOLDER).isEmpty():
        below = front.where(F.col("mode") == FOLDER).select(F.col("oid").alias("tree")).join(entries, "tree").select("oid", "mode").distinct()
        if without is not None:
            below = below.join(without, "oid", "left_anti")
        front = written(below.join(seen, "oid", "left_anti").dropDuplicates(["oid"]), "objects")
        seen = written(seen.unionByName(front), "objects")
    return seen


def _forest(spark, sf_dir):
    """(entries, root of base, root of ours), made bottom up."""
    pad = lambda t: t.withColumn("oid", F.concat("oid", F.lit("0" * 8)))
    base, ours, _ = trees(spark, sf_dir)
    a, b = (written(staging.trees_of(pad(t)), "trees") for t in (base, ours))
    root = lambda made: made.where("folder = ''").first().oid
    return written(entries_of(a.unionByName(b)), "entries"), root(a), root(b)


@query("""SELECT coalesce(a.path, b.path) AS path, a.mode AS old_mode, b.mode AS new_mode, a.oid || '00000000' AS old_id, b.oid || '00000000' AS new_id FROM base_tree a FULL JOIN tree_a b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid OR a.mode IS DISTINCT FROM b.mode""")
def tree_diff_by_level(spark, sf_dir):
    """The diff of two root trees that enters no equal subtree."""
    return diff(*_forest(spark, sf_dir))


@query("SELECT path, mode, oid || '00000000' AS oid FROM base_tree WHERE path LIKE '12/%' OR path = '12'")
def tree_walk_below(spark, sf_dir):
    rows, root, _ = _forest(spark, sf_dir)
    return walk(rows, root, below="12")


@query("SELECT count(DISTINCT oid) AS blobs, count(DISTINCT split_part(path, '/', 1)) > 0 AS has_folders FROM (SELECT oid, path FROM base_tree UNION ALL SELECT oid, path FROM tree_a)")
def object_closure_of_trees(spark, sf_dir):
    """Everything below two roots, each object once."""
    rows, a, b = _forest(spark, sf_dir)
    found = closure(rows, spark.createDataFrame([(a,), (b,)], "oid string"))
    return found.agg(F.count_if(F.col("mode") != FOLDER).alias("blobs"), (F.count_if(F.col("mode") == FOLDER) > 2).alias("has_folders"))


@query("SELECT count(*) + count(DISTINCT split_part(path, '/', 1)) AS rows, CAST(0 AS BIGINT) AS wrong FROM base_tree")
def tree_post_order(spark, sf_dir):
    """Every folder stands behind all it holds."""
    rows, root, _ = _forest(spark, sf_dir)
    placed = written(post_order(walk(rows, root, folders=True)), "placed")
    inner = placed.where(F.col("mode") != FOLDER).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), "pos")
    bad = inner.join(placed.where(F.col("mode") == FOLDER).select(F.col("path").alias("folder"), F.col("pos").alias("own")), "folder").where("pos > own")
    return placed.agg(F.count("*").alias("rows")).join(bad.agg(F.count("*").alias("wrong")), F.lit(True))
