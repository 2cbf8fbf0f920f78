"""Renames and copies: equal contents first, then similar ones, between the deleted and the added paths of a diff.

Equal contents meet by id. Per content the pairing depends on names only, so a content's paths are one group; where a content has more paths
than GROUP, pairs are made by rank in path order instead of by all name scores, and copies are still complete.
Similar contents meet by their blocks (a line, or 64 bytes of one): pairs are counted from common blocks, never formed by a cross join; blocks that more than
OFTEN contents have don't make a pair a candidate, but count in the scores of all candidates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annals.operators.alignment import blocks, common_bytes, name_score
from annals.plans.history import blobs
from annals.plans.shared import written
from annals.registry import query
from annals.session import table

GROUP, OFTEN, SCORE, BREAK = 1000, 1000, 60, 90
RENAME = "kind string, old_path string, new_path string, oid string, score int"


def best_names(gone: list[str], made: list[str]) -> list[tuple[str, str, str]]:
    """(kind, old, new) for the paths of one content: each added path from the old path of best name; an old path's first use is a rename, others are copies."""
    if not gone or not made:
        return []
    pairs = sorted((-name_score(a, b), a, b) for a in gone for b in made)
    used, done, out = set(), set(), []
    for _, a, b in pairs:  # renames: best pairs of unused paths
        if a not in used and b not in done:
            used.add(a)
            done.add(b)
            out.append(("RENAME", a, b))
    for _, a, b in pairs:
        if b not in done:
            done.add(b)
            out.append(("COPY", a, b))
    return out


def exact(gone: DataFrame, made: DataFrame, group: int = GROUP) -> DataFrame:
    """(kind, old_path, new_path, oid, score 100) of deleted and added paths (path, oid) of equal content."""
    both = gone.select("oid", "path", F.lit(True).alias("old")).unionByName(made.select("oid", "path", F.lit(False).alias("old")))
    sizes = both.groupBy("oid").agg(F.count_if("old").alias("n"), F.count_if(~F.col("old")).alias("m")).where("n > 0 and m > 0")
    few = both.join(sizes.where(F.col("n") * F.col("m") <= group), "oid").select("oid", "path", "old")

    def named(rows: pa.Table) -> pa.Table:
        paths = list(zip(rows.column("path").to_pylist(), rows.column("old").to_pylist()))
        out = best_names([p for p, old in paths if old], [p for p, old in paths if not old])
        oid = rows.column("oid")[0].as_py()
        return pa.table({"kind": pa.array([r[0] for r in out], pa.string()), "old_path": pa.array([r[1] for r in out], pa.string()), "new_path": pa.array([r[2] for r in out], pa.string()), "oid": pa.array([oid] * len(out), pa.string()), "score": pa.array([100] * len(out), pa.int32())})

    found = few.groupBy("oid").applyInArrow(named, RENAME)
    many = sizes.where(F.col("n") * F.col("m") > group)
    # ranks in two steps, by ranges of paths, so that one content's paths aren't in one task
    rank = lambda rows: _ranked(rows.join(many.select("oid", "n"), "oid"))
    a, b = rank(gone), rank(made)
    pair = b.join(a.select("oid", "n_th", F.col("path").alias("old_path")), ["oid", "n_th"]).select(F.lit("RENAME").alias("kind"), "old_path", F.col("path").alias("new_path"), "oid")
    first = gone.join(many.select("oid"), "oid").groupBy("oid").agg(F.min("path").alias("old_path"))
    copies = b.where(F.col("n_th") > F.col("n")).join(first, "oid").select(F.lit("COPY").alias("kind"), "old_path", F.col("path").alias("new_path"), "oid")
    return found.unionByName(pair.unionByName(copies).withColumn("score", F.lit(100)))


def _ranked(rows: DataFrame, parts: int = 256) -> DataFrame:
    """rows (oid, path, ..) with n_th, the place of a path within its content; by the hash of paths, then by path."""
    cut = rows.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)))
    base = cut.groupBy("oid", "part").agg(F.count("*").alias("c"))
    base = base.withColumn("base", F.sum("c").over(Window.partitionBy("oid").orderBy("part")) - F.col("c")).drop("c")
    return cut.join(base, ["oid", "part"]).withColumn("n_th", F.col("base") + F.row_number().over(Window.partitionBy("oid", "part").orderBy("path"))).drop("part", "base")


def _block_rows(sides: DataFrame) -> DataFrame:
    """(side, path, size, block, bytes) of contents (side, path, data)."""
    import hashlib

    def run(it):
        for big in it:
            for at in range(0, big.num_rows, 64):
                batch, rows = big.slice(at, 64), []
                for side, path, data in zip(*(batch.column(c).to_pylist() for c in ("side", "path", "data"))):
                    found = blocks(data or b"")
                    size = sum(found.values())
                    rows += [(side, path, size, int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "big", signed=True), n) for b, n in found.items()]
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["side", "path", "size", "block", "bytes"])

    return sides.mapInArrow(run, "side int, path string, size long, block long, bytes long")


def similar(gone: DataFrame, made: DataFrame, least: int = SCORE, often: int = OFTEN) -> DataFrame:
    """(old_path, new_path, score) of all pairs of contents (path, data) with a score of least or more; score: common bytes to the larger side's, 99 of 100, and names for the rest."""
    sides = gone.select(F.lit(0).alias("side"), "path", "data").unionByName(made.select(F.lit(1).alias("side"), "path", "data"))
    rows = written(_block_rows(sides), "blocks")
    counts = rows.groupBy("block").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    a = rows.where("side = 0").select("block", F.col("path").alias("old_path"), F.col("size").alias("old_size"), F.col("bytes").alias("old_bytes"))
    b = rows.where("side = 1").select("block", F.col("path").alias("new_path"), F.col("size").alias("new_size"), F.col("bytes").alias("new_bytes"))
    rare = counts.where((F.col("n") > 0) & (F.col("m") > 0) & (F.col("n") * F.col("m") <= often * often)).select("block")
    # what one pair shares in blocks that aren't frequent, and the most it could share in the others
    pairs = a.join(rare, "block").join(b, "block").where(F.least("old_size", "new_size") * 100 >= F.greatest("old_size", "new_size") * least)
    common = pairs.groupBy("old_path", "new_path", "old_size", "new_size").agg(F.sum(F.least("old_bytes", "new_bytes")).alias("shared"))
    frequent = counts.where((F.col("n") > 0) & (F.col("m") > 0) & (F.col("n") * F.col("m") > often * often)).select("block")
    over_a = a.join(frequent, "block").groupBy("old_path").agg(F.collect_list(F.struct("block", F.col("old_bytes").alias("bytes"))).alias("x"))
    over_b = b.join(frequent, "block").groupBy("new_path").agg(F.collect_list(F.struct("block", F.col("new_bytes").alias("bytes"))).alias("y"))
    more = F.expr("coalesce(aggregate(x, 0L, (s, p) -> s + coalesce(aggregate(filter(y, q -> q.block = p.block), 0L, (t, q) -> t + least(p.bytes, q.bytes)), 0L)), 0L)")
    common = common.join(over_a, "old_path", "left").join(over_b, "new_path", "left").withColumn("shared", F.col("shared") + more)
    names = F.udf(name_score, "int")
    scored = common.withColumn("content", F.expr("shared * 10000 div greatest(old_size, new_size)")).where(F.col("content") >= least * 100)
    scored = scored.withColumn("named", names("old_path", "new_path"))
    return scored.select("old_path", "new_path", F.expr("cast((content * 99 + named * 100) div 10000 as int)").alias("score")).where(F.col("score") >= least)


def matched(scores: DataFrame) -> DataFrame:
    """Of scored pairs (old_path, new_path, score) a greedy matching, best first, ties by paths: each path in one pair.

    Rounds: a pair that is the best of both its paths is taken, pairs of taken paths go; each round takes at least the best pair left, and few are needed.
    """
    rest, taken = written(scores, "scores"), None
    while not rest.isEmpty():
        key = F.struct((-F.col("score")).alias("k"), "old_path", "new_path")
        best_a = rest.groupBy("old_path").agg(F.min(key).alias("a"))
        best_b = rest.groupBy("new_path").agg(F.min(key).alias("b"))
        now = written(rest.join(best_a, "old_path").join(best_b, "new_path").where((F.col("a") == key) & (F.col("b") == key)).select("old_path", "new_path", "score"), "pairs")
        taken = now if taken is None else taken.unionByName(now)
        rest = written(rest.join(now.select("old_path"), "old_path", "left_anti").join(now.select("new_path"), "new_path", "left_anti"), "scores")
    return scores.limit(0) if taken is None else taken


def detect(gone: DataFrame, made: DataFrame, least: int = SCORE) -> DataFrame:
    """(kind, old_path, new_path, score): renames and copies among deleted and added contents (path, oid, data); equal ones first, then the most similar of what is left."""
    equal = written(exact(gone, made), "exact")
    left_a = gone.join(equal.where("kind = 'RENAME'").select(F.col("old_path").alias("path")), "path", "left_anti")
    left_b = made.join(equal.select(F.col("new_path").alias("path")), "path", "left_anti")
    near = matched(similar(left_a, left_b, least))
    return equal.select("kind", "old_path", "new_path", "score").unionByName(near.select(F.lit("RENAME").alias("kind"), "old_path", "new_path", "score"))


def broken(pairs: DataFrame, least: int = BREAK) -> tuple[DataFrame, DataFrame]:
    """Modified paths (path, old, new: contents) that are rewritten so much that they are a deletion and an addition: (deleted, added) as (path, data)."""
    score = F.udf(lambda a, b: common_bytes(blocks(a or b""), blocks(b or b"")) * 100 // max(len(a or b""), len(b or b""), 1), "int")
    apart = written(pairs.where(score("old", "new") < 100 - least), "broken")
    return apart.select("path", F.col("old").alias("data")), apart.select("path", F.col("new").alias("data"))


def rejoined(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Broken paths (path) neither side of which was renamed are modifications again: (path)."""
    used = found.select(F.col("old_path").alias("path")).unionByName(found.select(F.col("new_path").alias("path")))
    return parts.select("path").join(used, "path", "left_anti")


def restricted(found: DataFrame, paths: list[str]) -> DataFrame:
    """Renames of which one side lies in one of the paths; the scan of both trees is restricted before contents are read."""
    inside = lambda c: F.exists(F.array(*map(F.lit, paths)), lambda p: (F.col(c) == p) | F.startswith(F.col(c), F.concat(p, F.lit("/"))))
    return found.where(inside("old_path") | inside("new_path"))


_PATHS = "gone AS (SELECT oid, 'old/' || doc_id AS path FROM blobs WHERE doc_id % 3 = 0), made AS (SELECT oid, 'new/' || doc_id AS path FROM blobs WHERE doc_id % 3 <> 0)"


@query(_PATHS + """, c AS (SELECT oid, (SELECT count(*) FROM gone g WHERE g.oid = m.oid) AS n, count(*) AS m FROM made m GROUP BY oid)
SELECT oid, least(n, m) AS renames, greatest(m - n, 0) AS copies FROM c WHERE n > 0""")
def exact_renames_and_copies(spark, sf_dir):
    """For each content: as many renames as there are old paths, all further new ones copies."""
    rows = blobs(spark, sf_dir)
    path = lambda p: F.concat(F.lit(p), "doc_id").alias("path")
    found = exact(rows.where("doc_id % 3 = 0").select("oid", path("old/")), rows.where("doc_id % 3 <> 0").select("oid", path("new/")))
    return found.groupBy("oid").agg(F.count_if(F.col("kind") == "RENAME").alias("renames"), F.count_if(F.col("kind") == "COPY").alias("copies"))


@query("SELECT 'a/' || doc_id AS old_path, 'b/' || doc_id AS new_path FROM documents WHERE doc_id % 10 = 3")
def similar_renames(spark, sf_dir):
    """Contents moved with a line in front changed: each of them finds its own successor, among copies as elsewhere."""
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.concat(F.lit("own "), "doc_id", F.lit(" "), k, F.lit(" of the page"))), "\n")
    head = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 4), "\n")
    rows = table(spark, sf_dir, "documents").where("doc_id % 10 = 3").select("doc_id", F.concat(own, F.lit("\n"), F.left(head, F.lit(300))).alias("t"))
    gone = rows.select(F.concat(F.lit("a/"), "doc_id").alias("path"), F.col("t").cast("binary").alias("data"))
    made = rows.select(F.concat(F.lit("b/"), "doc_id").alias("path"), F.concat(F.lit("changed\n"), "t").cast("binary").alias("data"))
    return matched(similar(gone, made)).select("old_path", "new_path")
