"""Walks over the commit graph: reachability, set differences, merge bases, refs that contain a commit, depths."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals.operators.logs import numbered
from annals.plans.closure import carry, depths, generations, reach
from annals.plans.history import commits, edges, refs, tags, tips
from annals.plans.jump import ends
from annals.plans.shared import written
from annals.registry import query


def two_sided(spark, sf_dir):
    """(oid, value): bit 1 for the first tip's history, bit 2 for the second's."""
    a, b = tips(spark, sf_dir)
    return carry(edges(spark, sf_dir), spark.createDataFrame([(a, 1), (b, 2)], "oid long, value long"))


@query("SELECT oid FROM ra")
def reachable(spark, sf_dir):
    return reach(edges(spark, sf_dir), [tips(spark, sf_dir)[0]])


@query("SELECT c.oid, commit_time, author, message FROM commits c JOIN ra USING (oid) WHERE oid NOT IN (SELECT oid FROM rb)")
def difference(spark, sf_dir):
    only = two_sided(spark, sf_dir).where("value = 1").select("oid")
    return commits(spark, sf_dir).join(only, "oid", "left_semi").select("oid", "commit_time", "author", "message")


@query("SELECT oid FROM ra INTERSECT SELECT oid FROM rb")
def intersect_common(spark, sf_dir):
    return two_sided(spark, sf_dir).where("value = 3").select("oid")


@query("SELECT oid FROM ra UNION SELECT oid FROM rb")
def union_starts(spark, sf_dir):
    return reach(edges(spark, sf_dir), list(tips(spark, sf_dir)))


@query("SELECT * FROM (SELECT oid FROM ra EXCEPT SELECT oid FROM rb) UNION ALL (SELECT oid FROM rb EXCEPT SELECT oid FROM ra)")
def symmetric_difference(spark, sf_dir):
    return two_sided(spark, sf_dir).where("value <> 3").select("oid")


@query("f(oid, pos) AS (SELECT a, 0 FROM tip UNION ALL SELECT parent, pos + 1 FROM f JOIN edges ON child = f.oid AND nth = 0) SELECT oid, CAST(pos AS BIGINT) AS pos FROM f")
def first_parent(spark, sf_dir):
    return depths(edges(spark, sf_dir).where("nth = 0"), [tips(spark, sf_dir)[0]]).select("oid", F.col("value").alias("pos"))


@query("SELECT DISTINCT parent AS oid FROM edges WHERE child IN (SELECT oid FROM ra EXCEPT SELECT oid FROM rb) AND parent IN (SELECT oid FROM rb)")
def boundary(spark, sf_dir):
    """Excluded commits that are parents of included ones."""
    sides = two_sided(spark, sf_dir)
    inside, out = sides.where("value = 1").select(F.col("oid").alias("child")), sides.where("(value & 2) <> 0").select(F.col("oid").alias("parent"))
    return edges(spark, sf_dir).join(inside, "child", "left_semi").join(out, "parent", "left_semi").select(F.col("parent").alias("oid")).distinct()


@query("common AS (SELECT oid FROM ra INTERSECT SELECT oid FROM rb), below AS (SELECT DISTINCT parent AS oid FROM edges WHERE child IN (SELECT oid FROM common)) SELECT oid FROM common WHERE oid NOT IN (SELECT oid FROM below)")
def merge_base(spark, sf_dir):
    """Common ancestors that no other common ancestor reaches: the common set is closed under parents, so one step decides."""
    common = two_sided(spark, sf_dir).where("value = 3").select("oid")
    below = edges(spark, sf_dir).join(common, F.col("child") == F.col("oid"), "left_semi").select(F.col("parent").alias("oid"))
    return common.join(below, "oid", "left_anti")


@query("SELECT oid, oid IN (SELECT oid FROM ra) AS is_ancestor FROM commits WHERE oid % 50 = 0")
def is_ancestor(spark, sf_dir):
    """For every 50th commit, whether the newest commit reaches it."""
    found = reach(edges(spark, sf_dir), [tips(spark, sf_dir)[0]]).withColumn("hit", F.lit(True))
    return commits(spark, sf_dir).where("oid % 50 = 0").join(found, "oid", "left").select("oid", F.coalesce("hit", F.lit(False)).alias("is_ancestor"))


@query("up(oid) AS (SELECT b FROM tip UNION SELECT child FROM up JOIN edges ON parent = up.oid) SELECT name, refs.oid FROM refs JOIN up USING (oid)")
def refs_containing(spark, sf_dir):
    """Refs from which the older tip can be reached: its descendants, by reversed edges."""
    up = edges(spark, sf_dir).select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return refs(spark, sf_dir).join(reach(up, [tips(spark, sf_dir)[1]]), "oid", "left_semi").select("name", "oid")


@query("SELECT (SELECT count(*) FROM ra WHERE oid NOT IN (SELECT oid FROM rb)) AS ahead, (SELECT count(*) FROM rb WHERE oid NOT IN (SELECT oid FROM ra)) AS behind")
def ahead_behind(spark, sf_dir):
    return two_sided(spark, sf_dir).agg(F.count_if(F.col("value") == 1).alias("ahead"), F.count_if(F.col("value") == 2).alias("behind"))


@query("d(oid, depth) AS (SELECT a, 0 FROM tip UNION SELECT parent, depth + 1 FROM d JOIN edges ON child = d.oid WHERE depth < 9) SELECT oid, CAST(min(depth) AS BIGINT) AS depth FROM d GROUP BY oid")
def depth_limited(spark, sf_dir):
    """Ten levels of a shallow copy."""
    return depths(edges(spark, sf_dir), [tips(spark, sf_dir)[0]], most=9).select("oid", F.col("value").alias("depth"))


@query("g(oid, n) AS (SELECT oid, 1 FROM commits WHERE oid NOT IN (SELECT child FROM edges) UNION SELECT child, n + 1 FROM g JOIN edges ON parent = g.oid) SELECT oid, CAST(max(n) AS BIGINT) AS generation FROM g GROUP BY oid")
def generation_number(spark, sf_dir):
    return generations(edges(spark, sf_dir), commits(spark, sf_dir)).select("oid", F.col("value").alias("generation"))


@query("all_tips(oid) AS (SELECT refs.oid FROM refs WHERE name LIKE 'refs/heads/%' UNION SELECT parent FROM all_tips JOIN edges ON child = all_tips.oid) SELECT oid FROM commits WHERE oid NOT IN (SELECT oid FROM all_tips)")
def prune_unreachable(spark, sf_dir):
    """Commits that no head reaches."""
    heads = refs(spark, sf_dir).where("name like 'refs/heads/%'").select("oid")
    return commits(spark, sf_dir).select("oid").join(reach(edges(spark, sf_dir), heads), "oid", "left_anti")


@query("all_tips(oid) AS (SELECT refs.oid FROM refs WHERE name LIKE 'refs/heads/%' UNION SELECT parent FROM all_tips JOIN edges ON child = all_tips.oid) SELECT count(*) AS reachable, count(*) = (SELECT count(*) FROM commits) AS is_whole FROM all_tips")
def all_reachable_check(spark, sf_dir):
    heads = refs(spark, sf_dir).where("name like 'refs/heads/%'").select("oid")
    total = commits(spark, sf_dir).agg(F.count("*").alias("total"))
    return reach(edges(spark, sf_dir), heads).agg(F.count("*").alias("reachable")).join(total, F.lit(True)).select("reachable", (F.col("reachable") == F.col("total")).alias("is_whole"))


@query("SELECT child, parent FROM edges WHERE parent NOT IN (SELECT oid FROM commits WHERE oid % 97 <> 0)")
def connectivity_check(spark, sf_dir):
    """Edges to commits that a store without every 97th commit lacks."""
    store = commits(spark, sf_dir).where("oid % 97 <> 0").select(F.col("oid").alias("parent"))
    return edges(spark, sf_dir).select("child", "parent").join(store, "parent", "left_anti").select("child", "parent")


@query("SELECT oid FROM ra WHERE oid NOT IN (SELECT oid FROM rb)")
def want_minus_have(spark, sf_dir):
    """What a transfer sends: the closure of the wanted tip without that of the one the other side has."""
    return two_sided(spark, sf_dir).where("value = 1").select("oid")


@query("""starts AS (SELECT oid, 1 << (row_number() OVER (ORDER BY oid DESC) - 1)::INT AS bit FROM (SELECT oid FROM refs WHERE name LIKE 'refs/heads/%' ORDER BY oid DESC LIMIT 8)),
w(oid, bit) AS (SELECT oid, bit FROM starts UNION SELECT parent, bit FROM w JOIN edges ON child = w.oid) SELECT oid, CAST(bit_or(bit) AS BIGINT) AS flags FROM w GROUP BY oid""")
def flag_carry(spark, sf_dir):
    """Flags of the eight newest heads, carried to their ancestors."""
    heads = refs(spark, sf_dir).where("name like 'refs/heads/%'").orderBy(F.desc("oid")).limit(8).collect()
    start = spark.createDataFrame([(r.oid, 1 << k) for k, r in enumerate(heads)], "oid long, value long")
    return carry(edges(spark, sf_dir), start).select("oid", F.col("value").alias("flags"))


@query("SELECT oid FROM commits WHERE oid IN (SELECT child FROM edges GROUP BY child HAVING count(*) > 1)")
def merges_only(spark, sf_dir):
    many = edges(spark, sf_dir).groupBy("child").count().where("count > 1").select(F.col("child").alias("oid"))
    return commits(spark, sf_dir).select("oid").join(many, "oid", "left_semi")


@query("SELECT oid FROM commits WHERE oid NOT IN (SELECT child FROM edges GROUP BY child HAVING count(*) > 1)")
def no_merges(spark, sf_dir):
    many = edges(spark, sf_dir).groupBy("child").count().where("count > 1").select(F.col("child").alias("oid"))
    return commits(spark, sf_dir).select("oid").join(many, "oid", "left_anti")


@query("""d(oid, depth) AS (SELECT a, 0 FROM tip UNION SELECT parent, depth + 1 FROM d JOIN edges ON child = d.oid),
near AS (SELECT oid, min(depth) AS depth FROM d GROUP BY oid)
SELECT name, CAST(depth AS BIGINT) AS depth FROM tags JOIN near ON object = oid ORDER BY depth, object DESC LIMIT 1""")
def describe(spark, sf_dir):
    """The tag nearest to the newest commit, the later one among equals, with its distance."""
    near = depths(edges(spark, sf_dir), [tips(spark, sf_dir)[0]])
    return tags(spark, sf_dir).join(near, F.col("object") == F.col("oid")).orderBy("value", F.desc("object")).limit(1).select("name", F.col("value").alias("depth"))


@query("""touch AS (SELECT oid, message = 'purchase' AS hit FROM commits), f(oid, pos) AS (SELECT a, 0 FROM tip UNION ALL SELECT parent, pos + 1 FROM f JOIN edges ON child = f.oid AND nth = 0),
kept AS (SELECT f.oid, pos FROM f JOIN touch ON f.oid = touch.oid WHERE hit)
SELECT oid, lead(oid) OVER (ORDER BY pos) AS rewritten_parent FROM kept""")
def rewrite_parents(spark, sf_dir):
    """A first-parent history limited to one kind of commit, each with its nearest kept ancestor as parent: chains of left-out commits end by pointer jumping."""
    first = edges(spark, sf_dir).where("nth = 0")
    chain = depths(first, [tips(spark, sf_dir)[0]]).select("oid")
    wanted = commits(spark, sf_dir).where("message = 'purchase'").select("oid")
    line = first.join(chain.select(F.col("oid").alias("child")), "child", "left_semi")
    far = ends(line.join(wanted.select(F.col("oid").alias("child")), "child", "left_anti").select(F.col("child").alias("node"), F.col("parent").alias("to")))
    kept = chain.join(wanted, "oid", "left_semi")
    above = kept.join(line.select(F.col("child").alias("oid"), "parent"), "oid", "left").join(far.select(F.col("node").alias("parent"), "to"), "parent", "left").select("oid", F.coalesce("to", "parent").alias("to"))
    return above.join(wanted.select(F.col("oid").alias("to"), F.lit(True).alias("fine")), "to", "left").select("oid", F.when(F.col("fine"), F.col("to")).alias("rewritten_parent"))


@query("SELECT oid, commit_time FROM commits JOIN ra USING (oid) ORDER BY commit_time DESC, oid DESC LIMIT 50")
def commit_time_desc(spark, sf_dir):
    found = reach(edges(spark, sf_dir), [tips(spark, sf_dir)[0]])
    return commits(spark, sf_dir).join(found, "oid", "left_semi").orderBy(F.desc("commit_time"), F.desc("oid")).limit(50).select("oid", "commit_time")


@query("SELECT * FROM (SELECT oid, commit_time FROM commits JOIN ra USING (oid) ORDER BY commit_time DESC, oid DESC OFFSET 20)")
def skip_n(spark, sf_dir):
    """All but the twenty newest: numbered by ranges, so that no task sees all rows."""
    found = reach(edges(spark, sf_dir), [tips(spark, sf_dir)[0]])
    mine = commits(spark, sf_dir).join(found, "oid", "left_semi").select("oid", "commit_time")
    rest = numbered(mine.select("oid", F.struct((-F.unix_micros(F.col("commit_time").cast("timestamp"))).alias("t"), (-F.col("oid")).alias("o")).alias("key"))).where("pos > 20")
    return mine.join(rest.select("oid"), "oid", "left_semi")


@query("""g(oid, n) AS (SELECT oid, 1 FROM commits WHERE oid NOT IN (SELECT child FROM edges) UNION SELECT child, n + 1 FROM g JOIN edges ON parent = g.oid), gen AS (SELECT oid, max(n) AS n FROM g GROUP BY oid)
SELECT oid, row_number() OVER (ORDER BY n DESC, oid DESC) AS pos FROM gen JOIN ra USING (oid)""")
def topo_order(spark, sf_dir):
    """Children before parents: by generation, then newest first; a distributed sort. The exact date order is ``topo_by_date``."""
    found = reach(edges(spark, sf_dir), [tips(spark, sf_dir)[0]])
    rows = generations(edges(spark, sf_dir), commits(spark, sf_dir)).join(found, "oid", "left_semi")
    return numbered(rows.select("oid", F.struct((-F.col("value")).alias("g"), (-F.col("oid")).alias("o")).alias("key"))).select("oid", F.col("pos").cast("long").alias("pos"))


@query("SELECT DISTINCT b.oid, b.size FROM ra JOIN blobs b ON b.doc_id = ra.oid")
def object_closure(spark, sf_dir):
    """Contents that the history of the newest commit holds."""
    from annals.plans.history import blobs

    found = reach(edges(spark, sf_dir), [tips(spark, sf_dir)[0]]).withColumnRenamed("oid", "doc_id")
    return blobs(spark, sf_dir).join(found, "doc_id", "left_semi").select("oid", "size").distinct()


@query("""f AS (SELECT child, parent FROM edges WHERE nth = 0)
SELECT c.oid, c.message FROM ra JOIN commits c USING (oid) LEFT JOIN f ON f.child = c.oid LEFT JOIN commits p ON p.oid = f.parent WHERE p.message IS DISTINCT FROM c.message""")
def path_limited_log(spark, sf_dir):
    """Reachable commits that differ from their first parent; a root differs from nothing."""
    e = edges(spark, sf_dir)
    mine = commits(spark, sf_dir).select("oid", "message").join(reach(e, [tips(spark, sf_dir)[0]]), "oid", "left_semi")
    first = e.where("nth = 0").select(F.col("child").alias("oid"), "parent")
    before = commits(spark, sf_dir).select(F.col("oid").alias("parent"), F.col("message").alias("old"))
    return mine.join(first, "oid", "left").join(before, "parent", "left").where("not message <=> old").select("oid", "message")


def parse_revision(text: str) -> tuple[str, list[tuple[str, int]]]:
    """``u7~3^2`` -> ("u7", [("~", 3), ("^", 2)]); a bare mark counts one."""
    import re

    m = re.fullmatch(r"([^~^\s]+)((?:[~^]\d*)*)", text)
    if not m:
        raise ValueError(f"not a revision: {text!r}")
    return m[1], [(k, int(n) if n else 1) for k, n in re.findall(r"([~^])(\d*)", m[2])]


def resolve(spark, sf_dir, text: str, known=None):
    """(oid) of a revision, no row where a step has no parent; one small job for each step. known: the edges, if they are at hand."""
    name, steps = parse_revision(text)
    places = [name, f"refs/{name}", f"refs/tags/{name}", f"refs/heads/{name}", f"refs/remotes/{name}"]
    rank = F.array_position(F.array(*map(F.lit, places)), F.col("name"))
    at = refs(spark, sf_dir).where(F.col("name").isin(places)).orderBy(rank).limit(1).select("oid")
    e = edges(spark, sf_dir) if known is None else known
    for kind, n in steps:
        if not n:
            continue
        if kind == "^":
            at = e.where(F.col("nth") == n - 1).join(F.broadcast(at), F.col("child") == F.col("oid")).select(F.col("parent").alias("oid"))
        else:
            row = at.first()
            if row is None:
                return at
            at = depths(e.where("nth = 0"), [row.oid], most=n).where(F.col("value") == n).select("oid")
    return at


@query("""heads AS (SELECT name, oid FROM refs WHERE name IN ('refs/heads/u7', 'refs/heads/u3')), p1 AS (SELECT name, parent AS oid FROM heads JOIN edges ON child = oid AND nth = 0), p2 AS (SELECT name, parent AS oid FROM p1 JOIN edges ON child = oid AND nth = 0)
SELECT 'u7' AS revision, oid FROM heads WHERE name = 'refs/heads/u7' UNION ALL SELECT 'heads/u7~2', oid FROM p2 WHERE name = 'refs/heads/u7' UNION ALL SELECT 'u3^', oid FROM p1 WHERE name = 'refs/heads/u3'""")
def rev_parse(spark, sf_dir):
    out, e = None, written(edges(spark, sf_dir), "edges")
    for text in ("u7", "heads/u7~2", "u3^"):
        one = resolve(spark, sf_dir, text, e).select(F.lit(text).alias("revision"), "oid")
        out = one if out is None else out.unionByName(one)
    return out
