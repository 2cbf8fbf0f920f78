"""Joins of trees by path: diffs, status, three-way merges, exact renames, stages, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annals.plans.history import blobs, commits, reflog, trees
from annals.registry import query
from annals.session import table


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change_type, path, old_mode, new_mode, old_id, new_id) of paths whose mode or content differs; one join, no order implied."""
    a = old.select("path", F.col("mode").alias("old_mode"), F.col("oid").alias("old_id"))
    b = new.select("path", F.col("mode").alias("new_mode"), F.col("oid").alias("new_id"))
    kind = F.when(F.col("old_id").isNull(), "ADD").when(F.col("new_id").isNull(), "DELETE").otherwise("MODIFY")
    changed = ~(F.col("old_id").eqNullSafe(F.col("new_id")) & F.col("old_mode").eqNullSafe(F.col("new_mode")))
    return a.join(b, "path", "full").where(changed).select(kind.alias("change_type"), "path", "old_mode", "new_mode", "old_id", "new_id")


_DIFF = """SELECT CASE WHEN a.oid IS NULL THEN 'ADD' WHEN b.oid IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS change_type, coalesce(a.path, b.path) AS path,
a.mode AS old_mode, b.mode AS new_mode, a.oid AS old_id, b.oid AS new_id FROM {0} a FULL JOIN {1} b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid OR a.mode IS DISTINCT FROM b.mode"""


@query(_DIFF.format("base_tree", "tree_a"))
def tree_diff(spark, sf_dir):
    base, ours, _ = trees(spark, sf_dir)
    return diff(base, ours)


@query("d AS (" + _DIFF.format("base_tree", "tree_a") + ") SELECT change_type, count(*) AS n, count(*) FILTER (WHERE old_mode <> new_mode) AS mode_changes FROM d GROUP BY change_type")
def diff_statistics(spark, sf_dir):
    base, ours, _ = trees(spark, sf_dir)
    return diff(base, ours).groupBy("change_type").agg(F.count("*").alias("n"), F.count_if(F.col("old_mode") != F.col("new_mode")).alias("mode_changes"))


@query("d AS (" + _DIFF.format("base_tree", "tree_a") + ") SELECT path, change_type, row_number() OVER (ORDER BY path, CASE change_type WHEN 'DELETE' THEN 0 WHEN 'ADD' THEN 1 ELSE 2 END) AS pos FROM d ORDER BY pos LIMIT 100")
def diff_order(spark, sf_dir):
    """The first hundred rows in diff order; only those are numbered."""
    base, ours, _ = trees(spark, sf_dir)
    rank = F.when(F.col("change_type") == "DELETE", 0).when(F.col("change_type") == "ADD", 1).otherwise(2)
    top = diff(base, ours).select("path", "change_type", rank.alias("rank")).orderBy("path", "rank").limit(100)
    return top.select("path", "change_type", F.row_number().over(Window.orderBy("path", "rank")).cast("long").alias("pos"))


@query("""n AS (SELECT split_part(path, '/', 1) AS name, count(*) AS entries FROM base_tree GROUP BY 1),
m AS (SELECT CAST(l_orderkey AS VARCHAR) AS name FROM items WHERE part % 19 = 0 AND l_linenumber = 1) SELECT name, entries FROM n JOIN m USING (name)""")
def name_conflict_diff(spark, sf_dir):
    """Names that are a directory in one tree and a file in the other."""
    from annals.plans.history import _items

    base, _, _ = trees(spark, sf_dir)
    folders = base.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("name")).agg(F.count("*").alias("entries"))
    files = _items(spark, sf_dir).where("part % 19 = 0 and l_linenumber = 1").select(F.col("l_orderkey").cast("string").alias("name"))
    return folders.join(files, "name").select("name", "entries")


@query("""SELECT coalesce(h.path, i.path, w.path) AS path,
(h.oid IS NULL AND i.oid IS NOT NULL) AS added, (h.oid IS NOT NULL AND i.oid IS NULL) AS removed, (h.oid IS NOT NULL AND i.oid IS NOT NULL AND (h.oid <> i.oid OR h.mode <> i.mode)) AS changed,
(i.oid IS NOT NULL AND w.oid IS NULL) AS missing, (i.oid IS NOT NULL AND w.oid IS NOT NULL AND (i.oid <> w.oid OR i.mode <> w.mode)) AS modified, (i.oid IS NULL AND w.oid IS NOT NULL) AS untracked
FROM base_tree h FULL JOIN tree_b i ON h.path = i.path FULL JOIN tree_a w ON coalesce(h.path, i.path) = w.path
WHERE NOT (h.oid IS NOT DISTINCT FROM i.oid AND i.oid IS NOT DISTINCT FROM w.oid AND h.mode IS NOT DISTINCT FROM i.mode AND i.mode IS NOT DISTINCT FROM w.mode)""")
def status_three_way(spark, sf_dir):
    """Head, index and work tree: a path may be in several sets."""
    h, w, i = trees(spark, sf_dir)
    named = lambda t, n: t.select("path", F.struct("mode", "oid").alias(n))
    rows = named(h, "h").join(named(i, "i"), "path", "full").join(named(w, "w"), "path", "full").where("not (h <=> i and i <=> w)")
    return rows.selectExpr("path", "h is null and i is not null as added", "h is not null and i is null as removed", "h is not null and i is not null and h <> i as changed", "i is not null and w is null as missing", "i is not null and w is not null and i <> w as modified", "i is null and w is not null as untracked")


_THREE = "FROM base_tree b FULL JOIN tree_a o ON b.path = o.path FULL JOIN tree_b t ON coalesce(b.path, o.path) = t.path"
_SAME = "({0}.oid IS NOT DISTINCT FROM {1}.oid AND {0}.mode IS NOT DISTINCT FROM {1}.mode)"
_RULES = f"""CASE WHEN o.oid IS NOT NULL AND o.oid = t.oid AND o.mode = t.mode THEN 'keep' WHEN o.oid IS NOT NULL AND o.oid = t.oid THEN CASE WHEN b.mode IS NOT DISTINCT FROM o.mode THEN 'take theirs' WHEN b.mode IS NOT DISTINCT FROM t.mode THEN 'keep' ELSE 'mode conflict' END
WHEN {_SAME.format('b', 't')} THEN CASE WHEN o.oid IS NULL THEN 'deleted' ELSE 'keep' END WHEN {_SAME.format('b', 'o')} THEN CASE WHEN t.oid IS NULL THEN 'delete' ELSE 'take theirs' END
WHEN o.oid IS NULL AND t.oid IS NULL THEN 'deleted' WHEN o.oid IS NULL OR t.oid IS NULL THEN 'modify/delete conflict' ELSE 'content merge' END"""


@query(f"SELECT coalesce(b.path, o.path, t.path) AS path, {_RULES} AS decision {_THREE}")
def three_way_tree_merge(spark, sf_dir):
    """The decision of a merge for every path; the first rule that fits wins."""
    b, o, t = trees(spark, sf_dir)
    named = lambda x, n: x.select("path", F.struct("mode", "oid").alias(n))
    rows = named(b, "b").join(named(o, "o"), "path", "full").join(named(t, "t"), "path", "full")
    rule = """case when o is not null and o <=> t then 'keep'
      when o.oid is not null and o.oid <=> t.oid then case when b.mode <=> o.mode then 'take theirs' when b.mode <=> t.mode then 'keep' else 'mode conflict' end
      when b <=> t then if(o is null, 'deleted', 'keep') when b <=> o then if(t is null, 'delete', 'take theirs')
      when o is null and t is null then 'deleted' when o is null or t is null then 'modify/delete conflict' else 'content merge' end"""
    return rows.select("path", F.expr(rule).alias("decision"))


@query(f"""c AS (SELECT coalesce(b.path, o.path, t.path) AS path, b.oid AS b, o.oid AS o, t.oid AS t, {_RULES} AS decision {_THREE})
SELECT path, CAST((CASE WHEN b IS NULL THEN 0 ELSE 1 END) + (CASE WHEN o IS NULL THEN 0 ELSE 2 END) + (CASE WHEN t IS NULL THEN 0 ELSE 4 END) AS INTEGER) AS mask FROM c WHERE decision LIKE '%conflict' OR decision = 'content merge'""")
def stage_collapse(spark, sf_dir):
    """The stages of conflicting paths as one bit mask a path."""
    b, o, t = trees(spark, sf_dir)
    open_ = three_way_tree_merge(spark, sf_dir).where("decision like '%conflict' or decision = 'content merge'").select("path")
    stages = b.select("path", F.lit(1).alias("stage")).unionByName(o.select("path", F.lit(2).alias("stage"))).unionByName(t.select("path", F.lit(4).alias("stage")))
    return stages.join(open_, "path", "left_semi").groupBy("path").agg(F.bit_or("stage").alias("mask"))


@query("""SELECT coalesce(i.path, o.path) AS path, CASE WHEN o.oid IS NULL THEN 'remove' WHEN i.oid IS NULL THEN 'create' WHEN i.oid <> o.oid THEN 'update' ELSE 'chmod' END AS action
FROM base_tree i FULL JOIN tree_b o ON i.path = o.path WHERE i.oid IS DISTINCT FROM o.oid OR i.mode IS DISTINCT FROM o.mode""")
def checkout_plan(spark, sf_dir):
    base, _, target = trees(spark, sf_dir)
    d = diff(base, target)
    action = F.when(F.col("change_type") == "DELETE", "remove").when(F.col("change_type") == "ADD", "create").when(F.col("old_id") != F.col("new_id"), "update").otherwise("chmod")
    return d.select("path", action.alias("action"))


def renames(gone: DataFrame, made: DataFrame) -> DataFrame:
    """(old_path, new_path, oid): in each content the n-th deleted path pairs with the n-th added one, in path order.

    Contents meet by equal id; pairing by rank never forms all pairs of a content.
    """
    rank = F.row_number().over(Window.partitionBy("oid").orderBy("path"))
    a = gone.select("oid", F.col("path").alias("old_path"), rank.alias("n"))
    b = made.select("oid", F.col("path").alias("new_path"), rank.alias("n"))
    return a.join(b, ["oid", "n"]).select("old_path", "new_path", "oid")


@query("""gone AS (SELECT oid, 'old/' || doc_id AS path FROM blobs WHERE doc_id % 2 = 0), made AS (SELECT oid, 'new/' || doc_id AS path FROM blobs WHERE doc_id % 2 = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY path) AS n FROM gone), m AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY path) AS n FROM made)
SELECT g.path AS old_path, m.path AS new_path, oid FROM g JOIN m USING (oid, n)""")
def exact_rename(spark, sf_dir):
    rows = blobs(spark, sf_dir)
    path = lambda p: F.concat(F.lit(p), "doc_id").alias("path")
    return renames(rows.where("doc_id % 2 = 0").select("oid", path("old/")), rows.where("doc_id % 2 = 1").select("oid", path("new/")))


@query("""SELECT c.oid, n.quality, n.toxic FROM commits c LEFT JOIN labels n ON n.doc_id = c.oid""")
def notes_join(spark, sf_dir):
    notes = table(spark, sf_dir, "labels")
    return commits(spark, sf_dir).select("oid").join(notes, F.col("doc_id") == F.col("oid"), "left").select("oid", "quality", "toxic")


@query("""base AS (SELECT doc_id, quality AS note FROM labels WHERE doc_id % 3 <> 0), ours AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN quality + 1 ELSE quality END AS note FROM labels WHERE doc_id % 7 <> 0),
theirs AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN quality + 2 ELSE quality END AS note FROM labels WHERE doc_id % 11 <> 0)
SELECT coalesce(b.doc_id, o.doc_id, t.doc_id) AS doc_id, CASE WHEN o.note IS NOT DISTINCT FROM t.note OR b.note IS NOT DISTINCT FROM t.note THEN CAST(o.note AS VARCHAR) WHEN b.note IS NOT DISTINCT FROM o.note THEN CAST(t.note AS VARCHAR)
WHEN o.note IS NULL THEN CAST(t.note AS VARCHAR) WHEN t.note IS NULL THEN CAST(o.note AS VARCHAR) ELSE o.note || chr(10) || t.note END AS note
FROM base b FULL JOIN ours o ON b.doc_id = o.doc_id FULL JOIN theirs t ON coalesce(b.doc_id, o.doc_id) = t.doc_id""")
def notes_merge(spark, sf_dir):
    """Three-way merge of notes; where both sides changed one differently, both texts stay."""
    rows = table(spark, sf_dir, "labels")
    b = rows.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("b"))
    o = rows.where("doc_id % 7 <> 0").select("doc_id", F.expr("if(doc_id % 5 = 0, quality + 1, quality)").alias("o"))
    t = rows.where("doc_id % 11 <> 0").select("doc_id", F.expr("if(doc_id % 4 = 0, quality + 2, quality)").alias("t"))
    all_ = b.join(o, "doc_id", "full").join(t, "doc_id", "full")
    note = F.expr("case when o <=> t or b <=> t then string(o) when b <=> o then string(t) when o is null then string(t) when t is null then string(o) else concat(o, '\\n', t) end")
    return all_.select("doc_id", note.alias("note"))


@query("""asked AS (SELECT conv_id, 2 AS upto FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, max(turn) AS update_index, arg_max(role, turn) AS who FROM conversations JOIN asked USING (conv_id) WHERE turn <= upto GROUP BY conv_id""")
def reflog_asof(spark, sf_dir):
    """The state of each ref at an index: the last entry up to it, as one aggregation."""
    rows = reflog(spark, sf_dir).where("update_index <= 2")
    return rows.groupBy(F.regexp_extract("ref", r"(\d+)$", 1).cast("long").alias("conv_id")).agg(F.max("update_index").alias("update_index"), F.max_by("who", "update_index").alias("who"))


@query("SELECT oid, min(doc_id) AS loose FROM blobs WHERE doc_id % 3 = 0 AND oid IN (SELECT oid FROM blobs WHERE doc_id % 3 <> 0) GROUP BY oid")
def prune_packed(spark, sf_dir):
    """Loose objects that a pack already holds."""
    rows = blobs(spark, sf_dir)
    return rows.where("doc_id % 3 = 0").join(rows.where("doc_id % 3 <> 0").select("oid"), "oid", "left_semi").groupBy("oid").agg(F.min("doc_id").alias("loose"))


@query("""r AS (SELECT doc_id, doc_id % 40 AS a, doc_id % 40 + 10 AS z FROM documents WHERE doc_id % 2 = 0)
SELECT r.doc_id, l.line_no FROM r JOIN lines l ON l.doc_id = r.doc_id AND l.line_no >= a AND l.line_no < z""")
def blame_cache_range_join(spark, sf_dir):
    """Lines within cached regions: a range join that is bounded by the equal document."""
    from annals.plans.history import lines

    region = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 40).alias("a"))
    return lines(spark, sf_dir).join(region, "doc_id").where("line_no >= a and line_no < a + 10").select("doc_id", "line_no")
