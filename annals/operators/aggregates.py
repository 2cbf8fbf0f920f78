"""Aggregations and window-like operators over history: statistics, bitmaps, fan-outs, regions, latest-wins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annals.operators.walks import two_sided
from annals.plans.history import blobs, commits, edges, lines, reflog, refs, trees
from annals.registry import query
from annals.session import table


@query("h AS (SELECT substr(oid, 1, 2) AS fan, count(*) AS n FROM blobs GROUP BY 1) SELECT fan, n, CAST(sum(n) OVER (ORDER BY fan) AS BIGINT) AS upto FROM h")
def fanout_histogram(spark, sf_dir):
    """Objects by first byte with running sums; the window sees 256 rows at most."""
    rows = blobs(spark, sf_dir).groupBy(F.substr("oid", F.lit(1), F.lit(2)).alias("fan")).agg(F.count("*").alias("n"))
    return rows.select("fan", "n", F.sum("n").over(Window.orderBy("fan")).alias("upto"))


@query("""SELECT (SELECT count(*) FROM commits) AS commits, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM refs) AS refs, (SELECT count(*) FROM blobs) AS blobs,
(SELECT CAST(sum(size) AS BIGINT) FROM blobs) AS bytes, (SELECT count(*) FROM edges WHERE nth = 1) AS merges""")
def repo_statistics(spark, sf_dir):
    one = lambda df, *a: df.agg(*a)
    e = one(edges(spark, sf_dir), F.count("*").alias("edges"), F.count_if(F.col("nth") == 1).alias("merges"))
    b = one(blobs(spark, sf_dir), F.count("*").alias("blobs"), F.sum("size").alias("bytes"))
    parts = [one(commits(spark, sf_dir), F.count("*").alias("commits")), e, one(refs(spark, sf_dir), F.count("*").alias("refs")), b]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(p, F.lit(True))
    return out


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def pack_stats_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT message, author % 4 AS shard, count(*) AS n, CAST(GROUPING(message) * 2 + GROUPING(author % 4) AS BIGINT) AS level FROM commits GROUP BY CUBE (message, author % 4)")
def stats_cube(spark, sf_dir):
    return commits(spark, sf_dir).withColumn("shard", F.col("author") % 4).cube("message", "shard").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT author, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM commits GROUP BY author")
def running_stats(spark, sf_dir):
    v = F.col("value")
    return commits(spark, sf_dir).groupBy("author").agg(
        F.count("*").alias("n"), F.sum(F.round(v * 100).cast("long")).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("deviation")
    )


@query(None)
def approx_distinct_authors(spark, sf_dir):
    return commits(spark, sf_dir).groupBy("message").agg(F.approx_count_distinct("author", 0.02).alias("authors"))


@query("SELECT count(*) FILTER (WHERE v = 1) AS only_a, count(*) FILTER (WHERE v = 2) AS only_b, count(*) FILTER (WHERE v = 3) AS both_sides, count(*) AS either FROM (SELECT oid, CAST(sum(b) AS INTEGER) AS v FROM (SELECT oid, 1 AS b FROM ra UNION ALL SELECT oid, 2 FROM rb) GROUP BY oid)")
def bitmap_algebra(spark, sf_dir):
    """Or, and-not, xor and and of two reachability sets, by Spark's bitmap buckets."""
    sides = two_sided(spark, sf_dir)
    bits = sides.groupBy(F.bitmap_bucket_number("oid").alias("bucket")).agg(
        *[F.bitmap_construct_agg(F.when(F.col("value").bitwiseAND(b) != 0, F.bitmap_bit_position("oid"))).alias(n) for b, n in ((1, "a"), (2, "b"), (3, "either"))]
    )
    per = bits.select(F.bitmap_count("a").alias("a"), F.bitmap_count("b").alias("b"), F.bitmap_count("either").alias("either"))
    return per.agg(F.sum(F.col("either") - F.col("b")).alias("only_a"), F.sum(F.col("either") - F.col("a")).alias("only_b"), F.sum(F.col("a") + F.col("b") - F.col("either")).alias("both_sides"), F.sum("either").alias("either"))


@query("SELECT oid FROM commits WHERE (SELECT max(oid) FROM commits) - oid < 100 OR (oid % 100 = 0)")
def bitmap_commit_selection(spark, sf_dir):
    """Dense among the newest, sparse among the old."""
    rows = commits(spark, sf_dir).select("oid")
    last = rows.agg(F.max("oid").alias("last"))
    return rows.join(F.broadcast(last), F.lit(True)).where("last - oid < 100 or oid % 100 = 0").select("oid")


@query("""r AS (SELECT doc_id, line_no, length(trim(line, ' ')) > 0 AS full_line FROM lines), g AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, full_line ORDER BY line_no) AS island FROM r)
SELECT doc_id, min(line_no) AS first_line, count(*) AS length FROM g WHERE full_line GROUP BY doc_id, island""")
def region_coalesce(spark, sf_dir):
    """Neighbouring lines with text as one region."""
    rows = lines(spark, sf_dir).where("length(trim(line)) > 0")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("length")).drop("island")


@query("SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS message FROM conversations GROUP BY conv_id")
def merge_message(spark, sf_dir):
    """The entries of a ref as one message, in order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat("role", F.lit(":"), F.length("text")).alias("part")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["part"]), ",").alias("message"))


@query("SELECT child AS oid, list_sort(list(DISTINCT message)) AS paths FROM edges JOIN commits ON oid = parent GROUP BY child")
def changed_paths(spark, sf_dir):
    """What the parents of each commit touched, as a sorted set."""
    touched = commits(spark, sf_dir).select(F.col("oid").alias("parent"), "message")
    return edges(spark, sf_dir).join(touched, "parent").groupBy(F.col("child").alias("oid")).agg(F.sort_array(F.collect_set("message")).alias("paths"))


@query("SELECT doc_id, start, size, lead(start) OVER (ORDER BY doc_id) AS next_start FROM (SELECT doc_id, size, CAST(sum(size) OVER (ORDER BY doc_id) - size AS BIGINT) AS start FROM blobs)")
def next_offset(spark, sf_dir):
    """Offsets in pack order: prefix sums in two steps, over buckets of ids and within each."""
    return _placed(blobs(spark, sf_dir)).select("doc_id", "start", "size", F.when(F.col("start") + F.col("size") < F.col("all"), F.col("start") + F.col("size")).otherwise(F.when(F.col("doc_id") < F.col("last"), F.col("start") + F.col("size"))).alias("next_start"))


def _placed(rows, width: int = 4096):
    """rows (doc_id, size, ..) with start, and with the total and the last id."""
    cut = rows.withColumn("part", F.floor(F.col("doc_id") / width))
    sums = cut.groupBy("part").agg(F.sum("size").alias("n"))
    over = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    whole = rows.agg(F.sum("size").alias("all"), F.max("doc_id").alias("last"))
    inner = Window.partitionBy("part").orderBy("doc_id")
    return cut.join(over, "part").withColumn("start", F.col("base") + F.sum("size").over(inner) - F.col("size")).join(F.broadcast(whole), F.lit(True))


@query("SELECT CAST(start AS BIGINT) AS start, doc_id FROM (SELECT doc_id, sum(size) OVER (ORDER BY doc_id) - size AS start FROM blobs)")
def reverse_index(spark, sf_dir):
    return _placed(blobs(spark, sf_dir)).select("start", "doc_id")


@query("""d AS (SELECT doc_id, line_no, line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS gap FROM lines WHERE contains(line, 'er')), h AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS hunk FROM d)
SELECT doc_id, hunk, min(line_no) AS first_line, max(line_no) AS last_line FROM h GROUP BY doc_id, hunk""")
def hunk_grouping(spark, sf_dir):
    """Changed lines closer than twice the context of three share a hunk."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(spark, sf_dir).where(F.contains("line", F.lit("er"))).withColumn("gap", F.col("line_no") - F.lag("line_no").over(order))
    rows = rows.withColumn("hunk", F.count_if(F.col("gap").isNull() | (F.col("gap") > 6)).over(order))
    return rows.groupBy("doc_id", "hunk").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query("SELECT ref, max(update_index) AS update_index, arg_max(who, update_index) AS who FROM reflog GROUP BY ref")
def latest_wins(spark, sf_dir):
    """The newest row of each name: one partial aggregation, no window."""
    return reflog(spark, sf_dir).groupBy("ref").agg(F.max("update_index").alias("update_index"), F.max_by("who", "update_index").alias("who"))


@query("SELECT doc_id, base, place FROM (SELECT doc_id, unnest([1, 2, 3]) AS place, unnest([lag(doc_id, 1) OVER w, lag(doc_id, 2) OVER w, lag(doc_id, 3) OVER w]) AS base FROM (SELECT doc_id, size, coalesce(source, '') AS source FROM blobs JOIN documents USING (doc_id)) WINDOW w AS (PARTITION BY source ORDER BY size DESC, doc_id)) WHERE base IS NOT NULL")
def delta_window_candidates(spark, sf_dir):
    """The three larger neighbours of each object of its source as delta bases."""
    rows = blobs(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    w = Window.partitionBy("source").orderBy(F.desc("size"), "doc_id")
    rows = rows.select("doc_id", *[F.lag("doc_id", k).over(w).alias(f"b{k}") for k in (1, 2, 3)])
    near = F.array(*[F.struct(F.lit(k).alias("place"), F.col(f"b{k}").alias("base")) for k in (1, 2, 3)])
    return rows.select("doc_id", F.inline(near)).where("base is not null").select("doc_id", "base", "place")


@query("SELECT oid, commit_time FROM commits ORDER BY commit_time DESC, oid DESC LIMIT 25")
def max_count(spark, sf_dir):
    return commits(spark, sf_dir).select("oid", "commit_time").orderBy(F.desc("commit_time"), F.desc("oid")).limit(25)


@query("""n AS (SELECT DISTINCT split_part(path, '/', 1) AS name, 16384 AS mode FROM tree_a UNION ALL SELECT DISTINCT split_part(path, '/', 1) || '-f', 33188 FROM tree_a)
SELECT name, mode, row_number() OVER (ORDER BY name || CASE WHEN mode = 16384 THEN '/' ELSE '' END) AS pos FROM n ORDER BY pos LIMIT 200""")
def path_order(spark, sf_dir):
    """Tree order, in which a folder sorts as if its name ended with a slash, so behind ``name-f``; the first 200."""
    _, ours, _ = trees(spark, sf_dir)
    name = F.split_part("path", F.lit("/"), F.lit(1))
    folders = ours.select(name.alias("name")).distinct()
    rows = folders.select("name", F.lit(16384).alias("mode")).unionByName(folders.select(F.concat("name", F.lit("-f")).alias("name"), F.lit(33188).alias("mode")))
    key = F.concat("name", F.when(F.col("mode") == 16384, "/").otherwise(""))
    top = rows.withColumn("key", key).orderBy("key").limit(200)
    return top.select("name", "mode", F.row_number().over(Window.orderBy("key")).cast("long").alias("pos"))


@query("SELECT split_part(path, '/', 1) AS folder, min(path) AS best FROM tree_a GROUP BY 1")
def top1_path_match(spark, sf_dir):
    _, ours, _ = trees(spark, sf_dir)
    return ours.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.min("path").alias("best"))
