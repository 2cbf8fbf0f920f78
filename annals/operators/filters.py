"""Scans, projections and predicates over commits, refs, paths, reflogs and objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals.functions.globs import glob_regex
from annals.plans.history import blobs, commits, lines, reflog, refs, trees, urls
from annals.registry import query
from annals.session import table


@query("SELECT oid, commit_time, author, message FROM commits")
def commit_scan(spark, sf_dir):
    return commits(spark, sf_dir).select("oid", "commit_time", "author", "message")


@query("SELECT oid, strftime(commit_time, '%Y-%m-%d %H:%M:%S') AS at, upper(message) AS subject, 'u' || author || '@example.com' AS email FROM commits")
def commit_projection(spark, sf_dir):
    return commits(spark, sf_dir).select("oid", F.date_format("commit_time", "yyyy-MM-dd HH:mm:ss").alias("at"), F.upper("message").alias("subject"), F.concat(F.lit("u"), "author", F.lit("@example.com")).alias("email"))


@query("SELECT event_id AS oid, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def footer_projection(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("oid"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, line_no, line FROM lines")
def line_explode(spark, sf_dir):
    return lines(spark, sf_dir)


@query("SELECT name, oid FROM refs WHERE starts_with(name, 'refs/remotes/europe/')")
def ref_prefix_scan(spark, sf_dir):
    return refs(spark, sf_dir).where(F.startswith("name", F.lit("refs/remotes/europe/")))


@query("SELECT name, oid FROM refs WHERE starts_with(name, 'refs/') AND NOT (starts_with(name, 'refs/heads/u1') OR starts_with(name, 'refs/remotes/asia/'))")
def ref_prefix_exclude(spark, sf_dir):
    out = F.startswith("name", F.lit("refs/heads/u1")) | F.startswith("name", F.lit("refs/remotes/asia/"))
    return refs(spark, sf_dir).where(F.startswith("name", F.lit("refs/")) & ~out)


@query("SELECT name, oid FROM (SELECT *, CASE name WHEN 'u7' THEN 0 WHEN 'refs/u7' THEN 1 WHEN 'refs/tags/u7' THEN 2 WHEN 'refs/heads/u7' THEN 3 WHEN 'refs/remotes/u7' THEN 4 END AS place FROM refs) WHERE place IS NOT NULL ORDER BY place LIMIT 1")
def ref_point_lookup(spark, sf_dir):
    """A short name along the search path; the first place that has it wins."""
    places = ["u7", "refs/u7", "refs/tags/u7", "refs/heads/u7", "refs/remotes/u7"]
    rank = F.array_position(F.array(*map(F.lit, places)), F.col("name"))
    return refs(spark, sf_dir).where(F.col("name").isin(places)).orderBy(rank).limit(1)


@query("SELECT oid, list_sort(list(name)) AS names FROM refs GROUP BY oid")
def refs_by_peeled(spark, sf_dir):
    return refs(spark, sf_dir).groupBy("oid").agg(F.sort_array(F.collect_list("name")).alias("names"))


@query("SELECT oid, count(*) AS n, min(name) AS first FROM refs GROUP BY oid")
def refs_by_target(spark, sf_dir):
    return refs(spark, sf_dir).groupBy("oid").agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query("SELECT ref, update_index, who FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY update_index DESC) AS n FROM reflog) WHERE n <= 2")
def reflog_last_n(spark, sf_dir):
    """The last two entries of each ref; the limit is pushed below the shuffle by Spark."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("update_index")))
    return reflog(spark, sf_dir).withColumn("n", rank).where("n <= 2").select("ref", "update_index", "who")


@query("SELECT oid FROM commits WHERE message = 'error' AND (author % 2 = 0 OR value > 50) AND NOT oid % 10 = 0")
def and_or_not(spark, sf_dir):
    return commits(spark, sf_dir).where("message = 'error' and (author % 2 = 0 or value > 50) and not oid % 10 = 0").select("oid")


@query("SELECT oid FROM commits WHERE commit_time <= TIMESTAMP '2024-01-02 00:00:00'")
def time_before(spark, sf_dir):
    return commits(spark, sf_dir).where("commit_time <= timestamp_ntz'2024-01-02 00:00:00'").select("oid")


@query("SELECT oid FROM commits WHERE commit_time >= TIMESTAMP '2024-01-01 12:00:00'")
def time_after(spark, sf_dir):
    return commits(spark, sf_dir).where("commit_time >= timestamp_ntz'2024-01-01 12:00:00'").select("oid")


@query("SELECT oid FROM commits WHERE commit_time BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-01 18:00:00'")
def time_between(spark, sf_dir):
    return commits(spark, sf_dir).where("commit_time between timestamp_ntz'2024-01-01 06:00:00' and timestamp_ntz'2024-01-01 18:00:00'").select("oid")


@query("SELECT oid, author FROM commits WHERE regexp_matches('U' || author, '^u1[0-9]?$', 'i')")
def author_match(spark, sf_dir):
    """A pattern with metacharacters is an expression, without regard to case."""
    return commits(spark, sf_dir).where(F.rlike(F.concat(F.lit("U"), "author"), F.lit("(?i)^u1[0-9]?$"))).select("oid", "author")


@query("SELECT oid, message FROM commits WHERE contains(lower(message), 'urch')")
def message_match(spark, sf_dir):
    return commits(spark, sf_dir).where(F.contains(F.lower("message"), F.lit("urch"))).select("oid", "message")


_FLAGS = "SELECT oid, (CASE WHEN oid % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN author % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN message = 'click' THEN 4 ELSE 0 END) AS flags FROM commits"


def flagged(spark, sf_dir):
    return commits(spark, sf_dir).select("oid", F.expr("if(oid % 2 = 0, 1, 0) + if(author % 3 = 0, 2, 0) + if(message = 'click', 4, 0)").alias("flags"))


@query(f"SELECT oid FROM ({_FLAGS}) WHERE flags & 5 = 5")
def flag_has_all(spark, sf_dir):
    return flagged(spark, sf_dir).where("flags & 5 = 5").select("oid")


@query(f"SELECT oid FROM ({_FLAGS}) WHERE flags & 6 <> 0")
def flag_has_any(spark, sf_dir):
    return flagged(spark, sf_dir).where("flags & 6 <> 0").select("oid")


@query("SELECT page_id, path FROM urls WHERE path = (SELECT min(path) FROM urls) OR starts_with(path, (SELECT min(split_part(path, '/', 1)) FROM urls) || '/')")
def path_exact_or_prefix(spark, sf_dir):
    rows = urls(spark, sf_dir)
    low = rows.agg(F.min("path").alias("one"), F.min(F.split_part("path", F.lit("/"), F.lit(1))).alias("folder"))
    return rows.join(F.broadcast(low), (F.col("path") == F.col("one")) | F.startswith("path", F.concat("folder", F.lit("/")))).select("page_id", "path")


@query("SELECT path, oid FROM base_tree WHERE split_part(path, '/', 1) IN ('1', '7', '77', '145', '1000')")
def path_group(spark, sf_dir):
    base, _, _ = trees(spark, sf_dir)
    return base.where(F.split_part("path", F.lit("/"), F.lit(1)).isin("1", "7", "77", "145", "1000")).select("path", "oid")


@query("SELECT page_id, path FROM urls WHERE ends_with(path, '5')")
def path_suffix(spark, sf_dir):
    return urls(spark, sf_dir).where(F.endswith("path", F.lit("5")))


@query("SELECT path, CAST((CASE WHEN path LIKE '1%' THEN 1 ELSE 0 END) + (CASE WHEN path LIKE '%/1' THEN 2 ELSE 0 END) + (CASE WHEN path LIKE '%7%' THEN 4 ELSE 0 END) AS INTEGER) AS marks FROM base_tree")
def tree_filter_marks(spark, sf_dir):
    base, _, _ = trees(spark, sf_dir)
    return base.select("path", F.expr("if(path like '1%', 1, 0) + if(path like '%/1', 2, 0) + if(path like '%7%', 4, 0)").alias("marks"))


#: Ordered rules; the last that matches decides, "!" negates.
RULES = ("*/en/*", "**/[0-4]*", "!**/3*", "*.example.com/fr/**")


def ignored(path: str, rules=RULES):
    """A column: whether the path is ignored. Rules become expressions at plan time; rows never meet Python."""
    verdict = F.lit(False)
    for rule in rules:
        negated = rule.startswith("!")
        verdict = F.when(F.rlike(F.col(path), F.lit(glob_regex(rule.lstrip("!")))), F.lit(not negated)).otherwise(verdict)
    return verdict


@query("""SELECT page_id, CASE WHEN regexp_full_match(path, '[^/]*[.]example[.]com/fr/.*') THEN true WHEN regexp_full_match(path, '(.*/)?3[^/]*') THEN false WHEN regexp_full_match(path, '(.*/)?[0-4][^/]*') THEN true WHEN regexp_full_match(path, '[^/]*/en/[^/]*') THEN true ELSE false END AS ignored FROM urls""")
def ignore_rules(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", ignored("path").alias("ignored"))


@query("SELECT page_id FROM urls WHERE regexp_full_match(path, '[^/]*/[a-e][^/]/[^/]*')")
def glob_match(spark, sf_dir):
    return urls(spark, sf_dir).where(F.rlike("path", F.lit(glob_regex("*/[a-e]?/*")))).select("page_id")


@query("SELECT name, 'refs/mirror/' || substr(name, length('refs/heads/') + 1) AS destination FROM refs WHERE starts_with(name, 'refs/heads/') AND NOT starts_with(name, 'refs/heads/u2')")
def refspec_expand(spark, sf_dir):
    """refs/heads/*:refs/mirror/* with the negative ^refs/heads/u2*."""
    rows = refs(spark, sf_dir).where(F.startswith("name", F.lit("refs/heads/")) & ~F.startswith("name", F.lit("refs/heads/u2")))
    return rows.select("name", F.concat(F.lit("refs/mirror/"), F.substr("name", F.lit(len("refs/heads/") + 1))).alias("destination"))


@query("SELECT doc_id, oid, size FROM blobs WHERE size < 1000")
def filterspec_blob_limit(spark, sf_dir):
    return blobs(spark, sf_dir).where("size < 1000")


@query("""SELECT doc_id, list_filter([CASE WHEN text IS NULL OR text = '' THEN 'empty' END, CASE WHEN contains(text, chr(9)) THEN 'tab' END, CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 'no newline at end' END, CASE WHEN length(text) > 10000 THEN 'large' END], lambda x: x IS NOT NULL) AS problems FROM documents""")
def fsck_rules(spark, sf_dir):
    rules = ["case when text is null or text = '' then 'empty' end", "case when contains(text, '\\t') then 'tab' end", "case when text <> '' and not endswith(text, '\\n') then 'no newline at end' end", "case when length(text) > 10000 then 'large' end"]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(*map(F.expr, rules))).alias("problems"))


@query("""names AS (SELECT name FROM refs UNION ALL SELECT 'refs/heads/' || replace(split_part(path, '/', 3), '5', '..') FROM urls UNION ALL SELECT 'refs/' || path || CASE WHEN page_id % 2 = 0 THEN '.lock' ELSE '' END FROM urls)
SELECT name, NOT (regexp_matches(name, '[.][.]|//|@[{]|[[:cntrl:] ~^:?*\\[\\\\]|/[.]|^[.]|[.]$|/$|[.]lock(/|$)') OR NOT contains(name, '/')) AS valid FROM names""")
def ref_name_valid(spark, sf_dir):
    paths = urls(spark, sf_dir)
    third = F.replace(F.split_part("path", F.lit("/"), F.lit(3)), F.lit("5"), F.lit(".."))
    odd = F.concat(F.lit("refs/"), "path", F.when(F.col("page_id") % 2 == 0, ".lock").otherwise(""))
    names = refs(spark, sf_dir).select("name").unionAll(paths.select(F.concat(F.lit("refs/heads/"), third))).unionAll(paths.select(odd))
    bad = r"\.\.|//|@\{|[\p{Cntrl} ~^:?*\[\\]|/\.|^\.|\.$|/$|\.lock(/|$)"
    return names.select("name", (~(F.rlike("name", F.lit(bad)) | ~F.contains("name", F.lit("/")))).alias("valid"))


@query("SELECT count(*) AS n, count(DISTINCT oid) AS distinct_oids FROM (SELECT oid FROM blobs WHERE doc_id % 2 = 0 UNION SELECT oid FROM blobs WHERE doc_id % 2 = 1)")
def multi_pack_dedup(spark, sf_dir):
    rows = blobs(spark, sf_dir)
    both = rows.where("doc_id % 2 = 0").select("oid").unionByName(rows.where("doc_id % 2 = 1").select("oid")).distinct()
    return both.agg(F.count("*").alias("n"), F.countDistinct("oid").alias("distinct_oids"))


@query("SELECT b.oid, min(doc_id) AS place FROM blobs b WHERE substr(b.oid, 1, 1) = '7' GROUP BY b.oid")
def pack_index_lookup(spark, sf_dir):
    """Objects below one fan-out prefix with the place of their first copy."""
    return blobs(spark, sf_dir).where(F.startswith("oid", F.lit("7"))).groupBy("oid").agg(F.min("doc_id").alias("place"))


@query("""d AS (SELECT DISTINCT oid FROM blobs), n AS (SELECT oid, lag(oid) OVER (ORDER BY oid) AS p, lead(oid) OVER (ORDER BY oid) AS q FROM d),
c AS (SELECT oid, (SELECT coalesce(max(i), 0) FROM generate_series(1, 40) t(i) WHERE p[:i] = oid[:i]) AS a, (SELECT coalesce(max(i), 0) FROM generate_series(1, 40) t(i) WHERE q[:i] = oid[:i]) AS z FROM n)
SELECT oid, substr(oid, 1, greatest(7, a + 1, z + 1)::INT) AS abbrev FROM c""")
def abbreviate_unique(spark, sf_dir):
    """The shortest unique prefix, seven characters at least: the shortest with one object, tried per fan-out byte."""
    from pyspark.sql import Window

    rows = blobs(spark, sf_dir).select("oid").distinct().withColumn("fan", F.substr("oid", F.lit(1), F.lit(2)))
    order = Window.partitionBy("fan").orderBy("oid")
    near = rows.select("oid", F.lag("oid").over(order).alias("p"), F.lead("oid").over(order).alias("q"))
    common = lambda x: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.lit(40)), lambda i: F.substr(F.col(x), F.lit(1), i) == F.substr(F.col("oid"), F.lit(1), i))), F.lit(0))
    return near.select("oid", F.substr("oid", F.lit(1), F.greatest(F.lit(7), common("p") + 1, common("q") + 1)).alias("abbrev"))


@query("asked AS (SELECT DISTINCT substr(oid, 1, 3) AS abbrev FROM blobs) SELECT abbrev, count(DISTINCT oid) AS matches, CASE WHEN count(DISTINCT oid) = 1 THEN min(oid) END AS oid FROM asked JOIN blobs ON starts_with(oid, abbrev) GROUP BY abbrev")
def abbrev_resolve(spark, sf_dir):
    """Ids of an abbreviation: one match resolves, several are ambiguous."""
    rows = blobs(spark, sf_dir).groupBy(F.substr("oid", F.lit(1), F.lit(3)).alias("abbrev"), "oid").agg(F.lit(1).alias("one"))
    return rows.groupBy("abbrev").agg(F.count("*").alias("matches"), F.min("oid").alias("low")).select("abbrev", "matches", F.when(F.col("matches") == 1, F.col("low")).alias("oid"))


@query("SELECT name, oid FROM refs WHERE oid IN (SELECT oid FROM refs GROUP BY oid HAVING count(*) > 0) EXCEPT SELECT name, oid FROM refs WHERE oid % 2 = 0")
def range_except(spark, sf_dir):
    rows = refs(spark, sf_dir)
    return rows.exceptAll(rows.where("oid % 2 = 0"))


@query("loose AS (SELECT name, oid + 1 AS oid FROM refs WHERE oid % 3 = 0) SELECT coalesce(l.name, p.name) AS name, coalesce(l.oid, p.oid) AS oid FROM refs p FULL JOIN loose l ON l.name = p.name")
def loose_over_packed(spark, sf_dir):
    """Loose refs hide packed ones of the same name."""
    packed = refs(spark, sf_dir)
    loose = packed.where("oid % 3 = 0").select("name", (F.col("oid") + 1).alias("loose"))
    return packed.join(loose, "name", "full").select("name", F.coalesce("loose", "oid").alias("oid"))
