"""The version history that the driver's tables stand for.

commits come from events (the previous event of a user is the first parent; every 17th commit merges its
predecessor), trees from lineitem snapshots, blobs and lines from documents, reflogs from conversations, notes from
labels, paths from pages. annals.registry.HISTORY states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annals.session import table


def commits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("oid"), F.col("ts").alias("commit_time"), F.col("user_id").alias("author"), F.col("event_type").alias("message"), "value")


def edges(spark, sf_dir) -> DataFrame:
    """(child, parent, nth): first parents within a user, and second parents of merges."""
    line = Window.partitionBy("author").orderBy("commit_time", "oid")
    first = commits(spark, sf_dir).select(F.col("oid").alias("child"), F.lag("oid").over(line).alias("parent"))
    second = F.when((F.col("child") % 17 == 0) & (F.col("child") > 0) & ~F.col("parent").eqNullSafe(F.col("child") - 1), F.col("child") - 1)
    both = first.select("child", F.posexplode(F.array("parent", second)).alias("nth", "parent"))
    return both.where("parent is not null").select("child", "parent", "nth")


def tips(spark, sf_dir) -> tuple[int, int]:
    """The newest commit and one at nine tenths of the ids."""
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return (last, (last + 1) * 9 // 10) if last is not None else (-1, -1)


def refs(spark, sf_dir) -> DataFrame:
    heads = commits(spark, sf_dir).groupBy("author").agg(F.max("oid").alias("oid")).select(F.concat(F.lit("refs/heads/u"), "author").alias("name"), "oid")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = F.concat(F.lit("refs/remotes/"), F.lower("r_name"), F.lit("/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))))
    remote = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(place.alias("name"), (F.col("n_nationkey") * 31).cast("long").alias("oid"))
    return heads.unionByName(remote)


def tags(spark, sf_dir) -> DataFrame:
    return commits(spark, sf_dir).where("oid % 100 = 0").select(F.col("oid").alias("object"), F.concat(F.lit("v"), F.expr("oid div 100")).alias("name"), F.col("commit_time").alias("tagged"))


def _items(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("day"), F.max("l_partkey").alias("part"), F.max(F.round("l_quantity").cast("long")).alias("quantity"), F.max(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")
    ).withColumn("path", F.concat_ws("/", "l_orderkey", "l_linenumber"))


def _oid(extra="0"):
    return F.md5(F.concat_ws(":", "part", F.col("quantity") + F.expr(extra), "cents").cast("binary")).alias("oid")


def trees(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, ours, theirs) as (path, mode, oid)."""
    rows = _items(spark, sf_dir)
    plain = F.lit(33188).alias("mode")
    base = rows.where("day < timestamp_ntz'1998-01-01'").select("path", plain, _oid())
    ours = rows.where("day < timestamp_ntz'1999-01-01' and part % 19 <> 0").select("path", F.expr("if(part % 29 = 0, 33261, 33188)").alias("mode"), _oid("if(part % 13 = 0, 1, 0)"))
    theirs = rows.where("day < timestamp_ntz'1998-07-01' and part % 23 <> 0").select("path", plain, _oid("if(part % 11 = 0, 2, 0)"))
    return base, ours, theirs


def urls(spark, sf_dir) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def blob_oid(data, size):
    """The content hash of a blob."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), size.cast("string")).cast("binary"), F.lit(bytearray(1)), data))


def blobs(spark, sf_dir) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", blob_oid(data, F.octet_length(data)).alias("oid"), F.octet_length(data).cast("long").alias("size"))


def reflog(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("refs/conv/"), "conv_id").alias("ref"), F.col("turn").alias("update_index"), F.col("role").alias("who"), F.col("text").alias("comment"))
