"""The history's tables as SQL views, and tables in other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annals.plans import history
from annals.plans.shared import shared_folder
from annals.registry import query
from annals.session import table

VIEWS = {"commits": history.commits, "edges": history.edges, "refs": history.refs, "tags": history.tags, "urls": history.urls, "lines": history.lines, "blobs": history.blobs, "reflog": history.reflog}


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "annals_") -> list[str]:
    """Temporary views of the history, for spark.sql with all it has: subqueries, common table expressions, windows, recursion."""
    for name, made in VIEWS.items():
        made(spark, sf_dir).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in VIEWS]


def _options(kind: str) -> dict:
    """Text formats get a header and times in full precision."""
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return {"csv": {"header": "true", **times}, "json": times}.get(kind, {})


def store(rows: DataFrame, path: str, kind: str = "parquet", by: list[str] = (), **options) -> None:
    """Writes a table in any format Spark has (parquet, orc, csv, json, avro or jdbc where their libraries are); csv with a header."""
    writer = rows.write.format(kind).options(**{**_options(kind), **options})
    (writer.partitionBy(*by) if by else writer).save(path)


def load(spark: SparkSession, path: str, kind: str, schema, **options) -> DataFrame:
    """Reads a table with a schema that is given, never guessed."""
    return spark.read.format(kind).schema(schema).options(**{**_options(kind), **options}).load(path)


@query("""kinds AS (SELECT unnest(['parquet', 'orc', 'csv', 'json']) AS format) SELECT format, count(*) AS commits, CAST(sum(oid) AS BIGINT) AS total, max(commit_time) AS newest FROM commits, kinds GROUP BY format""")
def connectors(spark, sf_dir):
    """Commits written in four formats and read back."""
    rows = history.commits(spark, sf_dir).select("oid", "commit_time", "message")
    out = None
    for kind in ("parquet", "orc", "csv", "json"):
        path = shared_folder(spark, f"table-{kind}")
        store(rows, path, kind)
        one = load(spark, path, kind, rows.schema).select(F.lit(kind).alias("format"), "oid", "commit_time")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("format").agg(F.count("*").alias("commits"), F.sum("oid").alias("total"), F.max("commit_time").alias("newest"))


_SQL = """SELECT author, n, share FROM (
  SELECT c.author, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {0}commits) AS share FROM {0}commits c
  WHERE EXISTS (SELECT 1 FROM {0}edges e WHERE e.child = c.oid AND e.nth = 1) GROUP BY c.author) merging WHERE n > 1"""


@query(_SQL.format(""))
def sql_over_views(spark, sf_dir):
    """A statement with a scalar and a correlated subquery, as a user would write it."""
    register_views(spark, sf_dir)
    return spark.sql(_SQL.format("annals_"))


@query("""SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS total, CAST(epoch(max(ts) - min(ts)) AS BIGINT) AS span, max(ts) + INTERVAL 36 HOUR AS until FROM events GROUP BY event_type""")
def decimals_and_intervals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.col("value").cast("decimal(18,4)"))
    span = F.expr("cast(floor((unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))) / 1e6 + 0.5) as bigint)")
    return rows.groupBy("event_type").agg(F.sum("v").alias("total"), span.alias("span"), (F.max("ts") + F.expr("interval 36 hours")).alias("until"))


@query("""t AS (SELECT object, tagged FROM tags), a AS (SELECT author, commit_time, oid FROM commits WHERE author % 10 = 3)
SELECT d.oid, (SELECT max(a.oid) FROM a WHERE a.author = d.author AND a.commit_time <= d.at AND a.commit_time = (SELECT max(b.commit_time) FROM a b WHERE b.author = d.author AND b.commit_time <= d.at)) AS before FROM (SELECT oid, author, commit_time - INTERVAL 1 DAY AS at FROM commits WHERE author % 10 = 3) d""")
def asof_join(spark, sf_dir):
    """For each commit the last one of its author a day before: both sides in one sorted run a key, the last value carried on."""
    from pyspark.sql import Window

    rows = history.commits(spark, sf_dir).where("author % 10 = 3").select("oid", "author", "commit_time")
    asked = rows.select("author", (F.col("commit_time") - F.expr("interval 1 day")).alias("at"), F.lit(1).alias("side"), F.col("oid").alias("q"), F.lit(None).cast("long").alias("v"))
    values = rows.select("author", F.col("commit_time").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("q"), F.col("oid").alias("v"))
    # values come before questions of the same time; of values of one time the largest id comes last
    w = Window.partitionBy("author").orderBy("at", "side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return values.unionByName(asked).withColumn("before", F.last("v", ignorenulls=True).over(w)).where("side = 1").select(F.col("q").alias("oid"), "before")
