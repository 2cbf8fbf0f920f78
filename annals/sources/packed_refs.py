"""Refs packed in a text file: ``id name`` a line, ``^id`` below a tag for what it peels to, ``#`` comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(files: DataFrame) -> DataFrame:
    """(name, oid, peeled) of rows (path, text), a file a row; lines that are neither are skipped, names are unique per file.

    A peeled line belongs to the line before it, so a file's lines are seen together as one array.
    """
    kept = F.filter(F.split("text", r"\r?\n"), lambda x: ~x.startswith("#") & (x != ""))
    cut = files.select("path", kept.alias("lines"))
    rows = cut.select("path", "lines", F.posexplode("lines").alias("at", "line")).select("path", "line", F.get("lines", F.col("at") + 1).alias("after"))
    ref = rows.where(F.rlike("line", F.lit(r"^[0-9a-f]{40}([0-9a-f]{24})? \S")))
    peeled = F.when(F.startswith("after", F.lit("^")), F.substr("after", F.lit(2)))
    return ref.select("path", F.split_part("line", F.lit(" "), F.lit(2)).alias("name"), F.split_part("line", F.lit(" "), F.lit(1)).alias("oid"), peeled.alias("peeled"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All packed refs below a path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return parse(files)


def formatted(refs: DataFrame) -> DataFrame:
    """(name, text): the lines of each ref; a file is these in order of their names."""
    tail = F.when(F.col("peeled").isNotNull(), F.concat(F.lit("\n^"), "peeled")).otherwise("")
    return refs.select("name", F.concat("oid", F.lit(" "), "name", tail).alias("text"))
