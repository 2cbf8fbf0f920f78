"""Loose objects: zlib streams of ``type size\\0data``, one file each; and the fields of commit objects."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "oid string, type string, size long, data binary, problem string"


def encode(kind: str, data: bytes) -> tuple[str, bytes]:
    """(id, file content) of an object."""
    whole = f"{kind} {len(data)}\0".encode() + data
    return hashlib.sha1(whole).hexdigest(), zlib.compress(whole)


def decode(content: bytes) -> tuple:
    """(oid, type, size, data, problem); a damaged file has a problem and nothing else."""
    try:
        whole = zlib.decompress(content)
        head, data = whole.split(b"\0", 1)
        kind, size = head.decode("ascii").split(" ")
        if int(size) != len(data):
            return None, None, None, None, f"size is {len(data)}, not {size}"
        return hashlib.sha1(whole).hexdigest(), kind, len(data), data, None
    except (zlib.error, ValueError) as broken:
        return None, None, None, None, f"{type(broken).__name__}: {broken}"


def inflate(files: DataFrame) -> DataFrame:
    """Objects of rows (content binary), a file a row."""

    def run(it):
        for batch in it:
            found = [decode(x or b"") for x in batch.column("content").to_pylist()]
            columns = list(zip(*found)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()))], names=["oid", "type", "size", "data", "problem"])

    return files.select("content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every object below a path; Spark lists and splits the files."""
    return inflate(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def commits(objects: DataFrame) -> DataFrame:
    """(oid, tree, parents, author, author_time, message) of the commit objects, JVM-side."""
    text = F.decode("data", "UTF-8")
    head, body = F.split_part(text, F.lit("\n\n"), F.lit(1)), F.regexp_extract(text, r"(?s)^.*?\n\n(.*)$", 1)
    who = F.regexp_extract(head, r"(?m)^author (.*) <", 1)
    return objects.where("type = 'commit'").select(
        "oid", F.regexp_extract(head, r"(?m)^tree ([0-9a-f]+)$", 1).alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("parents"), who.alias("author"),
        F.expr("try_cast(regexp_extract(split_part(decode(data, 'UTF-8'), '\n\n', 1), '(?m)^author .*> (\\\\d+) ', 1) as bigint)").alias("author_time"), body.alias("message"),
    )
