"""Files in any store that Arrow knows, opened where a task runs; and Python functions over rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def open_fs(uri: str):
    """(file system, path) of a folder or file; plain paths are local."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri[5:] if uri.startswith("file:") else uri


def split_uri(uri: str) -> tuple[str, str]:
    """(folder, name) of a file."""
    folder, _, name = uri.rpartition("/")
    return folder, name


def attempt_name() -> str:
    """A name of its own for what this attempt of this task writes before it is moved into place."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f".{task.partitionId():06d}-{task.taskAttemptId()}" if task else ".attempt"


def put(fs, path: str, data: bytes) -> None:
    """Writes a whole file under a name of the attempt and moves it, so that no half file is ever seen."""
    folder, name = split_uri(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/{attempt_name()}-{name}") as out:
        out.write(data)
    fs.move(f"{folder}/{attempt_name()}-{name}", path)


def each(rows: DataFrame, work, schema: str, rows_at_once: int = 64) -> DataFrame:
    """The tuples that work(*columns of a row) yields, for all rows; few rows are in memory at a time."""
    names = [x.strip().split(" ") for x in schema.split(", ")]

    def run(it):
        for big in it:
            for at in range(0, big.num_rows, rows_at_once):
                batch = big.slice(at, rows_at_once)
                found = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in work(*row)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], KINDS[t]) for k, (_, t) in enumerate(names)], names=[n for n, _ in names])

    return rows.mapInArrow(run, schema)
