"""The staging index file: entries with file metadata in path order, with or without shared prefixes; edits of it and trees made from it."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annals.plans.shared import written
from annals.sources.files import open_fs, put

ENTRY = "path string, mode int, oid string, stage int, size long, mtime long, assume_valid boolean, skip_worktree boolean, intent_to_add boolean"


@dataclass(frozen=True)
class Entry:
    path: bytes
    mode: int
    oid: str
    stage: int = 0
    size: int = 0
    mtime: int = 0  # nanoseconds
    assume_valid: bool = False
    skip_worktree: bool = False
    intent_to_add: bool = False

    @property
    def key(self):
        return self.path, self.stage


def encode(entries: list[Entry], version: int = 2) -> bytes:
    """A version 2, 3 or 4 file; extended flags need 3 or 4."""
    rows = sorted(entries, key=lambda e: e.key)
    if version == 2 and any(e.skip_worktree or e.intent_to_add for e in rows):
        version = 3
    out, last = bytearray(b"DIRC" + struct.pack(">II", version, len(rows))), b""
    for e in rows:
        seconds, nanos = divmod(e.mtime, 10**9)
        extended = e.skip_worktree or e.intent_to_add
        flags = e.assume_valid << 15 | extended << 14 | e.stage << 12 | min(len(e.path), 0xFFF)
        start = len(out)
        out += struct.pack(">10I", 0, 0, seconds & 0xFFFFFFFF, nanos, 0, 0, e.mode, 0, 0, e.size & 0xFFFFFFFF) + bytes.fromhex(e.oid) + struct.pack(">H", flags)
        if extended:
            out += struct.pack(">H", e.skip_worktree << 14 | e.intent_to_add << 13)
        if version == 4:
            same = 0
            while same < min(len(last), len(e.path)) and last[same] == e.path[same]:
                same += 1
            out += _drop(len(last) - same) + e.path[same:] + b"\0"
            last = e.path
        else:
            out += e.path
            out += b"\0" * (8 - (len(out) - start) % 8)
    return bytes(out) + hashlib.sha1(out).digest()


def _drop(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        n -= 1
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def decode(data: bytes) -> list[Entry]:
    """The entries of a file; ValueError if it is damaged. Unknown optional parts are skipped."""
    if data[:4] != b"DIRC":
        raise ValueError("not a staging index")
    if data[-20:] != b"\0" * 20 and hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise ValueError("checksum differs")
    version, count = struct.unpack_from(">II", data, 4)
    if version not in (2, 3, 4):
        raise ValueError(f"version {version}")
    at, out, last = 12, [], b""
    for _ in range(count):
        start = at
        f = struct.unpack_from(">10I", data, at)
        oid, (flags,) = data[at + 40 : at + 60].hex(), struct.unpack_from(">H", data, at + 60)
        at += 62
        more = 0
        if flags >> 14 & 1:
            (more,) = struct.unpack_from(">H", data, at)
            at += 2
        if version == 4:
            x, n = data[at], data[at] & 127
            while x & 128:
                at += 1
                x = data[at]
                n = (n + 1 << 7) + (x & 127)
            end = data.index(b"\0", at + 1)
            path = last[: len(last) - n] + data[at + 1 : end]
            at, last = end + 1, path
        else:
            end = data.index(b"\0", at) if flags & 0xFFF == 0xFFF else at + (flags & 0xFFF)
            path = data[at:end]
            at = start + (end - start) + 8 - (end - start) % 8
        out.append(Entry(path, f[6], oid, flags >> 12 & 3, f[9], f[2] * 10**9 + f[3], bool(flags >> 15), bool(more >> 14 & 1), bool(more >> 13 & 1)))
    return out


def _row(e: Entry):
    return e.path.decode("utf-8", "replace"), e.mode, e.oid, e.stage, e.size, e.mtime, e.assume_valid, e.skip_worktree, e.intent_to_add


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the index files below a path, with their file; one file's entries, and some thousand of its rows, are in memory at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["file", *(x.split()[0] for x in ENTRY.split(", "))]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(it):
        for batch in it:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                entries = decode(content.as_py())
                for at in range(0, len(entries), 10_000):
                    rows = [(file, *_row(e)) for e in entries[at : at + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(run, f"file string, {ENTRY}")


FILE_ENTRIES = 100_000


def write(entries: DataFrame, folder: str, files: int = 1, most: int = FILE_ENTRIES) -> DataFrame:
    """Index files of entries (path, mode, oid), dealt by ranges of paths: as many as asked for, or more, one for each ``most`` entries; (file, entries)."""
    rows = written(entries.select("path", "mode", "oid"), "entries")
    files = max(files, -(-rows.count() // most))

    def run(it):
        from pyspark import TaskContext

        rows = [Entry(p.encode(), m, o) for batch in it for p, m, o in zip(*(batch.column(c).to_pylist() for c in ("path", "mode", "oid")))]
        if rows:
            name = f"index-{TaskContext.get().partitionId():06d}"
            fs, root = open_fs(folder)
            put(fs, f"{root}/{name}", encode(rows))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64())], names=["file", "entries"])

    return rows.repartitionByRange(files, "path").mapInArrow(run, "file string, entries long")


def subtree(entries: DataFrame, folder: str) -> DataFrame:
    """The entries below a folder: a range of the path order, pushed to the scan."""
    low = folder.rstrip("/") + "/"
    return entries.where((F.col("path") >= low) & (F.col("path") < low[:-1] + "0"))


def edited(entries: list[Entry], put: list[Entry] = (), gone: list[bytes] = ()) -> list[Entry]:
    """After replacing and deleting paths; a file takes the place of a folder of its name and the other way round, and of unmerged stages."""
    new = {e.path: e for e in put}
    folders = {p[:k] for p in new for k in range(len(p)) if p[k : k + 1] == b"/"}
    dropped = set(gone)
    kept = []
    for e in entries:
        if e.path in new or e.path in dropped or e.path in folders or any(e.path[:k] in new for k in range(len(e.path)) if e.path[k : k + 1] == b"/"):
            continue
        kept.append(e)
    return sorted([*kept, *new.values()], key=lambda e: e.key)


def unmerged(entries: list[Entry]) -> list[bytes]:
    return sorted({e.path for e in entries if e.stage})


def resolved(entries: list[Entry], path: bytes, stage: int) -> list[Entry]:
    """A conflict decided for one side."""
    pick = [replace(e, stage=0) for e in entries if e.path == path and e.stage == stage]
    return sorted([e for e in entries if e.path != path] + pick, key=lambda e: e.key)


FOLDER = 0o40000


def tree_bytes(rows: list[tuple[bytes, int, str]]) -> bytes:
    """A tree object of (name, mode, id); folders sort as if their name ended with a slash."""
    rows = sorted(rows, key=lambda r: r[0] + b"/" if r[1] == FOLDER else r[0])
    return b"".join(f"{mode:o} ".encode() + name + b"\0" + bytes.fromhex(oid) for name, mode, oid in rows)


def read_tree(data: bytes) -> list[tuple[bytes, int, str]]:
    """(name, mode, id) of a tree object, in its order."""
    out, at = [], 0
    while at < len(data):
        blank, zero = data.index(b" ", at), data.index(b"\0", at)
        out.append((data[blank + 1 : zero], int(data[at:blank], 8), data[zero + 1 : zero + 21].hex()))
        at = zero + 21
    return out


def tree_id(data: bytes) -> str:
    return hashlib.sha1(f"tree {len(data)}\0".encode() + data).hexdigest()


PART_BYTES = 1 << 15  # of a tree object in a row; larger ones take several rows


def _pieces(it, most: int):
    """Tree objects of rows (folder, entry) in order: (folder, oid, part, data), those that may go on in another range or row without an id."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() + 1 << 32
    now, held, size, seen = None, [], 0, 0  # of the last folder so far; of pieces without an id
    first, out = True, ([], [], [], [])

    def emit(folder, data, whole):
        nonlocal seen
        out[0].append(folder)
        out[1].append(tree_id(data) if whole else None)
        out[2].append(0 if whole else task + seen)
        out[3].append(data)
        seen += not whole

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["folder", "oid", "part", "data"])
        for column in out:
            column.clear()
        return batch

    cut = False  # whether pieces of the last folder went out before
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        folders, entries = batch.column("folder").to_pylist(), batch.column("entry").cast(pa.binary())
        ends = np.frombuffer(entries.buffers()[1], np.int32)[entries.offset : entries.offset + n + 1].tolist()
        body = memoryview(entries.buffers()[2])
        at = 0
        while at < n:
            folder, end = folders[at], at + 1
            while end < n and folders[end] == folder and ends[end] - ends[at] < most:
                end += 1
            data = bytes(body[ends[at] : ends[end]])
            if folder != now:
                if now is not None:
                    emit(now, b"".join(held), not first and not cut)
                    first = False
                now, held, size, cut = folder, [], 0, False
            elif size + len(data) > most:
                emit(now, b"".join(held), False)
                held, size, cut = [], 0, True
            held.append(data)
            size, at = size + len(data), end
        if out[0]:
            yield flush()
    if now is not None:
        emit(now, b"".join(held), False)
        yield flush()


def _hashed(it):
    """(folder, oid) of the pieces (folder, total, data) of tree objects in order, without holding an object whole."""
    now, sha, out = None, None, []
    for batch in it:
        for at in range(batch.num_rows):
            folder, total, data = (batch.column(k)[at].as_py() for k in range(3))
            if folder != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = folder, hashlib.sha1(f"tree {total}\0".encode())
            sha.update(data)
    if now is not None:
        out.append((now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([o for _, o in out], pa.string())], names=["folder", "oid"])


def trees_of(entries: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """(folder, oid, part, data) of the tree objects of entries (path, mode, oid), bottom up: one sorted run for each level of depth.

    Entries are dealt by ranges of folder and name, so that a folder of any size is many tasks' work. part is 0 where a row holds an object
    whole; of others the rows with one folder and oid hold it in order of part, cut between entries. The root is the folder "".
    """
    cut = F.length("path") - F.length(F.substring_index("path", "/", -1))
    folder = F.when(cut > 0, F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise("").alias("folder")

    def keyed(rows: DataFrame) -> DataFrame:
        """(folder, key, entry) of rows (folder, name, mode, oid): folders sort as if their name ended with a slash."""
        entry = F.concat(F.concat(F.conv(F.col("mode").cast("string"), 10, 8), F.lit(" "), "name").cast("binary"), F.lit(bytearray(1)), F.unhex("oid"))
        return rows.select("folder", F.when(F.col("mode") == FOLDER, F.concat("name", F.lit("/"))).otherwise(F.col("name")).alias("key"), entry.alias("entry"))

    rows = keyed(entries.select(folder, F.substring_index("path", "/", -1).alias("name"), "mode", "oid"))
    rows = written(rows.withColumn("depth", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))), "entries")
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return entries.sparkSession.createDataFrame([], "folder string, oid string, part long, data binary")
    out, above = None, None
    for depth in range(deepest, -1, -1):
        level = rows.where(F.col("depth") == depth).select("folder", "key", "entry")
        if above is not None:
            level = level.unionByName(keyed(above))
        dealt = level.repartitionByRange("folder", "key").sortWithinPartitions("folder", "key").select("folder", "entry")
        made = written(dealt.mapInArrow(lambda it: _pieces(it, most), "folder string, oid string, part long, data binary"), "trees")
        pieces = made.where("oid is null").drop("oid")
        total = pieces.groupBy("folder").agg(F.sum(F.length("data").cast("long")).alias("total"))
        inorder = pieces.join(total, "folder").repartition("folder").sortWithinPartitions("folder", "part").select("folder", "total", "data")
        ids = written(inorder.mapInArrow(_hashed, "folder string, oid string"), "ids")
        both = made.where("oid is not null").unionByName(pieces.join(ids, "folder"))
        out = both if out is None else out.unionByName(both)
        named = made.where("oid is not null").select("folder", "oid").unionByName(ids).where("folder <> ''")
        above = named.select(F.expr("if(instr(folder, '/') = 0, '', left(folder, length(folder) - length(substring_index(folder, '/', -1)) - 1))").alias("folder"), F.substring_index("folder", "/", -1).alias("name"), F.lit(FOLDER).alias("mode"), "oid")
        # folders above this level that hold only folders come with their children's depth
    return out


def changed_by_metadata(entries: DataFrame, files: DataFrame, index_time: int) -> DataFrame:
    """(path, state) of entries (path, mode, size, mtime, assume_valid, skip_worktree) against files (path, mode, size, mtime).

    clean: metadata equal; dirty: size or mode differ; smudged: equal, but touched when or after the index was written, so
    contents must be compared; touched: only the time differs; missing; assumed: not looked at.
    """
    f = files.select("path", F.struct("mode", "size", "mtime").alias("f"))
    state = (
        F.when(F.col("assume_valid") | F.col("skip_worktree"), "assumed")
        .when(F.col("f").isNull(), "missing")
        .when((F.col("f.mode") != F.col("mode")) | (F.col("f.size") != F.col("size")), "dirty")
        .when(F.col("f.mtime") != F.col("mtime"), "touched")
        .when(F.col("mtime") >= index_time, "smudged")
        .otherwise("clean")
    )
    return entries.join(f, "path", "left").select("path", state.alias("state"))
