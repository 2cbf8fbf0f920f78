"""Refs and their logs in sorted block files: prefix-compressed keys, restart points, indexes by name and by object; stacks of such files.

A file is searched by bisection of its index and of a block's restarts. A stack of files is one table of rows in which the
newest file wins; that is an aggregation, so a stack of any size needs no merge in one task.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annals.sources.files import each, open_fs, put
from annals.sources.packs import distance as varint
from annals.sources.packs import read_distance as read_varint

RESTART, BLOCK = 16, 4096
DELETION, PLAIN, PEELED, SYMBOLIC = range(4)


@dataclass(frozen=True)
class Ref:
    name: str
    index: int
    oid: str | None = None
    peeled: str | None = None
    target: str | None = None

    @property
    def kind(self):
        return SYMBOLIC if self.target is not None else PEELED if self.peeled else PLAIN if self.oid else DELETION


@dataclass(frozen=True)
class Log:
    name: str
    index: int
    old: str
    new: str
    who: str
    email: str
    seconds: int
    zone: int
    message: str
    deleted: bool = False


class _Block:
    """One block: records (key, low bits, rest) while they fit."""

    def __init__(self, mark: bytes, room: int, ahead: int = 0):
        self.mark, self.room, self.ahead = mark, room, ahead
        self.body, self.restarts, self.last, self.count, self.first = bytearray(), [], b"", 0, None

    def add(self, key: bytes, low: int, rest: bytes) -> bool:
        same = 0
        if self.count % RESTART:
            while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
                same += 1
        record = varint(same) + varint(len(key) - same << 3 | low) + key[same:] + rest
        restarts = len(self.restarts) + (not same)
        if self.count and self.ahead + 4 + len(self.body) + len(record) + 3 * restarts + 2 > self.room:
            return False
        if not same:
            self.restarts.append(self.ahead + 4 + len(self.body))
        self.body += record
        self.first = key if self.first is None else self.first
        self.last, self.count = key, self.count + 1
        return True

    def tail(self) -> bytes:
        return b"".join(struct.pack(">I", r)[1:] for r in self.restarts[:65535]) + struct.pack(">H", min(65535, len(self.restarts)))

    def data(self) -> bytes:
        tail = self.tail()
        size = self.ahead + 4 + len(self.body) + len(tail)
        return self.mark + struct.pack(">I", size)[1:] + bytes(self.body) + tail


def encode(refs: list[Ref], logs: list[Log] = (), low: int | None = None, high: int | None = None, block: int = BLOCK, by_object: bool = True) -> bytes:
    """A file of refs and logs; update indexes range from low to high (default: as found)."""
    indexes = [r.index for r in refs] + [x.index for x in logs]
    low = min(indexes, default=0) if low is None else low
    high = max(indexes, default=0) if high is None else high
    head = b"REFT\1" + struct.pack(">I", block)[1:] + struct.pack(">QQ", low, high)
    out = bytearray(head)

    def section(mark: bytes, records, aligned: bool) -> list[tuple[bytes, int]]:
        """Blocks of records; (last key, position) of each."""
        found, now = [], None
        for key, bits, rest in records:
            if now is None or not now.add(key, bits, rest):
                if now is not None:
                    close(now, found, aligned)
                start = len(out) == len(head)
                now = _Block(mark, block if aligned else 1 << 24, len(head) if start else 0)
                if not now.add(key, bits, rest):
                    raise ValueError("record larger than a block")
        if now is not None:
            close(now, found, aligned)
        return found

    def close(now, found, aligned):
        found.append((now.last, 0 if now.ahead else len(out)))
        out.extend(now.data())
        if aligned:
            out.extend(b"\0" * (-len(out) % block))

    def index_of(blocks: list[tuple[bytes, int]]) -> int:
        """Writes the index of more than one block; its position, else 0."""
        if len(blocks) < 2:
            return 0
        position = len(out)
        section(b"i", [(k, 0, varint(at)) for k, at in blocks], False)
        return position

    def value(r: Ref) -> bytes:
        return {DELETION: b"", PLAIN: bytes.fromhex(r.oid or ""), PEELED: bytes.fromhex((r.oid or "") + (r.peeled or "")), SYMBOLIC: varint(len((r.target or "").encode())) + (r.target or "").encode()}[r.kind]

    rows = sorted(refs, key=lambda r: r.name.encode())
    blocks = section(b"r", [(r.name.encode(), r.kind, varint(r.index - low) + value(r)) for r in rows], True)
    ref_index = index_of(blocks)
    object_at = object_index = width = 0
    if by_object and len(blocks) > 1:
        ends = [k for k, _ in blocks]
        where: dict[bytes, set[int]] = {}
        for r in rows:
            for oid in {r.oid, r.peeled} - {None}:
                where.setdefault(bytes.fromhex(oid), set()).add(blocks[bisect.bisect_left(ends, r.name.encode())][1])
        ids = sorted(where)
        width = 2
        while len({x[:width] for x in ids}) < len(ids):
            width += 1
        records = []
        for oid in ids:
            at = sorted(where[oid])
            steps = b"".join(varint(b - a) for a, b in zip([0, *at], at))
            records.append((oid[:width], len(at) if len(at) < 8 else 0, (b"" if len(at) < 8 else varint(len(at))) + steps))
        if records:
            object_at = len(out)
            object_index = index_of(section(b"o", records, True))
    log_at = log_index = 0
    if logs:
        log_at = len(out)
        found, now = [], None
        for x in sorted(logs, key=lambda x: (x.name.encode(), -x.index)):
            key = x.name.encode() + b"\0" + struct.pack(">Q", 0xFFFFFFFFFFFFFFFF - x.index)
            text = lambda t: varint(len(t.encode())) + t.encode()
            rest = b"" if x.deleted else bytes.fromhex(x.old + x.new) + text(x.who) + text(x.email) + varint(x.seconds) + struct.pack(">h", x.zone) + text(x.message)
            if now is None or not now.add(key, 0 if x.deleted else 1, rest):
                if now is not None:
                    found.append((now.last, len(out)))
                    out.extend(_deflated(now))
                now = _Block(b"g", 2 * block)
                now.add(key, 0 if x.deleted else 1, rest)
        found.append((now.last, len(out)))
        out.extend(_deflated(now))
        log_index = index_of(found)
    foot = head + struct.pack(">QQQQQ", ref_index, object_at << 5 | width, object_index, log_at if log_at != len(head) else len(head), log_index)
    return bytes(out) + foot + struct.pack(">I", zlib.crc32(foot))


def _deflated(block: _Block) -> bytes:
    data = block.data()
    return data[:4] + zlib.compress(data[4:])


class Reftable:
    """A file opened for reading: all refs, from a name on, with a prefix, by object; logs newest first. data: bytes or a memory map, of which only the blocks needed are touched."""

    def __init__(self, data: bytes):
        if data[:5] != b"REFT\1":
            raise ValueError("not a version 1 reftable")
        foot = data[-68:]
        if zlib.crc32(foot[:64]) != struct.unpack(">I", foot[64:])[0] or foot[:24] != data[:24]:
            raise ValueError("damaged footer")
        self.data, self.block = data, int.from_bytes(data[5:8], "big")
        self.low, self.high = struct.unpack_from(">QQ", data, 8)
        self.ref_index, packed, self.object_index, self.log_at, self.log_index = struct.unpack_from(">QQQQQ", foot, 24)
        self.object_at, self.width = packed >> 5, packed & 31
        ends = [x for x in (self.ref_index, self.object_at, self.log_at) if x]
        self.refs_end = min(ends, default=len(data) - 68)
        self.reads = 0

    def _records(self, at: int, seek: bytes | None = None):
        """(mark, records (key, low bits, body, position of the rest), position behind) of the block at a position; from a restart before seek on."""
        self.reads += 1
        skip = 24 if at == 0 else 0
        mark = self.data[at + skip : at + skip + 1]
        size = int.from_bytes(self.data[at + skip + 1 : at + skip + 4], "big")
        if mark == b"g":
            z, head = zlib.decompressobj(), at + skip + 4
            packed = self.data[head : head + size + 1024]  # compressed data is hardly ever longer than what it stands for
            body = self.data[at + skip : head] + z.decompress(packed)
            behind = head + len(packed) - len(z.unused_data)
            start, base = 4, 0
        else:
            body, behind, start, base = self.data[at : at + size], at + size, skip + 4, 0
        count = int.from_bytes(body[size - 2 : size], "big")
        end, place = size - 2 - 3 * count, start
        if seek is not None and count:

            def restart(k):
                return int.from_bytes(body[end + 3 * k : end + 3 * k + 3], "big")

            def whole(k):
                _, p = read_varint(body, restart(k))
                n, p = read_varint(body, p)
                return body[p : p + (n >> 3)]

            place = restart(max(0, bisect.bisect_right(range(count), seek, key=whole) - 1))

        def rows(p=place, key=b""):
            while p < end:
                same, p = read_varint(body, p)
                n, p = read_varint(body, p)
                key = key[:same] + body[p : p + (n >> 3)]
                p += n >> 3
                value = yield key, n & 7, body, p
                p = value if value is not None else p

        return mark, rows(), behind

    def _walk(self, at: int, decode, seek: bytes | None = None):
        """decode(key, bits, body, place) -> (item, place) for each record of a block."""
        mark, rows, behind = self._records(at, seek)
        found = []
        try:
            key, bits, body, place = next(rows)
            while True:
                item, place = decode(key, bits, body, place)
                found.append((key, item))
                key, bits, body, place = rows.send(place)
        except StopIteration:
            return mark, found, behind

    def _from(self, at: int, decode, key: bytes):
        """The first (key, item) of a block that isn't in front of a key, or None; nothing behind it is decoded."""
        _, rows, _ = self._records(at, key)
        try:
            found, bits, body, place = next(rows)
            while True:
                item, place = decode(found, bits, body, place)
                if found >= key:
                    return found, item
                found, bits, body, place = rows.send(place)
        except StopIteration:
            return None

    def columns(self):
        """Lists (names, indexes, kinds, ids, peeled ids, targets) of each block of refs: the fast way through all of them."""
        at = 0
        while 24 < self.refs_end and at < self.refs_end:
            skip = 24 if at == 0 else 0
            if self.data[at + skip : at + skip + 1] != b"r":
                return
            size = int.from_bytes(self.data[at + skip + 1 : at + skip + 4], "big")
            body = self.data[at : at + size]
            place, end = skip + 4, size - 2 - 3 * int.from_bytes(body[size - 2 : size], "big")
            names, indexes, kinds, ids, peeled, targets = out = ([], [], [], [], [], [])
            key, low = b"", self.low
            while place < end:
                same, n = body[place], body[place + 1]
                if same & 128 or n & 128:
                    same, place = read_varint(body, place)
                    n, place = read_varint(body, place)
                else:
                    place += 2
                kind, n = n & 7, place + (n >> 3)
                key = key[:same] + body[place:n]
                step = body[n]
                if step & 128:
                    step, place = read_varint(body, n)
                else:
                    place = n + 1
                names.append(key)
                indexes.append(low + step)
                kinds.append(kind)
                if kind == PLAIN:
                    ids.append(body[place : place + 20])
                    peeled.append(None)
                    targets.append(None)
                    place += 20
                else:
                    r, place = self._ref(key, kind, body, n)
                    ids.append(r.oid and bytes.fromhex(r.oid))
                    peeled.append(r.peeled)
                    targets.append(r.target)
            yield out
            at += size + (-(at + size) % self.block if self.block else 0)

    def _ref(self, key, kind, body, at):
        step, at = read_varint(body, at)
        oid = peeled = target = None
        if kind in (PLAIN, PEELED):
            oid, at = body[at : at + 20].hex(), at + 20
        if kind == PEELED:
            peeled, at = body[at : at + 20].hex(), at + 20
        if kind == SYMBOLIC:
            n, at = read_varint(body, at)
            target, at = body[at : at + n].decode(), at + n
        return Ref(key.decode(), self.low + step, oid, peeled, target), at

    def _place(self, index: int, key: bytes, first: int) -> int | None:
        """The block in which a key stands or would stand; through any levels of index."""
        at = index or first
        while index:
            hit = self._from(at, lambda k, b, body, p: read_varint(body, p), key)
            if hit is None:
                return None
            at = hit[1]
            skip = 24 if at == 0 else 0
            if self.data[at + skip : at + skip + 1] != b"i":
                return at
        return at

    def refs_from(self, name: str = ""):
        """Refs from a name on, in order."""
        if self.refs_end <= 24:
            return
        key = name.encode()
        at = self._place(self.ref_index, key, 0) if key else 0
        seek = key or None
        while at is not None and at < self.refs_end:
            skip = 24 if at == 0 else 0
            if self.data[at + skip : at + skip + 1] != b"r":
                return
            _, found, behind = self._walk(at, self._ref, seek)
            for k, r in found:
                if k >= key:
                    yield r
            at, seek = behind + (-behind % self.block if self.block else 0), None

    def ref(self, name: str) -> Ref | None:
        if self.refs_end <= 24 or self.data[24:25] != b"r":
            return None
        at = self._place(self.ref_index, name.encode(), 0)
        hit = None if at is None else self._from(at, self._ref, name.encode())
        return hit[1] if hit is not None and hit[1].name == name else None

    def with_prefix(self, prefix: str):
        for r in self.refs_from(prefix):
            if not r.name.startswith(prefix):
                return
            yield r

    def by_object(self, oid: str):
        """Refs that point to an object or peel to it: by the object blocks if there are some, else by a scan."""
        if not self.object_at:
            yield from (r for r in self.refs_from() if oid in (r.oid, r.peeled))
            return
        key = bytes.fromhex(oid)[: self.width]

        def places(k, count, body, p):
            if not count:
                count, p = read_varint(body, p)
            at, found = 0, []
            for _ in range(count):
                step, p = read_varint(body, p)
                at += step
                found.append(at)
            return found, p

        block = self._place(self.object_index, key, self.object_at)
        if block is None:
            return
        hit = self._from(block, places, key)
        if hit is not None and hit[0] == key:
            for at in hit[1]:
                yield from (r for _, r in self._walk(at, self._ref)[1] if oid in (r.oid, r.peeled))

    def logs(self, name: str | None = None):
        """Log entries by name, newest first within one."""
        if not self.log_at:
            return
        key = None if name is None else name.encode() + b"\0"
        at = self.log_at if key is None else self._place(self.log_index, key, self.log_at)
        end = self.log_index or len(self.data) - 68

        def entry(k, kind, body, p):
            ref, back = k[:-9].decode(), 0xFFFFFFFFFFFFFFFF - struct.unpack(">Q", k[-8:])[0]
            if not kind:
                return Log(ref, back, "", "", "", "", 0, 0, "", True), p
            old, new, p = body[p : p + 20].hex(), body[p + 20 : p + 40].hex(), p + 40
            texts = []
            for part in range(3):
                if part == 2:
                    seconds, p = read_varint(body, p)
                    (zone,) = struct.unpack_from(">h", body, p)
                    p += 2
                n, p = read_varint(body, p)
                texts.append(body[p : p + n].decode())
                p += n
            return Log(ref, back, old, new, texts[0], texts[1], seconds, zone, texts[2]), p

        while at is not None and at < end:
            _, found, at = self._walk(at, entry, key)
            for k, x in found:
                if key is None or k.startswith(key):
                    yield x
                elif k > key:
                    return


# stacks


REFS = "file string, name string, update_index long, kind int, oid string, peeled string, target string"
LOGS = "file string, name string, update_index long, old string, new string, who string, email string, seconds long, zone int, message string, deleted boolean"


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ref").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")


def read(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """The ref rows of all files of a stack; with a prefix each file is searched, not scanned."""
    if prefix:
        work = lambda file, data: [(file, r.name, r.index, r.kind, r.oid, r.peeled, r.target) for r in Reftable(data).with_prefix(prefix)]
        return each(_tables(spark, folder), work, REFS, 1)

    def run(it):
        for batch in it:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                held = [[] for _ in range(6)]
                for columns in Reftable(data).columns():
                    for mine, more in zip(held, columns):
                        mine += more
                    if len(held[0]) >= 16384:
                        yield _rows(file, held)
                        held = [[] for _ in range(6)]
                if held[0]:
                    yield _rows(file, held)

    raw = _tables(spark, folder).mapInArrow(run, REFS.replace("oid string", "oid binary"))
    return raw.withColumn("oid", F.lower(F.hex("oid")))


def _rows(file: str, held: list) -> pa.RecordBatch:
    names, indexes, kinds, ids, peeled, targets = held
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(indexes, pa.int64()), pa.array(kinds, pa.int32()), pa.array(ids, pa.binary()), pa.array(peeled, pa.string()), pa.array(targets, pa.string())],
        names=["file", "name", "update_index", "kind", "oid", "peeled", "target"],
    )


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    work = lambda file, data: [(file, x.name, x.index, x.old, x.new, x.who, x.email, x.seconds, x.zone, x.message, x.deleted) for x in Reftable(data).logs()]
    return each(_tables(spark, folder), work, LOGS, 1)


def merged(rows: DataFrame, deletions: bool = False) -> DataFrame:
    """Of each name the row of the newest file (largest name); deleted names are left out unless asked for."""
    newest = rows.groupBy("name").agg(F.max_by(F.struct("update_index", "kind", "oid", "peeled", "target"), F.struct("file", "update_index")).alias("r")).select("name", "r.*")
    return newest if deletions else newest.where(F.col("kind") != DELETION)


def write(rows: DataFrame, folder: str, stamp: str, files: int = 1, block: int = BLOCK) -> DataFrame:
    """Files of rows (name, update_index, oid, peeled, target), dealt by ranges of names; (file, refs, bytes)."""

    def run(it):
        from pyspark import TaskContext

        refs = [Ref(*r) for batch in it for r in zip(*(batch.column(c).to_pylist() for c in ("name", "update_index", "oid", "peeled", "target")))]
        if refs:
            data = encode(refs, block=block)
            file = f"{stamp}-{TaskContext.get().partitionId():06d}.ref"
            fs, root = open_fs(folder)
            put(fs, f"{root}/{file}", data)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(refs)], pa.int64()), pa.array([len(data)], pa.int64())], names=["file", "refs", "bytes"])

    rows = rows.select("name", "update_index", "oid", "peeled", "target").repartitionByRange(files, "name").sortWithinPartitions("name")
    return rows.mapInArrow(run, "file string, refs long, bytes long")


def write_logs(rows: DataFrame, folder: str, stamp: str, files: int = 1) -> DataFrame:
    """Files of log rows (as ``Log``'s fields but deleted), dealt by ranges of names; (file, entries)."""
    names = ["name", "update_index", "old", "new", "who", "email", "seconds", "zone", "message"]

    def run(it):
        from pyspark import TaskContext

        logs = [Log(*r) for batch in it for r in zip(*(batch.column(c).to_pylist() for c in names))]
        if logs:
            file = f"{stamp}-{TaskContext.get().partitionId():06d}.ref"
            fs, root = open_fs(folder)
            put(fs, f"{root}/{file}", encode([], logs))
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(logs)], pa.int64())], names=["file", "entries"])

    return rows.select(*names).repartitionByRange(files, "name").mapInArrow(run, "file string, entries long")


def compacted(spark: SparkSession, folder: str, files: list[str], stamp: str, keep_deletions: bool = True) -> DataFrame:
    """One file in place of some of a stack: newest rows win; deletions stay unless the oldest file is among them."""
    rows = merged(read(spark, folder).where(F.col("file").isin(files)), deletions=keep_deletions)
    return write(rows, folder, stamp)


def to_compact(sizes: list[int], factor: int = 2) -> tuple[int, int] | None:
    """The range of a stack's files (oldest first) to merge, so that sizes fall geometrically; None if they do.

    Neighbours of one power of the factor form a run; the run of smallest files with two or more is taken, and older files that
    are smaller than what is merged so far join it.
    """
    level = [len(_digits(n, factor)) for n in sizes]
    runs, k = [], 0
    while k < len(sizes):
        end = k
        while end < len(sizes) and level[end] == level[k]:
            end += 1
        if end - k > 1:
            runs.append((level[k], k, end))
        k = end
    if not runs:
        return None
    _, start, end = min(runs)
    total = sum(sizes[start:end])
    while start and sizes[start - 1] < total:
        start -= 1
        total += sizes[start]
    return start, end


def _digits(n: int, base: int) -> list[int]:
    out = []
    while n:
        n, d = divmod(n, base)
        out.append(d)
    return out
