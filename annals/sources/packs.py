"""Packs: many objects in one file, some as differences from others; their indexes; several packs as one store.

A pack is read at scale by its index: rows (pack, oid, offset) are dealt by range of offsets, and each task reads the
entries of its range and resolves chains of differences by reading the bases where they stand. A pack without an index is parsed from front to
back, one task a pack. Packs are written one a task, from objects sorted so that likely bases come first and dealt by ranges of that order; their
number grows with the bytes, so that no pack does.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annals.sources.files import attempt_name, each, open_fs, put, split_uri

KIND_OF = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
NUMBER_OF = {v: k for k, v in KIND_OF.items()}
BY_OFFSET, BY_ID = 6, 7
WINDOW, DEEPEST, LEAST_DELTA, CACHE_BYTES = 10, 50, 64, 64 << 20
PACK_BYTES = 16 << 20  # of contents for each pack, on average
GRAIN, SLOTS = 16, 1 << 18


def object_id(kind: str, data: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(data)}\0".encode() + data).hexdigest()


# differences


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = data[at]
        at += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, at
        shift += 7


def _copy(start: int, size: int) -> bytes:
    """A copy instruction: which of four start and three size bytes follow is in its first byte."""
    op, tail = 128, b""
    for k in range(4):
        if x := start >> 8 * k & 255:
            op, tail = op | 1 << k, tail + bytes([x])
    if size != 0x10000:
        for k in range(3):
            if x := size >> 8 * k & 255:
                op, tail = op | 16 << k, tail + bytes([x])
    return bytes([op]) + tail


def _marks(data: bytes, grain: int = GRAIN) -> np.ndarray:
    """A number below SLOTS for each run of grain bytes (8 at least); equal runs have equal ones."""
    n = len(data) - grain + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    mixed = (words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[grain - 8 : grain - 8 + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(46)).astype(np.int64)


def _places(base: bytes, grain: int = GRAIN) -> dict[bytes, int]:
    """Where each of the blocks of a base stands first."""
    places: dict[bytes, int] = {}
    for at in range(0, len(base) - grain + 1, grain):
        places.setdefault(base[at : at + grain], at)
    return places


def make_delta(base: bytes, target: bytes, grain: int = GRAIN, places: dict[bytes, int] | None = None, hits: list[int] | None = None) -> bytes:
    """Instructions that make target from base: copies of common ranges, and new bytes between them.

    places: the base's ``_places``; hits: positions of target in order, all where one of the base's blocks starts among them.
    """
    if places is None:
        places = _places(base, grain)
    if hits is None:
        if grain < 8:
            hits = range(len(target) - grain + 1)
        else:
            there = np.zeros(SLOTS, bool)
            there[_marks(base, grain)[::grain]] = True
            hits = np.flatnonzero(there[_marks(target, grain)]).tolist()
    out = [_number(len(base)), _number(len(target))]

    def insert(data: bytes):
        for k in range(0, len(data), 127):
            part = data[k : k + 127]
            out.append(bytes([len(part)]) + part)

    fresh = 0
    for at in hits:
        if at < fresh:
            continue
        start = places.get(target[at : at + grain])
        if start is None:
            continue
        back = 0
        while at - back > fresh and start > back and target[at - back - 1] == base[start - back - 1]:
            back += 1
        size = grain
        while at + size + 64 <= len(target) and target[at + size : at + size + 64] == base[start + size : start + size + 64]:
            size += 64
        while at + size < len(target) and start + size < len(base) and target[at + size] == base[start + size]:
            size += 1
        insert(target[fresh : at - back])
        for k in range(-back, size, 0x10000):
            out.append(_copy(start + k, min(0x10000, size - k)))
        fresh = at + size
    insert(target[fresh:])
    return b"".join(out)


class Bases:
    """The last WINDOW objects as bases. Their blocks are marked in one table, a bit a base, so that one look at a target tells where it may meet which of them."""

    def __init__(self):
        self.table, self.held, self.next = np.zeros(SLOTS, np.uint16), [None] * WINDOW, 0

    def add(self, oid: str, kind: str, data: bytes, depth: int, marks: np.ndarray | None = None):
        k, self.next = self.next, (self.next + 1) % WINDOW
        bit, blocks = np.uint16(1 << k), (_marks(data) if marks is None else marks)[::GRAIN].copy()
        if self.held[k] is not None:
            self.table[self.held[k][4]] &= ~bit
        self.table[blocks] |= bit
        self.held[k] = [oid, kind, data, depth, blocks, None]

    def best(self, kind: str, data: bytes, marks: np.ndarray) -> tuple[str, bytes, int] | None:
        """(base, difference, differences on the way) of the smallest difference of under half the size, from the latest base among equals.

        A range copied with k whole blocks of the base in it has 16 k + 30 bytes at most and k hits, so 46 bytes a hit bound what is
        copied; bases that can't do better by this are left out without being tried.
        """
        found = self.table[marks]
        hits = np.flatnonzero(found)
        if not len(hits):
            return None
        found, best, limit = found[hits], None, len(data) // 2
        for n in range(1, WINDOW + 1):
            k = (self.next - n) % WINDOW
            base = self.held[k]
            if base is None or base[1] != kind or base[3] >= DEEPEST or len(base[2]) >= 8 * len(data):
                continue
            mine = hits[(found & np.uint16(1 << k)) != 0]
            if len(data) - 46 * len(mine) >= limit:
                continue
            if base[5] is None:
                base[5] = _places(base[2])
            delta = make_delta(base[2], data, places=base[5], hits=mine.tolist())
            if len(delta) < limit:
                best, limit = (base[0], delta, base[3] + 1), len(delta)
        return best


def delta_sizes(delta: bytes) -> tuple[int, int]:
    """(size of the base, size of the result)."""
    a, at = _read_number(delta, 0)
    return a, _read_number(delta, at)[0]


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The result of a difference; ValueError if it doesn't fit the base."""
    size, at = _read_number(delta, 0)
    want, at = _read_number(delta, at)
    if size != len(base):
        raise ValueError(f"base has {len(base)} bytes, not {size}")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            start = n = 0
            for k in range(4):
                if op & 1 << k:
                    start |= delta[at] << 8 * k
                    at += 1
            for k in range(3):
                if op & 16 << k:
                    n |= delta[at] << 8 * k
                    at += 1
            n = n or 0x10000
            if start + n > len(base):
                raise ValueError("copy beyond the base")
            out += base[start : start + n]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("unknown instruction")
    if len(out) != want:
        raise ValueError(f"result has {len(out)} bytes, not {want}")
    return bytes(out)


# entries


def entry_head(kind: int, size: int) -> bytes:
    first, size = kind << 4 | size & 15, size >> 4
    return bytes([first | 128]) + _number(size) if size else bytes([first])


def read_head(data: bytes, at: int = 0) -> tuple[int, int, int]:
    """(kind, size, position behind) of an entry."""
    x = data[at]
    kind, size = x >> 4 & 7, x & 15
    at += 1
    if x & 128:
        more, at = _read_number(data, at)
        size |= more << 4
    return kind, size, at


def distance(n: int) -> bytes:
    """How far back a base stands: seven bits a byte, each but the last counting one more."""
    out = [n & 127]
    while n := n >> 7:
        n -= 1
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def read_distance(data: bytes, at: int) -> tuple[int, int]:
    x = data[at]
    n = x & 127
    while x & 128:
        at += 1
        x = data[at]
        n = (n + 1 << 7) + (x & 127)
    return n, at + 1


def pack_head(count: int) -> bytes:
    return b"PACK" + struct.pack(">II", 2, count)


class PackWriter:
    """Writes entries; where the number of objects isn't known yet, only the entries (``finished`` adds the rest)."""

    def __init__(self, out, count: int | None = None):
        self.out, self.sum, self.at, self.entries = out, hashlib.sha1(), 0, []
        self.offsets: dict[str, int] = {}
        if count is None:
            self.at = len(pack_head(0))
        else:
            self._write(pack_head(count))

    def _write(self, data: bytes):
        self.out.write(data)
        self.sum.update(data)
        self.at += len(data)

    def add(self, oid: str, kind: str, data: bytes, base: str | None = None, delta: bytes | None = None, by_id: bool = False):
        """One object, whole or as a difference from base (by its place if that is in this pack and by_id isn't set)."""
        if delta is None:
            head = entry_head(NUMBER_OF[kind], len(data)) + zlib.compress(data)
        elif by_id or base not in self.offsets:
            head = entry_head(BY_ID, len(delta)) + bytes.fromhex(base) + zlib.compress(delta)
        else:
            head = entry_head(BY_OFFSET, len(delta)) + distance(self.at - self.offsets[base]) + zlib.compress(delta)
        self.offsets[oid] = self.at
        self.entries.append((oid, self.at, zlib.crc32(head)))
        self._write(head)

    def close(self) -> bytes:
        """The checksum that ends the pack."""
        mark = self.sum.digest()
        self.out.write(mark)
        return mark


def finished(body, out, count: int) -> bytes:
    """Copies entries behind a head with their number and closes with the checksum, which is returned."""
    total, part = hashlib.sha1(), pack_head(count)
    while part:
        out.write(part)
        total.update(part)
        part = body.read(1 << 20)
    out.write(total.digest())
    return total.digest()


def index_bytes(entries: list[tuple[str, int, int]], checksum: bytes) -> bytes:
    """A version 2 index of (oid, offset, crc): fan-out, ids, crcs, offsets (long ones apart), checksums."""
    rows = sorted(entries)
    first = np.bincount([int(o[:2], 16) for o, _, _ in rows], minlength=256).cumsum().astype(">u4")
    far = [at for _, at, _ in rows if at >= 1 << 31]
    short, n = [], 0
    for _, at, _ in rows:
        short.append(at if at < 1 << 31 else 1 << 31 | n)
        n += at >= 1 << 31
    body = b"\xfftOc" + struct.pack(">I", 2) + first.tobytes() + b"".join(bytes.fromhex(o) for o, _, _ in rows)
    body += np.array([c for _, _, c in rows], ">u4").tobytes() + np.array(short, ">u4").tobytes() + np.array(far, ">u8").tobytes() + checksum
    return body + hashlib.sha1(body).digest()


class PackIndex:
    """Search by id (the fan-out narrows, bisection finds) and by offset."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError("not a version 2 index")
        if hashlib.sha1(data[:-20]).digest() != data[-20:]:
            raise ValueError("damaged index")
        self.fan = np.frombuffer(data, ">u4", 256, 8)
        n = self.count = int(self.fan[255])
        self.data, self.ids_at = data, 8 + 1024
        self.crcs = np.frombuffer(data, ">u4", n, self.ids_at + 20 * n)
        short = np.frombuffer(data, ">u4", n, self.ids_at + 24 * n).astype(np.int64)
        far = np.frombuffer(data, ">u8", (len(data) - 40 - self.ids_at - 28 * n) // 8, self.ids_at + 28 * n).astype(np.int64)
        is_far = short >= 1 << 31
        if is_far.any():
            short[is_far] = far[short[is_far] & 0x7FFFFFFF]
        self.offsets = short
        self.checksum = data[-40:-20]

    def id_at(self, k: int) -> bytes:
        return self.data[self.ids_at + 20 * k : self.ids_at + 20 * k + 20]

    def __iter__(self):
        """(oid, offset, crc) in order of ids."""
        for k in range(self.count):
            yield self.id_at(k).hex(), int(self.offsets[k]), int(self.crcs[k])

    def _first(self, raw: bytes) -> int:
        lo, hi = int(self.fan[raw[0] - 1]) if raw[0] else 0, int(self.fan[raw[0]])
        return bisect.bisect_left(range(self.count), raw, lo, hi, key=self.id_at)

    def find(self, oid: str) -> int | None:
        """The offset of an object, or None."""
        raw = bytes.fromhex(oid)
        k = self._first(raw)
        return int(self.offsets[k]) if k < self.count and self.id_at(k) == raw else None

    def starting(self, prefix: str, most: int = 256) -> list[str]:
        """Ids that start with a prefix of two digits or more, at most so many."""
        k = self._first(bytes.fromhex((prefix + "0" * 40)[:40]))
        out = []
        while k < self.count and len(out) < most and (oid := self.id_at(k).hex()).startswith(prefix):
            out.append(oid)
            k += 1
        return out

    def by_offset(self) -> list[tuple[int, int, str]]:
        """(offset, offset of the next entry or -1, oid) in order of offsets."""
        order = np.argsort(self.offsets)
        at = self.offsets[order].tolist()
        return [(a, b, self.id_at(int(k)).hex()) for a, b, k in zip(at, [*at[1:], -1], order)]


class PackReader:
    """Objects of an open pack by offset; chains of differences are resolved without recursion, with a bounded cache."""

    def __init__(self, file, find=None):
        self.file, self.find, self.cache, self.held = file, find, OrderedDict(), 0

    def _inflated(self, at: int, head: bytes, used: int) -> tuple[bytes, int]:
        """(data, compressed bytes read) of the stream that starts at used within head, read on as needed."""
        z, out, taken, part = zlib.decompressobj(), [], 0, head[used:]
        self.file.seek(at + len(head))
        while True:
            out.append(z.decompress(part))
            taken += len(part) - len(z.unused_data)
            if z.eof:
                return b"".join(out), taken
            part = self.file.read(1 << 16)
            if not part:
                raise ValueError("pack ends within an entry")

    def entry(self, at: int) -> tuple[int, bytes, int | str | None, int]:
        """(kind, data as stored, base: offset or id, bytes of the entry)."""
        self.file.seek(at)
        head = self.file.read(4096)
        kind, size, used = read_head(head)
        base = None
        if kind == BY_OFFSET:
            n, used = read_distance(head, used)
            base = at - n
        elif kind == BY_ID:
            base, used = head[used : used + 20].hex(), used + 20
        data, taken = self._inflated(at, head, used)
        if len(data) != size:
            raise ValueError(f"entry at {at} has {len(data)} bytes, not {size}")
        return kind, data, base, used + taken

    def read(self, at: int) -> tuple[str, bytes, int]:
        """(type, data, differences on the way) of the object at an offset."""
        chain, place = [], at
        while True:
            if place in self.cache:
                kind, data, depth = self.cache[place]
                break
            number, data, base, _ = self.entry(place)
            if base is None:
                kind, depth = KIND_OF[number], 0
                break
            chain.append((place, data))
            place = base if isinstance(base, int) else self.find(base) if self.find else None
            if place is None:
                raise ValueError(f"base {base} isn't there")
        for where, delta in reversed(chain):
            data, depth = apply_delta(data, delta), depth + 1
            self._keep(where, (kind, data, depth))
        if not chain:
            self._keep(at, (kind, data, depth))
        return kind, data, depth

    def _keep(self, at: int, found):
        if len(found[1]) <= CACHE_BYTES // 4:
            if at not in self.cache:
                self.held += len(found[1])
            self.cache[at] = found
            while self.held > CACHE_BYTES:
                self.held -= len(self.cache.popitem(last=False)[1][1])


def parsed(file) -> tuple[list[tuple[str, int, int, str, int]], bytes]:
    """([(oid, offset, crc, type, size)], checksum) of a pack read from front to back; ValueError on any damage."""
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"PACK" or struct.unpack(">I", head[4:8])[0] not in (2, 3):
        raise ValueError("not a pack")
    (count,) = struct.unpack(">I", head[8:])
    at, places, by_id = 12, [], {}
    reader = PackReader(file, by_id.get)
    for _ in range(count):
        kind, data, base, size = reader.entry(at)
        file.seek(at)
        places.append((at, zlib.crc32(file.read(size))))
        if base is None:
            by_id[object_id(KIND_OF[kind], data)] = at
        at += size
    file.seek(0)
    total, left = hashlib.sha1(), at
    while left:
        part = file.read(min(left, 1 << 20))
        total.update(part)
        left -= len(part)
    mark = file.read(20)
    if total.digest() != mark:
        raise ValueError("checksum differs")
    out, waiting = [], places
    while waiting:  # entries whose base is named by id may wait for a later one
        late = []
        for place, crc in waiting:
            try:
                kind, data, _ = reader.read(place)
            except ValueError as missing:
                if "isn't there" not in str(missing):
                    raise
                late.append((place, crc))
                continue
            oid = object_id(kind, data)
            by_id[oid] = place
            out.append((oid, place, crc, kind, len(data)))
        if len(late) == len(waiting):
            raise ValueError(f"{len(late)} entries lack their base")
        waiting = late
    return out, mark


# DataFrames


MANIFEST = "pack string, objects long, deltas long, bytes long"


def write_packs(objects: DataFrame, folder: str, packs: int = 8) -> DataFrame:
    """Packs of objects (oid, type, data, name), each object once; (pack, objects, deltas, bytes), a row a pack.

    Objects are sorted by type, name and size, largest first, and dealt by ranges of that order to as many packs as asked for, or more: one
    for each PACK_BYTES. A base is sought among the last WINDOW of the pack.
    """
    total = objects.agg(F.sum(F.length("data").cast("long"))).first()[0] or 0
    packs = max(packs, -(-total // PACK_BYTES))
    once = objects.groupBy("oid").agg(F.min(F.struct("type", "name", "data")).alias("o")).select("oid", "o.type", "o.name", "o.data")
    order = ("type", "name", F.desc(F.length("data")), "oid")
    rows = once.repartitionByRange(packs, *order).sortWithinPartitions(*order).select("oid", "type", "data")

    def run(it):
        fs, root = open_fs(folder)
        mine = f"{root}/{attempt_name()}"
        near, deltas, writer = Bases(), 0, None
        for big in it:
            for at in range(0, big.num_rows, 64):
                for oid, kind, data in zip(*(big.slice(at, 64).column(c).to_pylist() for c in ("oid", "type", "data"))):
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        writer = PackWriter(fs.open_output_stream(f"{mine}.entries"))
                    marks = _marks(data)
                    best = near.best(kind, data, marks) if len(data) >= LEAST_DELTA else None
                    writer.add(oid, kind, data, *(best[:2] if best else ()))
                    deltas += best is not None
                    near.add(oid, kind, data, best[2] if best else 0, marks)
        if writer is None:
            return
        writer.out.close()
        with fs.open_input_stream(f"{mine}.entries") as body, fs.open_output_stream(f"{mine}.pack") as out:
            mark = finished(body, out, len(writer.entries))
        fs.delete_file(f"{mine}.entries")
        name = "pack-" + hashlib.sha1(b"".join(bytes.fromhex(o) for o in sorted(writer.offsets))).hexdigest()
        put(fs, f"{root}/{name}.idx", index_bytes(writer.entries, mark))
        fs.move(f"{mine}.pack", f"{root}/{name}.pack")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(writer.entries)], pa.int64()), pa.array([deltas], pa.int64()), pa.array([writer.at + 20], pa.int64())], names=["pack", "objects", "deltas", "bytes"])

    return rows.mapInArrow(run, MANIFEST)


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def indexes(spark: SparkSession, folder: str) -> DataFrame:
    """(pack, oid, offset, next_offset, crc) of all index files of a folder; next_offset is -1 for the last entry."""

    def work(path, data):
        index = PackIndex(data)
        crcs = {at: crc for _, at, crc in index}
        name = split_uri(path)[1].removesuffix(".idx")
        return [(name, oid, a, b, crcs[a]) for a, b, oid in index.by_offset()]

    return each(_files(spark, folder, "*.idx").select("path", "content"), work, "pack string, oid string, offset long, next_offset long, crc long", 1)


OBJECT = "pack string, oid string, offset long, type string, size long, depth long, data binary, problem string"


def objects(index: DataFrame, folder: str, data: bool = True) -> DataFrame:
    """The objects that index rows (pack, oid, offset) name; problem tells what is wrong with one, else null."""

    def run(it):
        fs, root = open_fs(folder)
        now = reader = found = None
        for big in it:
            for at in range(0, big.num_rows, 64):
                batch, out = big.slice(at, 64), []
                for pack, oid, offset in zip(*(batch.column(c).to_pylist() for c in ("pack", "oid", "offset"))):
                    if pack != now:
                        now, found = pack, None

                        def find(other, pack=pack):
                            nonlocal found
                            if found is None:
                                with fs.open_input_file(f"{root}/{pack}.idx") as f:
                                    found = PackIndex(f.read())
                            return found.find(other)

                        reader = PackReader(fs.open_input_file(f"{root}/{pack}.pack"), find)
                    try:
                        kind, body, depth = reader.read(offset)
                        wrong = None if object_id(kind, body) == oid else "id differs"
                        out.append((pack, oid, offset, kind, len(body), depth, body if data else None, wrong))
                    except (ValueError, zlib.error, KeyError, IndexError) as broken:
                        out.append((pack, oid, offset, None, None, None, None, f"{type(broken).__name__}: {broken}"))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in OBJECT.split(", ")])

    return index.select("pack", "oid", "offset").repartitionByRange("pack", "offset").sortWithinPartitions("pack", "offset").mapInArrow(run, OBJECT)


def parse_packs(spark: SparkSession, folder: str, write_index: bool = False) -> DataFrame:
    """(pack, oid, offset, crc, type, size, problem) of packs parsed without their index, which is written if asked for; one task a pack."""
    paths = _files(spark, folder, "*.pack").select("path")

    def work(path):
        fs, where = open_fs(path)
        name = split_uri(path)[1].removesuffix(".pack")
        try:
            with fs.open_input_file(where) as f:
                found, mark = parsed(f)
        except (ValueError, zlib.error, struct.error, KeyError, IndexError) as broken:
            return [(name, None, None, None, None, None, f"{type(broken).__name__}: {broken}")]
        if write_index:
            put(fs, where.removesuffix(".pack") + ".idx", index_bytes([r[:3] for r in found], mark))
        return [(name, *r, None) for r in found]

    # a range for each path: dealt by hash, the few short rows would be put together again, and one task would parse all
    return each(paths.repartitionByRange(max(1, paths.count()), "path"), work, "pack string, oid string, offset long, crc long, type string, size long, problem string", 1)


def one_store(index: DataFrame) -> DataFrame:
    """Each object of several packs once: (oid, pack, offset), from the pack of smallest name; a partial minimum, no merge in one task."""
    return index.groupBy("oid").agg(F.min(F.struct("pack", "offset")).alias("at")).select("oid", "at.pack", "at.offset")


def multi_index_bytes(packs: list[str], rows: list[tuple[str, int, int]]) -> bytes:
    """A multi-pack index of rows (oid, pack number, offset) in order of ids: names, fan-out, ids, places."""
    names = b"".join(p.encode() + b".idx\0" for p in packs)
    names += b"\0" * (-len(names) % 4)
    fan = np.bincount([int(o[:2], 16) for o, _, _ in rows], minlength=256).cumsum().astype(">u4").tobytes()
    chunks = [(b"PNAM", names), (b"OIDF", fan), (b"OIDL", b"".join(bytes.fromhex(o) for o, _, _ in rows))]
    far = [at for _, _, at in rows if at >= 1 << 31]
    places, n = [], 0
    for _, p, at in rows:
        places.append(struct.pack(">II", p, at if at < 1 << 31 else 1 << 31 | n))
        n += at >= 1 << 31
    chunks.append((b"OOFF", b"".join(places)))
    if far:
        chunks.append((b"LOFF", np.array(far, ">u8").tobytes()))
    return chunked(b"MIDX" + bytes([1, 1, len(chunks), 0]) + struct.pack(">I", len(packs)), chunks)


def chunked(head: bytes, chunks: list[tuple[bytes, bytes]]) -> bytes:
    """A file of named chunks with a table of their places, closed by a checksum."""
    at, table = len(head) + 12 * (len(chunks) + 1), b""
    for name, body in chunks:
        table += name + struct.pack(">Q", at)
        at += len(body)
    whole = head + table + b"\0\0\0\0" + struct.pack(">Q", at) + b"".join(b for _, b in chunks)
    return whole + hashlib.sha1(whole).digest()


def chunks_of(data: bytes, head: int, count: int) -> dict[bytes, bytes]:
    """The chunks of such a file by name."""
    if hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise ValueError("damaged file")
    rows = [(data[head + 12 * k : head + 12 * k + 4], struct.unpack_from(">Q", data, head + 12 * k + 4)[0]) for k in range(count + 1)]
    return {name: data[a:b] for (name, a), (_, b) in zip(rows, rows[1:])}


def read_multi_index(data: bytes) -> list[tuple[str, str, int]]:
    """(oid, pack, offset) in order of ids."""
    if data[:4] != b"MIDX":
        raise ValueError("not a multi-pack index")
    found = chunks_of(data, 12, data[6])
    packs = [x.decode().removesuffix(".idx") for x in found[b"PNAM"].split(b"\0") if x]
    ids, places = found[b"OIDL"], np.frombuffer(found[b"OOFF"], ">u4").reshape(-1, 2)
    far = np.frombuffer(found.get(b"LOFF", b""), ">u8")
    return [(ids[20 * k : 20 * k + 20].hex(), packs[p], int(far[at & 0x7FFFFFFF]) if at >> 31 else int(at)) for k, (p, at) in enumerate(places.tolist())]


def write_multi_index(index: DataFrame, folder: str) -> DataFrame:
    """Multi-pack index files, one for each first digit of ids, so that no task holds all ids; (part, objects)."""
    # pack names, a row a file: the same list stands in each part
    packs = sorted(r.pack for r in index.select("pack").distinct().collect())
    rows = one_store(index).withColumn("part", F.substr("oid", F.lit(1), F.lit(1)))

    def part(key, table):
        number = {p: k for k, p in enumerate(packs)}
        got = sorted((o, number[p], at) for o, p, at in zip(*(table.column(c).to_pylist() for c in ("oid", "pack", "offset"))))
        fs, root = open_fs(folder)
        put(fs, f"{root}/multi-pack-index-{key[0].as_py()}", multi_index_bytes(packs, got))
        return pa.table({"part": pa.array([key[0].as_py()]), "objects": pa.array([len(got)], pa.int64())})

    return rows.groupBy("part").applyInArrow(part, "part string, objects long")


def multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """(oid, pack, offset) of a folder's multi-pack index files."""
    return each(_files(spark, folder, "multi-pack-index*").select("content"), read_multi_index, "oid string, pack string, offset long", 1)


def unneeded(packed: DataFrame, pack_names: DataFrame) -> DataFrame:
    """Packs of pack_names (pack) none of whose objects is read from them (one_store's choice)."""
    return pack_names.join(packed.select("pack").distinct(), "pack", "left_anti")


def checked(index: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of an index that differ from what its pack has, or that only one of them has: (pack, oid, problem)."""
    a = index.select("pack", "oid", F.struct("offset", "crc").alias("said"))
    b = found.where("problem is null").select("pack", "oid", F.struct("offset", "crc").alias("is"))
    both = a.join(b, ["pack", "oid"], "full").where("not (said <=> is)")
    wrong = F.when(F.col("said").isNull(), "not in the index").when(F.col("is").isNull(), "not in the pack").otherwise("offset or checksum differ")
    return both.select("pack", "oid", wrong.alias("problem")).unionByName(found.where("problem is not null").select("pack", F.lit(None).cast("string").alias("oid"), "problem"))


def mru_order(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(oid, pack, offset) of wanted (oid), each from the pack that holds most of them, as a reader that tries its last pack first would; ties by name."""
    hits = wanted.select("oid").distinct().join(index.select("oid", "pack", "offset"), "oid")
    often = hits.groupBy("pack").agg(F.count("*").alias("n"))
    return hits.join(F.broadcast(often), "pack").groupBy("oid").agg(F.min(F.struct((-F.col("n")).alias("k"), "pack", "offset")).alias("at")).select("oid", "at.pack", "at.offset")


def next_offsets(index: DataFrame) -> DataFrame:
    """(pack, offset, oid, length) by offset: the reverse index; the window is one pack."""
    w = Window.partitionBy("pack").orderBy("offset")
    return index.select("pack", "offset", "oid", (F.lead("offset").over(w) - F.col("offset")).alias("length"))
