"""Token ids in sorted-string-table shards.

A shard holds documents keyed by identifier, in key order::

    data block*   entries (shared, unshared, value size as varints; key suffix; value), then the
                  offsets of every RESTART-th entry (which has its whole key), their number; zstd; crc32
    index block   for each data block: its last key, offset, size
    Bloom filter  BLOOM_BITS bits a key, BLOOM_HASHES positions from one 64-bit hash
    footer        offsets and sizes of index and filter, documents, ids, bytes an id, version, magic

A key is the id as 8 big-endian bytes with the sign bit flipped (so bytes sort as ids), or empty for a null
id. A value is the number of ids before the document in the shard (varint), then its ids as
little-endian 16- or 32-bit integers. ``Shard.get`` reads footer, filter and index once, tests the filter,
searches the index by bisection and then the block's restarts, and reads one block.

Scale: documents are range-partitioned by id and sorted in each partition; a task writes one shard
under a name of its attempt and then moves it to its final name, so that repeated and lost tasks leave
whole files only. The manifest has one row a shard; starts are its running sum.

Encoding: pieces of byte-level BPE can't cross a single blank or line feed between two other characters, so the ids of a word with what is
in front are remembered (at most MEMO words of up to MEMO_CHARS characters a worker) and only new words go
to the library. Texts with a blank beside other white space are cut elsewhere only; other kinds of
tokenizers encode whole texts.

Defined cases: null and empty texts have just the end id; null ids come first; repeated ids are kept, each
with its own row (``get`` returns all); an empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annals.llm.common import batches_of, open_fs, saved, shared_folder

MEMO, MEMO_CHARS = 1_000_000, 48
BLOCK_BYTES, RESTART = 1 << 16, 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"annalsT1"
FOOTER = struct.Struct("<QQQQQQII8s")

_BESIDE = re.compile(r" \s|\s ")
_SINGLE = re.compile(r"(?<!\s) (?!\s)")
_BLANK_BEFORE_WORD = re.compile(" ")
_ODD_SPACE = re.compile(r"[^\S \n\t\r\f\v]")


#: White space beside blank and line feed, as the tokenizers' ``\\s`` has it.
_OTHERS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def _words(text: str) -> list[str]:
    """The text cut before white space that no piece can cross: each word but the first has a blank in front, or starts with a line feed."""
    alone = "  " not in text and not any(c in text for c in _OTHERS)
    if alone and "\n" not in text:
        return text.split(" ")
    if alone and " \n" not in text and "\n " not in text and "\n\n" not in text:
        return text.replace("\n", " \n").split(" ")
    return _SINGLE.split(text) if _BESIDE.search(text) else _BLANK_BEFORE_WORD.split(text)


class Memo(dict):
    """Ids of words behind a blank; new words are encoded and, unless very long, remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word if word[:1] == "\n" else " " + word)
        if len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without special tokens added."""

    def __init__(self, file: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.load(open(file, encoding="utf-8"))
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.by_word = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and model.get("type") == "BPE" and not model.get("dropout") and spec.get("truncation") is None and spec.get("padding") is None
            and not any(" " in t for t in added) and not any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word"))
        )
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.memo = Memo(self._new)
        self.pieces: dict[str, bytes] = {}
        if self.by_word:
            import regex

            # the split that byte-level pre-tokenizers make, and their printable stand-ins for bytes
            self.split = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.table = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in shown)}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _new(self, word: str) -> bytes:
        if self.added and self.added.search(word) or _ODD_SPACE.search(word):
            return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        out = []
        for piece in self.split(word):
            ids = self.pieces.get(piece)
            if ids is None:
                shown = piece.encode().decode("latin-1").translate(self.table)
                ids = self._bytes([t.id for t in self.tokenizer.model.tokenize(shown)])
                if len(piece) <= MEMO_CHARS:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``width`` each."""
        if not self.by_word:
            return [self._bytes(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        out, known = [], memo.__getitem__
        for text in texts:
            words = _words(text)
            first = self._new(words[0]) if words[0] else b""
            del words[0]
            out.append(first + b"".join(map(known, words)))
        return out


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    return Encoder(file)


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        x = data[at]
        at += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, at


def _positions(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    step = (h >> 33) | 1
    return [(h + k * step) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.zstd = out, width, zstandard.ZstdCompressor(level=1)
        self.at = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self._fresh()

    def _fresh(self):
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""

    def add(self, doc_id: int | None, ids: bytes):
        key = key_of(doc_id)
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = 0
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        before = _varint(self.ids)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(before) + len(ids)) + key[shared:] + before
        self.block += ids
        self.entries += 1
        self.docs += 1
        self.ids += len(ids) // self.width
        self.last = key
        self.hashes.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self):
        if not self.entries:
            return
        raw = bytes(self.block) + np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
        packed = self.zstd.compress(raw)
        packed += struct.pack("<I", zlib.crc32(packed))
        self.out.write(packed)
        self.index.append((self.last, self.at, len(packed)))
        self.at += len(packed)
        self._fresh()

    def close(self):
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.hashes))
        bloom = np.zeros(bits, np.uint8)
        for key in self.hashes:
            bloom[_positions(key, bits)] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.ids, self.width, 1, MAGIC))


class Shard:
    """A shard opened for reading; file is any seekable binary file with a known size."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        tail = self._read(size - FOOTER.size, FOOTER.size)
        index_at, index_size, bloom_at, self.bits, self.docs, self.ids, self.width, version, magic = FOOTER.unpack(tail)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        data, at = self._read(index_at, index_size), 0
        self.last, self.blocks = [], []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last.append(bytes(data[at : at + n]))
            offset, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.blocks.append((offset, length))
        self.bloom = self._read(bloom_at, (self.bits + 7) // 8)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> tuple[bytes, np.ndarray, int]:
        packed = self._read(*self.blocks[k])
        if zlib.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError("damaged block")
        raw = self.zstd.decompress(packed[:-4])
        (n,) = struct.unpack("<I", raw[-4:])
        end = len(raw) - 4 - 4 * n
        return raw, np.frombuffer(raw, "<u4", n, end), end

    def _entries(self, raw: bytes, at: int, end: int):
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            before, value = _read_varint(raw, at)
            yield key, before, raw[value : at + size]
            at += size

    def scan(self):
        """(doc id, ids before it in the shard, its ids as bytes), in key order."""
        for k in range(len(self.blocks)):
            raw, _, end = self._block(k)
            for key, before, ids in self._entries(raw, 0, end):
                yield id_of(key), before, ids

    def may_have(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _positions(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this id; empty if there is none."""
        key, found = key_of(doc_id), []
        if not self.may_have(doc_id):
            return found
        k = bisect.bisect_left(self.last, key)
        while k < len(self.blocks):
            raw, restarts, end = self._block(k)

            def whole(r):
                _, at = _read_varint(raw, int(r))
                n, at = _read_varint(raw, at)
                _, at = _read_varint(raw, at)
                return raw[at : at + n]

            first = max(0, bisect.bisect_left(restarts, key, key=whole) - 1)
            for other, _, ids in self._entries(raw, int(restarts[first]), end):
                if other > key:
                    return found
                if other == key:
                    found.append(np.frombuffer(ids, f"<u{self.width}"))
            k += 1
        return found


MANIFEST = "shard int, file string, docs long, ids long, first long, last long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Shards of docs (doc_id, text) in the folder; their manifest, with base: the ids in all earlier shards."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(it):
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId()
        e = encoder(tokenizer)
        end = np.array([end_id], e.dtype).tobytes()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/shard-{number:06d}.sst"
        mine = f"{root}/.{number:06d}-{task.taskAttemptId()}"
        writer = out = first = last = None
        for big in it:
            for batch in batches_of(big, 256):
                if not batch.num_rows:
                    continue
                if writer is None:
                    out = fs.open_output_stream(mine)
                    writer = ShardWriter(out, e.width)
                    first = batch.column("doc_id")[0].as_py()
                ids = batch.column("doc_id").to_pylist()
                for i, x in zip(ids, e.encode([t or "" for t in batch.column("text").to_pylist()])):
                    writer.add(i, x + end)
                last = ids[-1]
        if writer is not None:
            writer.close()
            out.close()
            fs.move(mine, name)
            yield pa.RecordBatch.from_pylist([{"shard": number, "file": f"shard-{number:06d}.sst", "docs": writer.docs, "ids": writer.ids, "first": first, "last": last}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    manifest = saved(rows.mapInArrow(run, MANIFEST), "manifest")
    return manifest.withColumn("base", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' bytes; start counts all shards."""

    def run(it):
        fs, root = open_fs(folder)
        for batch in it:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                path = f"{root}/{file}"
                with fs.open_input_file(path) as f:
                    shard = Shard(f, f.size())
                    ids, starts, counts, sums = [], [], [], []
                    for doc_id, before, raw in shard.scan():
                        wide = raw if shard.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                        ids.append(doc_id)
                        starts.append(base + before)
                        counts.append(len(wide) // 4)
                        sums.append(zlib.crc32(wide))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("file", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of wanted (doc_id): each id goes to the shards whose range holds it and is searched there."""
    pairs = wanted.join(F.broadcast(manifest.select("file", "first", "last")) if manifest.count() < 10_000 else manifest, F.col("doc_id").between(F.col("first"), F.col("last"))).select("file", "doc_id")

    def run(it):
        fs, root = open_fs(folder)
        open_now, shard = None, None
        for batch in it:
            found_ids, found = [], []
            for file, doc_id in zip(batch.column("file").to_pylist(), batch.column("doc_id").to_pylist()):
                if file != open_now:
                    f = fs.open_input_file(f"{root}/{file}")
                    open_now, shard = file, Shard(f, f.size())
                for ids in shard.get(doc_id):
                    found_ids.append(doc_id)
                    found.append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(found_ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return pairs.sortWithinPartitions("file").mapInArrow(run, "doc_id long, ids array<int>")


def written(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, str]:
    """(manifest, folder) of shards in a new folder of the shared one."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return write(docs, folder, tokenizer, end_id), folder
