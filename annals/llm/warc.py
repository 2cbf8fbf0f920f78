"""WARC archives with a two-level capture index.

Archives: one gzip member a record, one file a task. Of records with equal payloads of at least
LEAST bytes the one with the smallest page id is a response, the others are revisits that refer to it.

Index: captures sorted by reversed-host key (``com,example,www)/path``) and page id are cut into blocks of LINES lines, each
a gzip member of ``index-*.cdx.gz``; beside it ``index-*.dir`` has each block's first capture, offset and
size, the sparse directory; ``index.top`` has the first capture of each index file. A search bisects the top, then the
directory, reads one block by its range, bisects its lines and then reads the record by its range. ``lookup`` does so for urls,
``located`` for the captures of pages; wanted keys are sorted first, so that neighbours share a block.

Scale: page bodies are shuffled only if the revisits don't fit a broadcast (their written size decides); equal
payloads meet as digests, a partial minimum whatever their number. Records are read in ranges of READ_BYTES of the archives. Files are written under a name of
the attempt and then moved, so lost and repeated tasks leave whole files only.

Defined cases: null html is an empty payload; null urls have the empty key; control characters and blanks
of urls are percent-encoded in archive and key; repeated page ids are records of their own (equal ones are both responses); pages
without id get no record; payloads of any length are whole, one at a time in memory; an empty table gives no file and an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annals.llm.common import batches_of, open_fs, saved, shared_folder

LEAST, LINES, LEVEL, READ_BYTES = 100, 1024, 3, 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def clean_url(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def reversed_host_key(url: str | None) -> str:
    """``http://www.Example.com:80/A?b#c`` -> ``com,example,www)/A?b``."""
    url = clean_url(url)
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min([x for x in (rest.find("/"), rest.find("?")) if x >= 0], default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    name, _, port = host.partition(":")
    key = ",".join(reversed(name.split(".")))
    return f"{key}{':' + port if port and port not in ('80', '443') else ''}){path}"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:annals:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {clean_url(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:annals:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def parse(member: bytes) -> dict:
    """Headers (lower-case names), page_id, refers_to and payload of one compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    number = lambda x: int(x.rsplit(":", 1)[1].rstrip(">")) if x else None
    return {"fields": fields, "page_id": number(fields["warc-record-id"]), "refers_to": number(fields.get("warc-refers-to")), "type": fields["warc-type"], "payload": payload, "length": length, "digest": fields["warc-payload-digest"].split(":", 1)[1]}


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records that are revisits."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = saved(pages.where("page_id is not null").select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= LEAST), "digests")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return saved(digests.join(firsts, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")


CAPTURE = "key string, page_id long, file string, at long, size long"


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of pages (page_id, url, html); their captures (key, page_id, file, at, size)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.sha2(body, 256).alias("digest"))
    rows = rows.join(revisits(pages), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(it):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"pages-{task.partitionId():06d}.warc.gz"
        mine = f"{root}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        out, at, found = None, 0, ([], [], [], [])
        for big in it:
            for batch in batches_of(big, 512):
                if out is None and batch.num_rows:
                    out = fs.open_output_stream(mine)
                    info = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:annals:file:{task.partitionId()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())
                    out.write(info)
                    at = len(info)
                for i, url, payload, digest, to in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    member = record(i, url, payload, digest, to)
                    out.write(member)
                    for column, value in zip(found, (reversed_host_key(url), i, at, len(member))):
                        column.append(value)
                    at += len(member)
        if out is not None:
            out.close()
            fs.move(mine, f"{root}/{name}")
            for s in range(0, len(found[0]), 4096):
                key, ids, where, size = (c[s : s + 4096] for c in found)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(ids, pa.int64()), pa.array([name] * len(ids), pa.string()), pa.array(where, pa.int64()), pa.array(size, pa.int64())], names=["key", "page_id", "file", "at", "size"])

    return saved(rows.mapInArrow(run, CAPTURE), "captures")


_INDEX = "file string, first string, first_page long, blocks long, captures long"


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes index, directory and top files; (file, first, first_page, blocks, captures), a row a file."""
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def run(it):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        stem = f"index-{task.partitionId():06d}"
        mine = f"{root}/.{stem}-{task.taskAttemptId()}"
        out, at, held, directory, n = None, 0, [], [], 0

        def flush():
            nonlocal at, held
            member = _member("".join(held).encode())
            out.write(member)
            key, page_id, _ = held[0].split("\t", 2)
            directory.append(f"{key}\t{page_id}\t{at}\t{len(member)}\n")
            at += len(member)
            held = []

        for batch in it:
            for key, page_id, file, where, size in zip(*(batch.column(k).to_pylist() for k in range(5))):
                out = out or fs.open_output_stream(mine)
                held.append(f"{key}\t{page_id}\t{file}\t{where}\t{size}\n")
                n += 1
                if len(held) == LINES:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with fs.open_output_stream(f"{mine}d") as d:
                d.write("".join(directory).encode())
            fs.move(f"{mine}d", f"{root}/{stem}.dir")
            fs.move(mine, f"{root}/{stem}.cdx.gz")
            key, page_id, _ = directory[0].split("\t", 2)
            yield pa.RecordBatch.from_pylist([{"file": stem, "first": key, "first_page": int(page_id), "blocks": len(directory), "captures": n}], schema=pa.schema([("file", pa.string()), ("first", pa.string()), ("first_page", pa.int64()), ("blocks", pa.int64()), ("captures", pa.int64())]))

    index = saved(ordered.select("key", "page_id", "file", "at", "size").mapInArrow(run, _INDEX), "index")

    def top(it):
        rows = sorted((f, k, p) for batch in it for f, k, p in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "first_page"))))
        if rows:
            fs, root = open_fs(folder)
            with fs.open_output_stream(f"{root}/.index.top") as f:
                f.write("".join(f"{k}\t{p}\t{file}\n" for file, k, p in rows).encode())
            fs.move(f"{root}/.index.top", f"{root}/index.top")
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["files"])

    index.select("file", "first", "first_page").repartition(1).mapInArrow(top, "files long").collect()  # a row a file of the index
    return index


def _range(f, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(size)


LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class CaptureIndex:
    """The index files of a folder, searched by bisection; the last directory and block read are kept."""

    def __init__(self, folder: str):
        self.fs, self.root = open_fs(folder)
        rows = []
        if self.fs.get_file_info(f"{self.root}/index.top").is_file:
            with self.fs.open_input_stream(f"{self.root}/index.top") as f:
                rows = [x.split("\t") for x in f.read().decode().split("\n")[:-1]]
        self.firsts = [(k, int(p)) for k, p, _ in rows]
        self.stems = [s for _, _, s in rows]
        self.stem = self.number = self.file = None
        self.reads = 0

    def _directory(self, stem: str):
        if stem != self.stem:
            with self.fs.open_input_stream(f"{self.root}/{stem}.dir") as d:
                rows = [x.split("\t") for x in d.read().decode().split("\n")[:-1]]
            self.heads, self.ranges = [(k, int(p)) for k, p, _, _ in rows], [(int(a), int(n)) for _, _, a, n in rows]
            if self.file is not None:
                self.file.close()
            self.file, self.stem, self.number = self.fs.open_input_file(f"{self.root}/{stem}.cdx.gz"), stem, None

    def _block(self, k: int):
        if k != self.number:
            rows = [x.split("\t") for x in zlib.decompress(_range(self.file, *self.ranges[k]), 31).decode().split("\n")[:-1]]
            self.keys, self.rest, self.number = [(r[0], int(r[1])) for r in rows], [(r[2], int(r[3]), int(r[4])) for r in rows], k
            self.reads += 1

    def find(self, key: str, page_id: int | None = None):
        """(page_id, file, at, size) of the captures with this key, and page id if one is given."""
        low, high = (key, LOWEST if page_id is None else page_id), (key, HIGHEST if page_id is None else page_id)
        f = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while f < len(self.stems) and self.firsts[f] <= high:
            self._directory(self.stems[f])
            k = max(0, bisect.bisect_left(self.heads, low) - 1)
            while k < len(self.heads) and self.heads[k] <= high:
                self._block(k)
                at = bisect.bisect_left(self.keys, low)
                while at < len(self.keys) and self.keys[at] <= high:
                    yield self.keys[at][1], *self.rest[at]
                    at += 1
                k += 1
            f += 1


def _keyed(pages: DataFrame, *more: str) -> DataFrame:
    """(key, more) of pages (url, more)."""

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([reversed_host_key(u) for u in batch.column("url").to_pylist()], pa.string()), *[batch.column(c) for c in more]], names=["key", *more])

    schema = pages.select(F.lit("").alias("key"), *more).schema
    return pages.select("url", *more).mapInArrow(run, schema)


def located(folder: str, pages: DataFrame) -> DataFrame:
    """The captures (key, page_id, file, at, size) of pages (page_id, url), each searched in the index."""
    wanted = _keyed(pages.where("page_id is not null").select("url", F.col("page_id").cast("long").alias("page_id")), "page_id").distinct()

    def run(it):
        index = CaptureIndex(folder)
        for batch in it:
            found = [(key, *x) for key, i in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist()) for x in index.find(key, i)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "at", "size"])

    return wanted.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, CAPTURE)


RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, computed string, payload_digest string"


def read(captures: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of captures by range reads, file by file in order: page_id, url, record_type, refers_to, payload (if asked for), payload_bytes (as read; of a revisit as its HTTP header has it), computed (digest of what is there), payload_digest as declared. captures: written ones."""
    parts = 1 + (captures.agg(F.sum("size")).first()[0] or 0) // READ_BYTES
    want = captures.select("file", "at", "size").repartitionByRange(parts, "file", "at").sortWithinPartitions("file", "at")

    def run(it):
        fs, root = open_fs(folder)
        open_now, f = None, None
        for big in it:
            for batch in batches_of(big, 512):
                rows = []
                for file, at, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if file != open_now:
                        if f is not None:
                            f.close()
                        open_now, f = file, fs.open_input_file(f"{root}/{file}")
                    r = parse(_range(f, at, size))
                    there = r["payload"]
                    rows.append((r["page_id"], r["fields"].get("warc-target-uri"), r["type"], r["refers_to"], there if payload else None, len(there) if r["type"] == "response" else r["length"], hashlib.sha256(there).hexdigest() if r["type"] == "response" else None, r["digest"]))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    return want.mapInArrow(run, RECORD)


def lookup(folder: str, urls: DataFrame) -> DataFrame:
    """The captures (url, key, page_id, file, at, size) of urls (url), by the index; a key with many captures is read on from its first block."""
    wanted = _keyed(urls.select("url", F.col("url").alias("asked")), "asked").repartitionByRange("key").sortWithinPartitions("key")

    def run(it):
        index = CaptureIndex(folder)
        for batch in it:
            found = [(url, key, *x) for key, url in zip(batch.column("key").to_pylist(), batch.column("asked").to_pylist()) for x in index.find(key)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["url", "key", "page_id", "file", "at", "size"])

    return wanted.mapInArrow(run, f"url string, {CAPTURE}")


def archived(pages: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(captures, index, folder) of archives in a new folder of the shared one."""
    folder = shared_folder(pages.sparkSession, "warc")
    captures = write(pages, folder)
    return captures, build_index(captures, folder), folder
