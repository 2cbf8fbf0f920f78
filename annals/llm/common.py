"""What the operators share: the shared folder, written intermediates, files in any store, hashed words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.plans.shared import shared_folder, shared_root, written  # noqa: F401

#: White space between words, as in ``[^\x20\x09-\x0D]+``.
SPACE_RE = "[\\x20\\x09-\\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

#: The same as SQL strings: blanks to trim, and what lies between words.
BLANKS = "' \\t\\n\\u000B\\f\\r'"
SPLIT = "'[\\\\x20\\\\x09-\\\\x0D]+'"

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)


#: Rows that go to a Python worker at once while an intermediate is made; both sides hold a batch whole.
BATCH_ROWS = 1024


def saved(df: DataFrame, what: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts lineage and survives lost executors."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    try:
        return written(df, what)
    finally:
        conf.set(key, before)


def open_fs(uri: str):
    """(file system, path) of a folder in any store that Arrow knows; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri:
        if uri.startswith("file:"):
            uri = "file://" + uri[5:].replace("//", "/")
        else:
            return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def batches_of(batch: pa.RecordBatch, rows: int):
    """Slices of at most that many rows, so that what a task builds at once is bounded."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _factors(n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


#: Bytes of text hashed at once; a longer word is hashed whole.
PIECE = 1 << 19


def _piece_ends(data: np.ndarray, offsets: np.ndarray):
    """Ends of pieces of about PIECE bytes, each where a text ends or before white space."""
    at, n = 0, len(data)
    while at < n:
        end = at + PIECE
        if end < n:
            most = int(offsets[np.searchsorted(offsets, end)])
            while end < most:
                blank = np.flatnonzero(~IS_WORD[data[end : min(most, end + PIECE)]])
                if len(blank):
                    end += int(blank[0])
                    break
                end = min(most, end + PIECE)
        at = min(n, end)
        yield at


def hashed_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, offsets of each text's words); A-Z count as a-z if lower."""
    data, offsets = text_buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    found, places, at = [], [], 0
    for end in _piece_ends(data, offsets):
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, side="right")] - at
        h, starts = _hashed_piece(data[at:end], inside, lower)
        found.append(h)
        places.append(starts + at)
        at = end
    return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)


def _hashed_piece(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a piece in which texts start at offsets."""
    n = len(data)
    word = IS_WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # a factor of its own for every place in a word (multilinear): no power series, whose sums some words share
    first = np.zeros(n, np.int64)
    first[starts] = starts
    place = np.arange(n) - np.maximum.accumulate(first)
    factors = _factors(1 << max(12, int((ends - starts).max()).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(((LOWER if lower else AS_IS)[data].astype(np.uint64) + np.uint64(1)) * factors[np.minimum(place, len(factors) - 1)], out=sums[1:])
    h = sums[ends] - sums[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), starts


SHINGLE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: pa.Array, n: int, lower: bool = True) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; with fewer words, of the whole as one."""
    words, offsets = hashed_words(texts, lower)
    factors = np.array([SHINGLE[k % 8] + np.uint64(2 * (k // 8)) for k in range(n)], np.uint64)
    if len(words) >= n:
        rolled = words[: len(words) - n + 1] * factors[0]
        for k in range(1, n):
            rolled = rolled + words[k : len(words) - n + 1 + k] * factors[k]
        rolled = mix(rolled)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            few = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(few + np.array([b - a], np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def joined_spread(rows: DataFrame, small: DataFrame, key: str, n: int, shares: int = 1000) -> DataFrame:
    """rows left join small (one row a key) on key, where a key may hold very many of the n rows.

    At most ``shares`` keys can hold more than n / shares rows each; these are broadcast, so that their rows
    stay where they are. No other key can burden a task.
    """
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(1, n // shares)).select(key)
    hot = saved(hot, "hot")
    few = F.broadcast(small.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True)))
    names = [c for c in small.columns if c != key]
    marked = rows.join(few, key, "left")
    first = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").drop("_hot", *names).join(small, key, "left")
    return first.unionByName(rest)
