"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for; and decoding.

Normalisation is our own: at each position the longest key of the model's compiled character map (a
double-array trie) is replaced, and for every byte made, the original byte it came from is recorded. White
space becomes U+2581, with one in front of the text if the model says so. Segmentation of normalised text is
the library's, through a copy of the model whose own normaliser is switched off; a piece's
normalised bytes are then projected through the record to [begin, end) in the original's UTF-8.

Every text goes this way: it is normalised, the normalised text is segmented, pieces are projected through the record. A map
without keys leaves only the white space to do, for which the record is made by array operations.

Speed: if no piece of the model has U+2581 behind another character (checked when it is loaded), segmentation can't
cross a single U+2581 of the normalised text, nor a line feed if no piece has one beside other characters, so the ids of a
word are remembered (at most MEMO words of up to MEMO_CHARS characters a worker) and only new words are segmented.
Normalised texts with U+2581 beside another are segmented whole.

Defined cases: null and empty texts give no piece but the end id; repeated rows and ids are encoded
row by row; an empty table gives an empty result; extra columns are kept by ``encode``; ids of
one text may be arbitrarily many.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from annals.llm.common import batches_of

MEMO = 300_000
MEMO_CHARS = 48
BLANK = "▁"



def _fields(data: bytes):
    """(number, value) of a serialised message."""
    i = 0

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            x = data[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[i : i + size]
        i += size


class CharacterMap:
    """A compiled character map: u32 trie bytes, the trie's units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        if not blob:
            self.units, self.texts = np.zeros(0, np.uint32), b""
            return
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4)
        self.texts = blob[4 + size :]
        self._list = self.units.tolist()

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """(bytes of the longest key at this position, its replacement), or (0, None)."""
        if not len(self.units):
            return 0, None
        units, best, value = self._list, 0, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best, value = k + 1 - at, units[node] & 0x7FFFFFFF
        if not best:
            return 0, None
        return best, self.texts[value : self.texts.index(b"\0", value)]


class Normalizer:
    """Longest-prefix replacement with source alignment."""

    def __init__(self, spec: bytes):
        got = dict(_fields(spec))
        self.map = CharacterMap(got.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))

    def _next(self, data: bytes, at: int) -> tuple[int, bytes]:
        used, to = self.map.longest(data, at)
        if used:
            return used, to
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, data[at : at + n]

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, for each of its UTF-8 bytes and for its end the original byte's position)."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not len(self.map.units) and not self.squeeze:
            return self._blanks_only(text)
        data = text.encode("utf-8", "replace")
        at, n = 0, len(data)
        blank = BLANK.encode() if self.escape else b" "
        if self.squeeze:
            while at < n:
                used, to = self._next(data, at)
                if to.strip(b" "):
                    break
                at += used
        if at >= n:
            return "", np.zeros(1, np.int64)
        out, back = bytearray(), []
        if self.prefix:
            out += blank
            back += [at] * len(blank)
        was_blank = self.squeeze
        while at < n:
            used, to = self._next(data, at)
            if self.squeeze and was_blank:
                to = to.lstrip(b" ")
            if to:
                made = to.replace(b" ", blank)
                out += made
                back += [at] * len(made)
                was_blank = self.squeeze and to.endswith(b" ")
            at += used
        end = n
        if self.squeeze:
            while out.endswith(blank):
                end = back[-len(blank)]
                del out[-len(blank) :], back[-len(blank) :]
        back.append(end)
        return out.decode("utf-8", "replace"), np.array(back, np.int64)

    def _blanks_only(self, text: str) -> tuple[str, np.ndarray]:
        """As normalize where no key of the map can match and blanks aren't squeezed."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        wide = len(BLANK.encode()) if self.escape else 1
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        back = np.arange(len(data) + 1, dtype=kind)
        back = np.repeat(back, np.append(np.where(data == 32, np.int8(wide), np.int8(1)), np.int8(1))) if wide > 1 else back
        back = np.concatenate([np.zeros(wide if self.prefix else 0, kind), back])
        made = text.replace(" ", BLANK) if self.escape else text
        return ((BLANK if self.escape else " ") + made if self.prefix else made), back


class Codec:
    def __init__(self, model: str):
        import sentencepiece

        blob = open(model, "rb").read()
        spec = b"".join(v for f, v in _fields(blob) if f == 3)  # repeated messages merge
        self.normalizer = Normalizer(spec)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        # the same model again, with an identity normaliser: a later field of a message replaces an earlier one
        off = b"\x0a\x08identity\x12\x00\x18\x00\x20\x00\x28\x00"
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=blob + b"\x1a" + bytes([len(off)]) + off)
        self.end_id = self.library.eos_id()
        kinds, sizes = [], []
        across = lines = False
        for f, v in _fields(blob):
            if f == 1:
                p = dict(_fields(v))
                piece, kind = p.get(1, b"").decode(), p.get(3, 1)
                kinds.append(kind)
                sizes.append(1 if kind == 6 else len(piece.encode()))
                if kind == 1:
                    across |= BLANK in piece.lstrip(BLANK)
                    lines |= "\n" in piece and len(piece) > 1
        self.sizes = np.array(sizes, np.int64)
        self.has_unknown = 6 not in kinds
        self.by_line = not lines
        # texts are segmented whole if a piece can cross words, is user-defined, or stands for any run of unknown characters
        self.whole = across or 4 in kinds or self.has_unknown or not self.normalizer.escape or not self.normalizer.prefix
        self.memo: dict[str, bytes] = {}

    def _segmented(self, words: list[str]) -> list[bytes]:
        """The ids of each word, with U+2581 in front unless it starts with a line feed, as int32."""
        return [np.array(ids, np.int32).tobytes() for ids in self.raw.encode([w if w[:1] == "\n" else BLANK + w for w in words], num_threads=1)]

    def _words(self, made: str) -> list[str] | None:
        """The words of a normalised text, or None if it is to be segmented whole."""
        if self.whole or not made or BLANK + BLANK in made:
            return None
        if self.by_line and "\n" in made and BLANK + "\n" not in made:
            made = made.replace("\n", BLANK + "\n")
        elif BLANK + "\n" in made:
            return None
        words = made.split(BLANK)
        del words[0]  # in front of the first U+2581
        return words

    def _whole(self, made: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends of the pieces in normalised bytes)."""
        if self.has_unknown:  # an unknown piece may be of any length: ask for surfaces
            found = self.raw.encode(made, return_type="proto")
            return np.array([p.id for p in found.pieces], np.int32), np.cumsum([len(p.surface.encode()) for p in found.pieces], dtype=np.int64)
        ids = np.array(self.raw.encode(made, num_threads=1), np.int32)
        return ids, np.cumsum(self.sizes[ids]) if len(ids) else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of each text, without the end id."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        normal = [self.normalizer.normalize(t) for t in texts]
        split = [self._words(made) for made, _ in normal]
        new = [w for w in set().union(*[s for s in split if s]) if w not in memo]
        extra = {}
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for w, ids in zip(part, self._segmented(part)):
                (memo if len(w) <= MEMO_CHARS else extra)[w] = ids
        out = []
        for (made, back), words in zip(normal, split):
            if words is None:
                ids, ends = self._whole(made)
            else:
                found = map(memo.__getitem__, words) if not extra else [memo[w] if w in memo else extra[w] for w in words]
                ids = np.frombuffer(b"".join(found), np.int32)
                ends = np.cumsum(self.sizes[ids])
            places = back[np.concatenate([[0], ends])].astype(np.int32)
            out.append((ids, places[:-1], places[1:]))
        return out


@lru_cache(maxsize=4)
def codec(model: str) -> Codec:
    return Codec(model)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


ROWS = 128


def encode(docs: DataFrame, model: str, text: str = "text", end: bool = True) -> DataFrame:
    """docs with ids, begins and ends (array<int>) for its text column; the end id stands at the end of the text.

    The text column itself is left out; other columns stay (names ids, begins, ends, decoded are ours and replaced).
    """
    return _run(docs, model, text, end, False)


def roundtrip(docs: DataFrame, model: str, text: str = "text", end: bool = True) -> DataFrame:
    """As encode, with decoded: what the library makes of the ids."""
    return _run(docs, model, text, end, True)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with decoded (string) in place of the ids column; null ids give an empty text."""
    kept = [c for c in rows.columns if c not in (ids, "decoded")]

    def run(it):
        library = codec(model).library
        for big in it:
            for batch in batches_of(big, ROWS):
                made = library.decode([x or [] for x in batch.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(made, pa.string())], names=[*kept, "decoded"])

    schema = rows.select(*kept).schema.add("decoded", "string")
    return rows.select(*kept, ids).mapInArrow(run, schema)


def _run(docs: DataFrame, model: str, text: str, end: bool, back: bool) -> DataFrame:
    ours = ["ids", "begins", "ends"] + ["decoded"] * back
    kept = [c for c in docs.columns if c != text and c not in ours]

    def run(it):
        c = codec(model)
        for big in it:
            for batch in batches_of(big, ROWS):
                texts = [x or "" for x in batch.column(text).to_pylist()]
                found = c.encode(texts)
                if end:
                    tail = np.array([c.end_id], np.int32)
                    sizes = [int(e[-1]) if len(e) else 0 for _, _, e in found]
                    found = [(np.append(i, tail), np.append(b, np.int32(n)), np.append(e, np.int32(n))) for (i, b, e), n in zip(found, sizes)]
                columns = [_lists([f[k] for f in found]) for k in range(3)]
                if back:
                    columns.append(pa.array([c.library.decode(f[0].tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *columns], names=[*kept, *ours])

    schema = docs.select(*kept).schema
    for name in ours[:3]:
        schema = schema.add(name, ArrayType(IntegerType()))
    if back:
        schema = schema.add("decoded", "string")
    return docs.select(*kept, text).mapInArrow(run, schema)
