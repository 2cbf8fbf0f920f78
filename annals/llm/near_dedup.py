"""Near-duplicate detection by b-bit MinHash.

A text's set of word shingles is reduced to minima under many hash functions. Groups of minima
(bands) give the candidates; of each minimum the low bits are packed into a short signature, whose
equal positions, counted by bit operations and corrected for chance collisions, estimate the
similarity. Candidates whose estimate is more than ``SIGMAS`` standard deviations below the
threshold are dropped, all others are confirmed on their full shingle sets.

Sizes. Equal sets are folded into one node first (a partial minimum, whatever the number
of copies). A bucket of a band is first linked through its smallest member: n - 1 candidates, of which those
that the estimate rules out are dropped. A hub's members are confirmed in chunks of ``CHUNK``, to each of which the
hub's set goes once. Only where a bucket still holds texts of several components after that, its members are
compared block by block (packed signatures only, ``BLOCK`` members a side). Pairs of different
components that pass the estimate are listed by the text of the smaller component, one row for each
block of ``HOME`` shingles that its candidates lie in, and confirmed there, so that no set is sent once a
pair. No bucket is capped and no pair dropped: every pair that shares a bucket is linked, ruled out by the estimate, compared on
full sets or known to be in one component. Rows that meet by a key that many share (copies of one set, members of
one hub) are joined by ``common.joined_spread``.
At the threshold a pair shares no band with probability (1 - s**ROWS)**BANDS (4e-7 at 0.85, 3e-5 at 0.8).

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text with fewer words
than a shingle is one shingle; every row is a document of its own, whatever its id: rows with a repeated id or none are
compared like others. ``link`` gives each row its group's smallest id (null if none of the group has an id).
``deduplicated`` keeps one row of each group: the smallest id, then the smallest digest of the text, rows without
id last, of wholly equal rows any one; rows without shingles all stay. An empty table gives an empty result; other columns are not read by ``link``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annals.llm.common import BLANKS, batches_of, joined_spread, mix, saved, shingle_sets
from annals.llm.components import components

BANDS, ROWS, BITS = 20, 4, 4
HASHES = BANDS * ROWS
SIGMAS = 5.5
BLOCK = 1024
#: Shingles in a family block, and candidates compared with one copy of it (or of a hub's set).
HOME, CHUNK = 1 << 18, 2048

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a non-empty set; long sets go in slices."""
    best = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        np.minimum(best, (_A[:, None] * shingles[None, at : at + 4096] + _B[:, None]).min(axis=1), out=best)
    return best


def pack(least: np.ndarray) -> bytes:
    """The low BITS bits of each (mixed) minimum, packed."""
    low = (mix(least) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return np.packbits(((low[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1).astype(np.uint8)).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ row)
    return key


def equal_positions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a: (n, bytes), b: (m, bytes) of packed signatures -> (n, m) numbers of equal positions.

    BITS = 4: the XOR of two bytes holds two positions; one is equal if its half is zero.
    """
    halves = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += halves[a[:, k][:, None] ^ b[:, k][None, :]]
    return out


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from equal positions, corrected for the chance 2**-BITS of an equal value."""
    chance = 2.0**-BITS
    return (np.asarray(equal, float) / HASHES - chance) / (1 - chance)


def differing_positions(a: str, b: str):
    """The number of unequal positions of two signature columns (array<long>), by bit counts.

    BITS = 4: the four bits of a position of the XOR are folded into its lowest, and those are counted.
    """
    total = F.lit(0)
    for k in range(HASHES * BITS // 64):
        x = F.expr(f"{a}[{k}] ^ {b}[{k}]")
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total + F.bit_count(folded.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def least_equal(threshold: float) -> int:
    """Equal positions below which a pair is dropped: SIGMAS deviations under what the threshold expects."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return max(0, int(HASHES * p - SIGMAS * (HASHES * p * (1 - p)) ** 0.5))


SIGNATURE = "doc_id long, tag string, n_shingles long, set_key string, bands array<long>, sig array<long>"


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text) of docs; the tag is a digest of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tag"), "text")


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, tag, n_shingles, set_key, bands, sig); the last three are null for a text without words."""

    def run(it):
        for big in it:
            for batch in batches_of(big, 1024):
                sets = shingle_sets(batch.column("text"), n)
                least = [minima(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("tag"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.md5(s.tobytes()).hexdigest() if len(s) else None for s in sets], pa.string()),
                        pa.array([None if x is None else band_keys(x).astype(np.int64) for x in least], pa.list_(pa.int64())),
                        pa.array([None if x is None else np.frombuffer(pack(x), np.int64) for x in least], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "tag", "n_shingles", "set_key", "bands", "sig"],
                )

    return tagged(docs).mapInArrow(run, SIGNATURE)


def full_sets(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles array<long>) of whole texts."""

    def run(it):
        for big in it:
            for batch in batches_of(big, 512):
                sets = shingle_sets(batch.column("text"), n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _likely(pairs: DataFrame, chief: DataFrame, percent: int, n: int) -> DataFrame:
    """(a, b, chunk) of those pairs (a: hub, b: member) that sizes and estimate leave open."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).join(chief.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.col("sig").alias("sig_a")), "a")
    both = joined_spread(pairs, saved(hubs, "hubs"), "a", n).join(chief.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m"), F.col("sig").alias("sig_b")), "b")
    both = both.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).where(differing_positions("sig_a", "sig_b") <= HASHES - least_equal(percent / 100))
    return both.select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, chunk) with 100 * intersection >= percent * union, on full sets."""
    one = pairs.select("a", "chunk").distinct().join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    two = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = two.join(one, ["a", "chunk"]).select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("i"))
    return both.where(F.col("i") * (100 + percent) >= F.lit(percent) * (F.col("n") + F.col("m"))).select("a", "b")


def _candidates(percent: int):
    """Of two blocks of one bucket: for each text the ids of those of other components that pass size and estimate.

    A pair is reported in the first band it shares, by its text of the smaller component, as (doc_id, family block of the others, ids).
    """
    floor = least_equal(percent / 100)

    def run(table: pa.Table) -> pa.Table:
        ids, comp, size, many, home = (table.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "comp_size", "home"))
        side = table.column("side").to_numpy()
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sig = np.array(table.column("sig").to_pylist(), np.int64).view(np.uint8)
        band, same = table.column("band")[0].as_py(), table.column("left")[0].as_py() == table.column("right")[0].as_py()
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        lows, highs = [], []
        for at in range(0, len(one), 256):
            rows = one[at : at + 256]
            ok = comp[rows][:, None] != comp[two][None, :]
            if same:
                ok &= ids[rows][:, None] < ids[two][None, :]
            ok &= np.minimum(size[rows][:, None], size[two][None, :]) * 100 >= percent * np.maximum(size[rows][:, None], size[two][None, :])
            if ok.any():
                ok &= equal_positions(sig[rows], sig[two]) >= floor
            i, j = np.nonzero(ok)
            if band and len(i):
                fresh = ~(bands[rows[i]][:, :band] == bands[two[j]][:, :band]).any(axis=1)
                i, j = i[fresh], j[fresh]
            lows.append(rows[i])
            highs.append(two[j])
        a, b = np.concatenate([*lows, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*highs, np.zeros(0, np.int64)]).astype(np.int64)
        swap = (many[a] > many[b]) | ((many[a] == many[b]) & (ids[a] < ids[b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        order = np.lexsort((ids[b], home[b], ids[a]))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (ids[a][1:] != ids[a][:-1]) | (home[b][1:] != home[b][:-1])
        first = np.flatnonzero(new)
        offsets = np.append(first, len(a)).astype(np.int32)
        return pa.table({"a": pa.array(ids[a][first], pa.int64()), "home": pa.array(home[b][first], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[b], pa.int64()))})

    return run


def _joined(percent: int):
    """Links between components among a family block's members (left) and their candidates (right), on full sets.

    Only links that join two components not yet joined here are given, and pairs already joined aren't compared.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = dict(zip(left.column("doc_id").to_pylist(), (np.array(x.values).view(np.uint64) for x in left.column("shingles").combine_chunks()))) if left.num_rows else {}
        comp = dict(zip(left.column("doc_id").to_pylist(), left.column("component").to_pylist()))
        top: dict[int, int] = {}

        def find(x):
            while top.get(x, x) != x:
                top[x] = x = top.get(top[x], top[x])
            return x

        found_a, found_b = [], []
        for a, c, mine, others in zip(right.column("a").to_pylist(), right.column("own").to_pylist(), right.column("mine").combine_chunks() if right.num_rows else [], right.column("ids").to_pylist()):
            mine = np.array(mine.values).view(np.uint64)  # in which order sets are sorted
            for at in range(0, len(others), 256):
                rest = [b for b in others[at : at + 256] if find(comp[b]) != find(c)]
                if not rest:
                    continue
                flat = np.concatenate([sets[b] for b in rest])
                sizes = np.array([len(sets[b]) for b in rest])
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                for b, i, n in zip(rest, both.tolist(), sizes.tolist()):
                    if i * (100 + percent) >= percent * (n + len(mine)) and find(comp[b]) != find(c):
                        top[find(comp[b])] = find(c)
                        found_a.append(a)
                        found_b.append(b)
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return run


def _rest(members: DataFrame, label: DataFrame, chief: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between texts of different components of label that share a bucket."""
    tagged = members.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_buckets = tagged.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "key")
    rest = saved(tagged.join(open_buckets, ["band", "key"], "left_semi").select("band", "key", "doc_id", "hub", "component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open")
    # each text once, with its component's size and its block in its family (the texts of one smallest hub)
    texts = rest.groupBy("doc_id").agg(F.min("hub").alias("family"), F.min("component").alias("component")).join(chief, "doc_id")
    family = texts.groupBy("family").agg(F.ceil(F.sum("n_shingles") / HOME).alias("homes"))
    texts = texts.join(family, "family").join(texts.groupBy("component").agg(F.count("*").alias("comp_size")), "component")
    texts = saved(texts.withColumn("home", F.xxhash64("family", F.pmod(F.xxhash64("doc_id"), F.col("homes")))).drop("family", "homes"), "families")
    rest = rest.drop("hub", "component").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # a member of block k goes to the pairs (k, j) and (j, k); side 2: both blocks are one
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rest = rest.select("band", "key", "doc_id", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), F.expr("case when block = other then 2 when block < other then 0 else 1 end").alias("side"))
    rest = rest.join(texts, "doc_id").select("band", "key", "left", "right", "side", "doc_id", "component", "comp_size", "home", "n_shingles", "bands", "sig")
    found = rest.groupBy("band", "key", "left", "right").applyInArrow(_candidates(percent), "a long, home long, ids array<long>")
    found = saved(found.groupBy("a", "home").agg(F.flatten(F.collect_list("ids")).alias("ids")), "candidates")
    chunks = found.groupBy("home").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    whole = sets.join(texts.select("doc_id", "component", "home"), "doc_id")
    left = whole.join(chunks, "home").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).select("home", "chunk", "doc_id", "component", "shingles")
    right = found.join(chunks, "home").withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks"))).join(whole.select(F.col("doc_id").alias("a"), F.col("component").alias("own"), F.col("shingles").alias("mine")), "a").select(F.col("home").alias("home2"), F.col("chunk").alias("chunk2"), "a", "own", "mine", "ids")
    return left.groupBy("home", "chunk").cogroup(right.groupBy("home2", "chunk2")).applyInArrow(_joined(percent), "a long, b long")


def _linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(signatures' rows, nodes (set_key, least, comp), number of rows).

    A node is a distinct shingle set; least: (without id, id, tag) of its first row; comp: a number of its group.
    """
    sigs = saved(signatures(docs, words), "signatures")
    rows = sigs.count()
    least = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag", "n_shingles", "bands", "sig")
    nodes = sigs.where("set_key is not null").groupBy("set_key").agg(F.min(least).alias("s"))
    # numbers made up as the table is written; from then on they are fixed
    nodes = saved(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", F.struct("s.nameless", "s.doc_id", "s.tag").alias("least"), "s.n_shingles", "s.bands", "s.sig"), "nodes")
    chief = nodes.select(F.col("node").alias("doc_id"), "n_shingles", "bands", "sig")
    spread = chief.select("doc_id", F.posexplode("bands").alias("band", "key"))
    hubs = spread.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = saved(spread.join(hubs, ["band", "key"]).select("band", "key", "doc_id", "hub", "n"), "buckets")
    wanted = members.select(F.col("doc_id").alias("node")).distinct().join(nodes.select("node", F.col("least.doc_id").alias("_d"), F.col("least.tag").alias("_t")), "node")
    wanted = saved(wanted, "wanted")
    texts = tagged(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t"))).select(F.col("node").alias("doc_id"), "text")
    sets = saved(full_sets(texts, words), "sets")
    if sets.count() != wanted.count():  # wholly equal rows
        sets = saved(sets.dropDuplicates(["doc_id"]), "sets")
    pairs = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = saved(_confirmed(saved(_likely(saved(pairs, "pairs"), chief, percent, rows), "likely"), sets, percent), "links")
    label = components(found)
    more = saved(_rest(members, label, chief, sets, percent), "links")
    final = components(found.unionByName(more)) if not more.isEmpty() else label
    named = nodes.select("set_key", "node", "least").join(final.select("node", "component"), "node", "left").select("set_key", "least", F.coalesce("component", "node").alias("comp"))
    return sigs.select("doc_id", "n_shingles", "set_key"), saved(named, "named"), rows


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; see the module for the method.

    component_id: the smallest id reachable over links with 100 * intersection >= percent * union.
    """
    rows, named, n = _linked(docs, words, percent)
    first = named.groupBy("comp").agg(F.min("least.doc_id").alias("component_id"))
    of_set = joined_spread(named.select("set_key", "comp"), first, "comp", n).select("set_key", "component_id")
    out = joined_spread(rows, of_set, "set_key", n)
    out = out.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one of each group stays, columns as before; see the module for which."""
    _, named, _ = _linked(docs, words, percent)
    first = saved(named.groupBy("comp").agg(F.min("least").alias("l")).select(F.col("l.doc_id").alias("_d"), F.col("l.tag").alias("_t")), "first")
    blank = F.expr(f"btrim(coalesce(text, ''), {BLANKS}) = ''")
    texts = docs.where(~blank).withColumn("_tag", F.md5(F.col("text").cast("binary")))
    stay = texts.join(first, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_tag") == F.col("_t")), "left_semi")
    again = texts.groupBy("doc_id", "_tag").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():  # rows of one id and text: the one with the smallest digest of its other columns
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        stay = stay.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_tag").orderBy(F.xxhash64(*others) if others else F.lit(0)))).where("_n = 1")
    return stay.select(docs.columns).unionByName(docs.where(blank))
