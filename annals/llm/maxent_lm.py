"""A hashed maximum-entropy language model with a class-factored softmax.

A token's class is coded by LEVELS digits of its hash, FAN values each, so that a class of the first digit is cut
into classes of the second and so on, down to FAN ** LEVELS (4,096) cells. A token's probability is the product of

* for each level, ``P(digit | context, digits before)``: a softmax over the weights of hashed features - each of the context's n-gram
  and skip features (previous word, the one before, and at the first level their bigram and the skip pair of first and third previous
  word) together with the digits before - and a bias of the digits before;
* within a cell: ``(c + 0.1) / (N_k + 0.1 * (V_k + 1))`` with the counts of the training documents, one
  more type standing for all unknown tokens. Few cells have more than one frequent word, which context then tells from those of all other cells.

Training: SLICES synchronous gradient updates, each over another slice of the training documents, so that
every training token is used once. Tasks sum observed and expected digit counts a bucket in whole
numbers, so that sums don't depend on order; a step divides their difference by the expected counts.

Scale: counts are summed by 64-bit word hash after a partial sum in each task. The rows of weights grow with the
number of distinct training words, up to 2 ** MOST_BITS rows, as the driver holds and broadcasts them; beyond that features share
rows. The driver also holds the cells' totals and the counts of at most HEAD frequent words, of fixed size. Gradients are summed by
bucket, row by row, in Spark's own aggregation. The counts of other words - their number grows with the corpus - are joined: texts are
read in blocks of at most BLOCK_WORDS tokens, each block's distinct rare words meet their counts by hash and
come back to the block. Words are never sent one row a token.

Defined cases: null and empty texts are their end token; null ids count as training documents; repeated ids
are separate texts; an empty table gives an empty result; without training tokens every count is 0; one text longer than
a block is a block of its own; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.llm.common import batches_of, hashed_words, saved

LEVELS, FAN, SLICES, HEAD, BLOCK_WORDS = 3, 16, 4, 100_000, 1 << 20
CELLS = FAN**LEVELS
LEAST_BITS, MOST_BITS = 12, 16
ADD = 0.1
END = np.uint64(0x5BD1E9955BD1E995)
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Tokens whose logits are made at once, and tokens summed by bucket at once.
CHUNK, SUMMED = 1 << 13, 1 << 16
_FEATURES, _FIXED = 4, 1 << 8
#: The features of the first level and of those below.
USED = ((0, 1, 2, 3), (0, 1))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of each text and its end, offsets of the texts)."""
    words, offsets = hashed_words(texts, lower=True)
    n = len(offsets) - 1
    out = np.empty(len(words) + n, np.uint64)
    moved = offsets + np.arange(n + 1)
    ends = moved[1:] - 1
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = words
    return out, moved


def cell_of(tokens: np.ndarray) -> np.ndarray:
    """The cell of each token: its digits, the first one highest."""
    return (tokens >> np.uint64(7)).astype(np.int64) % CELLS


def _prefixes(cells: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the digits before this level, counted over all levels, the level's digit) of cells."""
    before = cells // FAN ** (LEVELS - level)
    return before + (FAN**level - 1) // (FAN - 1), cells // FAN ** (LEVELS - level - 1) % FAN


def contexts(tokens: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """_FEATURES hashes of the contexts of tokens lo to hi; nothing before a text's start."""
    index = np.arange(lo, hi)
    first, last = np.searchsorted(offsets, [lo, hi - 1], side="right")
    inside = offsets[first:last]
    at = index - np.repeat(offsets[first - 1 : last], np.diff(np.concatenate([[lo], inside, [hi]])))
    one, two, three = (np.where(at < k, np.uint64(k), tokens[np.maximum(index - k, 0)]) for k in (1, 2, 3))
    hashed = (one * _K[0], two * _K[1] + np.uint64(1), one * _K[2] + two * _K[3], one * _K[4] + three * _K[5])
    return [h ^ (h >> np.uint64(29)) for h in hashed]


def buckets(context: np.ndarray, before: np.ndarray, bits: int) -> np.ndarray:
    """The rows of weights of a feature together with the digits before."""
    h = (context + before.astype(np.uint64) * _K[5]) * _K[0]
    return ((h ^ (h >> np.uint64(31))) * _K[1] >> np.uint64(64 - bits)).astype(np.uint16)


def _powers(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
    """exp of the digits' logits; they are bounded by SLICES * _FEATURES and the bias, so nothing overflows."""
    z = np.take(bias, before, axis=0)
    for r in rows:
        z += np.take(weights, r, axis=0)
    return np.exp(z, out=z)


def log_probabilities(weights: np.ndarray, bias: np.ndarray, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ln P(cell of the token | context) of every token."""
    bits = len(weights).bit_length() - 1
    cells = cell_of(tokens)
    out = np.zeros(len(tokens), np.float64)
    for at in range(0, len(tokens), CHUNK):
        end = min(len(tokens), at + CHUNK)
        found, number = contexts(tokens, offsets, at, end), np.arange(end - at)
        for level in range(LEVELS):
            before, digit = _prefixes(cells[at:end], level)
            power = _powers(weights, bias, [buckets(found[k], before, bits) for k in USED[level > 0]], before)
            out[at:end] += np.log(power[number, digit] / power.sum(axis=1))
    return out


def gradient(weights, bias, tokens, offsets, observed: np.ndarray, expected: np.ndarray) -> None:
    """Adds the digits' counts by bucket to observed (rows, FAN; integers) and what the model expects to expected."""
    bits = len(weights).bit_length() - 1
    cells, count, sums = cell_of(tokens), observed.reshape(-1), expected.reshape(-1)
    # reused, as fresh memory costs more than the sums
    p, places = np.empty((min(len(tokens), SUMMED), FAN)), np.empty((min(len(tokens), SUMMED), FAN), np.int64)
    for at in range(0, len(tokens), SUMMED):
        end = min(len(tokens), at + SUMMED)
        found, n = contexts(tokens, offsets, at, end), end - at
        for level in range(LEVELS):
            before, digit = _prefixes(cells[at:end], level)
            rows = [buckets(found[k], before, bits) for k in USED[level > 0]]
            for s in range(0, n, CHUNK):
                power = _powers(weights, bias, [r[s : s + CHUNK] for r in rows], before[s : s + CHUNK])
                np.divide(power, power.sum(axis=1, keepdims=True), out=p[s : min(n, s + CHUNK)])
            for r in rows:
                first = r.astype(np.int64) * FAN
                np.add.at(count, first + digit, 1)
                np.add(first[:, None], np.arange(FAN), out=places[:n])
                np.add.at(sums, places[:n].reshape(-1), p[:n].reshape(-1))


def _train_condition():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token hash is in the documents."""

    def run(it):
        held, n = [], 0

        for big in it:
            for batch in batches_of(big, 2048):
                if batch.num_rows:
                    tokens, _ = tokens_of(batch.column("text"))
                    words, counts = np.unique(tokens, return_counts=True)
                    held.append((words, counts))
                    n += len(words)
                    if n > BLOCK_WORDS:
                        merged = _merged(held)
                        held, n = [merged], len(merged[0])
                        if n > BLOCK_WORDS // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(merged[0].view(np.int64)), pa.array(merged[1].astype(np.int64))], names=["h", "c"])
                            held, n = [], 0
        if held:
            words, counts = _merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _merged(held):
    words = np.concatenate([h for h, _ in held])
    counts = np.concatenate([c for _, c in held])
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    return words[first], np.add.reduceat(counts, first)


_SUMS = [f"{k}{i}" for k in "oe" for i in range(FAN)]


def _update(docs: DataFrame, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The weights after one step by the sums over docs."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(it):
        w, b = shared.value
        observed, expected = np.zeros(w.shape, np.int64), np.zeros(w.shape, np.float64)
        for big in it:
            for batch in batches_of(big, 512):
                if batch.num_rows:
                    gradient(w, b, *tokens_of(batch.column("text")), observed, expected)
        some = np.flatnonzero(observed.any(axis=1))
        fixed = np.rint(expected[some] * _FIXED).astype(np.int64)
        for at in range(0, len(some), 8192):
            part = slice(at, at + 8192)
            yield pa.RecordBatch.from_arrays([pa.array(some[part].astype(np.int32)), *[pa.array(np.ascontiguousarray(x[some][part, i] if x is observed else x[part, i])) for x in (observed, fixed) for i in range(FAN)]], names=["bucket", *_SUMS])

    rows = docs.select("text").mapInArrow(run, ", ".join(["bucket int", *[f"{c} long" for c in _SUMS]]))
    sums = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in _SUMS])
    step = lambda i: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col(f"o{i}") - F.col(f"e{i}") / _FIXED) / (_FEATURES / 2 * (F.col(f"e{i}") / _FIXED + 2)))).cast("float")
    moved = sums.select("bucket", *[step(i).alias(f"w{i}") for i in range(FAN)]).toArrow()  # a row for a row of weights at most
    shared.unpersist()
    weights = weights.copy()
    if moved.num_rows:
        weights[moved.column("bucket").to_numpy()] += np.stack([moved.column(f"w{i}").to_numpy() for i in range(FAN)], axis=1)
    return weights


def biases(size: np.ndarray) -> np.ndarray:
    """ln of each digit's share given the digits before, for all levels; size: tokens of each cell."""
    out = []
    for level in range(LEVELS):
        n = size.reshape(FAN ** (level + 1), -1).sum(axis=1).reshape(-1, FAN)
        out.append(np.log((n + 1) / (n.sum(axis=1, keepdims=True) + FAN)))
    return np.concatenate(out).astype(np.float32)


def fit(docs: DataFrame, bias: np.ndarray, bits: int) -> np.ndarray:
    """The weights after SLICES updates over the training documents."""
    weights = np.zeros((1 << bits, FAN), np.float32)
    for k in range(SLICES):
        weights = _update(docs.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(SLICES)) == k), weights, bias)
    return weights


def _head(counts: DataFrame) -> DataFrame:
    """At most HEAD rows of the largest counts: those above a bound read from a histogram of a few hundred bins.

    A sorted limit would have every partition send HEAD rows to the driver.
    """
    size = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(((r.bin, r.n) for r in counts.groupBy(size.alias("bin")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for number, n in bins:
        if held + n > HEAD:
            break
        least, held = number, held + n
    return counts.limit(0) if least is None else counts.where(size >= least)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, trained on those not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = docs.where(_train_condition())
    counts = saved(word_counts(train), "counts")
    cell = F.pmod(F.shiftrightunsigned("h", 7), F.lit(CELLS)).cast("int")
    per = counts.groupBy(cell.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()  # CELLS rows at most
    size, types = np.zeros(CELLS), np.zeros(CELLS)
    size[per.column("k").to_numpy()], types[per.column("k").to_numpy()] = per.column("n").to_numpy(), per.column("v").to_numpy()
    total, distinct = int(size.sum()), int(types.sum())
    bias = biases(size)
    weights = fit(train, bias, min(MOST_BITS, max(LEAST_BITS, distinct.bit_length())))
    head = _head(counts).toPandas()
    order = np.argsort(head["h"].to_numpy().view(np.uint64))
    head_h, head_c = head["h"].to_numpy().view(np.uint64)[order], head["c"].to_numpy()[order]
    in_cell = np.log10(size + ADD * (types + 1))
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias, head_h, head_c, in_cell))

    def run(it):
        from pyspark import TaskContext

        w, bias, hh, hc, inner = shared.value
        number = TaskContext.get().partitionId() << 32
        texts, ids, held, words = [], [], [], 0

        def out():
            nonlocal number, texts, ids, held, words
            column = pa.concat_arrays(texts)
            tokens, offsets = tokens_of(column)
            n = np.diff(offsets)
            per_token = log_probabilities(w, bias, tokens, offsets) / np.log(10) - inner[cell_of(tokens)]
            where = np.minimum(np.searchsorted(hh, tokens), max(0, len(hh) - 1))
            known = hh[where] == tokens if len(hh) else np.zeros(len(tokens), bool)
            log_c = np.zeros(len(tokens))
            log_c[known] = np.log10(hc[where[known]] + ADD)
            rare, back = np.unique(tokens[~known], return_inverse=True)
            cut = np.searchsorted(np.flatnonzero(~known), offsets)
            back = back.astype(np.int32)
            starts = offsets[:-1]
            number += 1
            m = len(column)
            none = lambda k, t: pa.nulls(k, t)
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m, number)), pa.concat_arrays(ids), pa.concat_arrays(held), pa.array(n.astype(np.int64)),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(log_c, starts)), pa.array(np.add.reduceat(per_token, starts)),
                    pa.array([back[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), none(m, pa.int64()), none(m, pa.int32()),
                ],
                names=_BLOCK_NAMES,
            )
            r = len(rare)
            more = pa.RecordBatch.from_arrays(
                [pa.array(np.full(r, number)), none(r, pa.int64()), none(r, pa.bool_()), none(r, pa.int64()), none(r, pa.int64()), none(r, pa.float64()), none(r, pa.float64()), none(r, pa.binary()), pa.array(rare.view(np.int64)), pa.array(np.arange(r, dtype=np.int32))],
                names=_BLOCK_NAMES,
            )
            texts, ids, held, words = [], [], [], 0
            return rows, more

        for big in it:
            for batch in batches_of(big, 64):
                if not batch.num_rows:
                    continue
                texts.append(batch.column("text"))
                ids.append(batch.column("doc_id"))
                held.append(batch.column("held_out"))
                words += batch.column("text").nbytes // 6
                if words > BLOCK_WORDS:
                    yield from out()
        if texts:
            yield from out()

    marked = docs.select("doc_id", "text", (~_train_condition()).alias("held_out"))
    blocks = saved(marked.mapInArrow(run, _BLOCK_SCHEMA), "blocks")
    texts = blocks.where("h is null").select("block", "doc_id", "held_out", "n", "known", "log_c", "per", "rare")
    rare = blocks.where("h is not null").select(F.col("block").alias("b"), "h", "pos").join(counts, "h", "left").select("b", "pos", F.coalesce("c", F.lit(0)).alias("c"))
    floor = np.log10(total + ADD * (distinct + 1))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        c = np.zeros(right.num_rows, np.int64)
        c[right.column("pos").to_numpy()] = right.column("c").to_numpy()
        log_c = np.log10(c + ADD)
        n, known, log_sum, per_sum = (left.column(k).to_numpy() for k in ("n", "known", "log_c", "per"))
        more_known, more = np.zeros(len(n), np.int64), np.zeros(len(n))
        for i, x in enumerate(left.column("rare").to_pylist()):
            at = np.frombuffer(x, np.int32)
            more_known[i], more[i] = np.count_nonzero(c[at]), log_c[at].sum()
        sums = log_sum + more
        return pa.table(
            {
                "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n), "n_known": pa.array(known + more_known),
                "train_tokens": pa.array(np.full(len(n), total)), "base_score": pa.array(sums - n * floor), "score": pa.array(sums + per_sum),
            }
        )

    return texts.groupBy("block").cogroup(rare.groupBy("b")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_BLOCK_SCHEMA = "block long, doc_id long, held_out boolean, n long, known long, log_c double, per double, rare binary, h long, pos int"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK_SCHEMA.split(", ")]
