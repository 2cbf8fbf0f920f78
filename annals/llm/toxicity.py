"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other, each by a logistic model over the words a text has (letters only,
lower case) and the log-odds of the categories before it. For training these log-odds are out-of-fold:
each comes from models that did not see the row. The last category decides; its threshold is
the one with the best F1 on out-of-fold predictions.

Bounds: models are fitted on at most LABELLED labelled ids of the documents given (those of smallest hash, found by a histogram of
hashes, so that no task sorts them all) and WORDS words a category (by
the z-score of their document counts, LEAST_Z at least, in at least LEAST documents); these two are the only things the driver
holds. Word counts over the labelled rows are made by a partial aggregation. Every document is scored in
full, in one pass without a shuffle.

Defined cases: null and empty texts have no words and get the base rate; null ids are scored too; repeated ids
are scored row by row (one of their texts, the one whose sorted words come first, is fitted on); texts of any length are reduced to their distinct words; rows with a null label are not used for that category; without any labelled row,
or with one class only, the category's probability is its base rate (0 without rows) and nothing is rejected; an empty table
gives an empty result; other columns are kept by ``accepted``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annals.llm.common import batches_of, saved

LABELLED, WORDS, LEAST, LEAST_Z, FOLDS, STEPS, RIDGE = 10_000, 1024, 5, 4.0, 5, 60, 1.0

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Chain:
    """words: index by word; weights: for each category (bias, words' weights, earlier categories' weights)."""

    names: list[str]
    words: dict[str, int]
    weights: list[tuple[float, np.ndarray, np.ndarray]]
    threshold: float

    def log_odds(self, ids: list[np.ndarray]) -> np.ndarray:
        """(texts, categories) for the word indices of each text."""
        flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        out = np.zeros((len(ids), len(self.names)))
        for c, (bias, w, earlier) in enumerate(self.weights):
            out[:, c] = bias + np.bincount(row, weights=w[flat], minlength=len(ids)) + out[:, :c] @ earlier
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit(flat, row, n, extra, y, use, size):
    """Ridge logistic regression on the rows in use by Adam on the full gradient; (bias, weights, weights of extra)."""
    some = use.sum()
    rate = np.clip(y[use].mean() if some else 0.0, 1e-4, 1 - 1e-4)
    bias = np.log(rate / (1 - rate))
    if not some or y[use].min() == y[use].max():
        return (bias if some else -40.0), np.zeros(size), np.zeros(extra.shape[1])
    theta = np.concatenate([[bias], np.zeros(size + extra.shape[1])])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pick = use[row]
    flat, row = flat[pick], row[pick]
    for t in range(1, STEPS + 1):
        z = theta[0] + np.bincount(row, weights=theta[1 : 1 + size][flat], minlength=n) + extra @ theta[1 + size :]
        err = np.where(use, _sigmoid(z) - y, 0.0)
        grad = np.concatenate([[err.sum()], np.bincount(flat, weights=err[row], minlength=size), extra.T @ err])
        grad[1:] += RIDGE * theta[1:]
        grad /= some
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[0], theta[1 : 1 + size], theta[1 + size :]


def train(names: list[str], words: list[str], ids: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> Chain:
    """labels: (rows, categories) of 0, 1 or nan; fold: a fold number a row."""
    n, size = len(ids), len(words)
    flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in ids])
    held = np.zeros((n, 0))
    weights = []
    for c in range(len(names)):
        known = ~np.isnan(labels[:, c])
        y = np.nan_to_num(labels[:, c])
        out = np.zeros(n)
        for k in range(FOLDS):
            b, w, e = _fit(flat, row, n, held, y, known & (fold != k), size)
            z = b + np.bincount(row, weights=w[flat], minlength=n) + held @ e
            out[fold == k] = z[fold == k]
        weights.append(_fit(flat, row, n, held, y, known, size))
        held = np.hstack([held, np.clip(out, -8, 8)[:, None]])
    known = ~np.isnan(labels[:, -1])
    z, y = held[known, -1], labels[known, -1]
    threshold = float("inf")
    if len(y) and 0 < y.sum() < len(y):
        order = np.argsort(-z, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        last = np.append(z[order][1:] != z[order][:-1], True)  # between equal scores is no threshold
        best = int(np.argmax(np.where(last, f1, -1)))
        below = z[order][best + 1] if best + 1 < len(y) else z[order][best] - 1
        threshold = float((z[order][best] + below) / 2)
    return Chain(names, {w: i for i, w in enumerate(words)}, weights, threshold)


def _smallest(marked: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those of smallest id hash; whole bins of hashes, and a sorted part of one more."""
    total = marked.count()
    if total <= most:
        return marked
    number = F.shiftright(F.xxhash64("doc_id"), 48)
    bins = sorted((r.bin, r.n) for r in marked.groupBy(number.alias("bin")).agg(F.count("*").alias("n")).collect())  # 2**16 rows at most
    held = 0
    for bound, n in bins:
        if held + n > most:
            break
        held += n
    last = marked.where(number == bound).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most - held)
    return saved(marked.where(number < bound).unionByName(last), "labels")


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str]) -> Chain:
    """A chain for categories: name -> SQL for a 0/1 label over labels (doc_id, ...), in order."""
    names = list(categories)
    marked = labels.where("doc_id is not null").select("doc_id", *[F.expr(s).cast("double").alias(n) for n, s in categories.items()])
    marked = marked.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    marked = _smallest(saved(marked.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels"), LABELLED)
    rows = docs.select("doc_id", "text").join(marked, "doc_id")

    def split(it):
        for big in it:
            for batch in batches_of(big, 512):
                found = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *names)], pa.array(found, pa.list_(pa.string()))], names=["doc_id", *names, "words"])

    schema = ", ".join(["doc_id long", *[f"{n} double" for n in names], "words array<string>"])
    rows = rows.select(F.col("doc_id").cast("long"), "text", *names).mapInArrow(split, schema)
    # of repeated ids one text, so that there are LABELLED rows at most
    rows = saved(rows.groupBy("doc_id").agg(F.min(F.struct(*names, "words")).alias("s")).select("doc_id", "s.*"), "labelled")
    total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names]).first()
    counts = rows.select(*names, F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names]).where(F.col("n") >= LEAST)
    counts = saved(counts, "words")
    words: list[str] = []
    for name in names:
        rate = total[name] / max(1, total["n"])
        z = F.abs(F.col(name) - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate) + 1e-9))
        words += [r.word for r in counts.where(z >= LEAST_Z).orderBy(F.desc(z), "word").limit(WORDS).select("word").collect()]
    words = sorted(set(words))
    index = {w: i for i, w in enumerate(words)}

    def number(it):
        for batch in it:
            ids = [np.array(sorted(index[w] for w in x if w in index), np.int32) for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *names)], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", *names, "ids"])

    # at most LABELLED rows of at most WORDS * categories numbers
    got = rows.mapInArrow(number, schema.replace("words array<string>", "ids array<int>")).orderBy("doc_id").toPandas()
    fold = (got["doc_id"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % FOLDS
    return train(names, words, [np.asarray(x, np.int64) for x in got["ids"]], got[names].to_numpy(float).reshape(len(got), len(names)), fold)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category>.., toxic, kept) of every row; toxic: the last category's log-odds reach the threshold."""
    names = [f"p_{n}" for n in chain.names]

    def run(it):
        known = chain.words
        keys = known.keys()
        for big in it:
            for batch in batches_of(big, 512):
                ids = [np.array(sorted(known[w] for w in words_of(t) & keys), np.int64) for t in batch.column("text").to_pylist()]
                z = chain.log_odds(ids)
                bad = z[:, -1] >= chain.threshold
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(p) for p in _sigmoid(z).T], pa.array(bad), pa.array(~bad)], names=["doc_id", *names, "toxic", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *[f"{n} double" for n in names], "toxic boolean", "kept boolean"]))


def accepted(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs that are not toxic, columns as before."""

    def run(it):
        known = chain.words
        keys = known.keys()
        for big in it:
            for batch in batches_of(big, 512):
                ids = [np.array(sorted(known[w] for w in words_of(t) & keys), np.int64) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(chain.log_odds(ids)[:, -1] < chain.threshold))

    return docs.mapInArrow(run, docs.schema)


#: The labelled categories of the tables: unreadable text first, then toxic text.
CATEGORIES = {"junk": "1 - quality", "toxic": "toxic"}
