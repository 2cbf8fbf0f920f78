"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are whole numbers (``floor(scale * x)``). With M the largest squared norm, a data vector gets one more
coordinate ``sqrt(M - |x|^2)`` and a query a zero: the largest inner products are then the nearest
neighbours, as ``|q - x|^2 = |q|^2 + M - 2 q.x``. A quarter of the root of their number, at most MOST_PIVOTS, of the data vectors (those of smallest hash)
are pivots. Queries and data go to their nearest pivot's cell. From summaries alone - for each data cell the
largest and the k + 1 smallest distances to its pivot, for each query cell the largest - a bound theta on the distance of
the k-th neighbour follows for each query cell, and data vector s of cell j is sent to query cell i only if
``|p_i p_j| - U_i - |s p_j| <= theta_i``. Query cells are packed into groups of about GROUP queries, and the data
sent to a group (counted first) is dealt over splits of about SPLIT vectors, to each of which its queries go; each split is solved by exact matrix products, and
the splits' k best are merged.

Whole numbers: products below 2**53 are made in floating point, below 2**63 as 64-bit integers, and where components are
larger as integers of any size; only rows that are so large go the last way. Scores travel with a key that sorts as they do.

Bounds: the driver holds the pivots and MOST_PIVOTS * (k + 3) summary numbers; at most MOST_PIVOTS ** 2 routes are broadcast. A task holds one group's
queries (cut into parts of GROUP) and a split of data. No vector is left out
by a cap: data that a bound can't exclude is sent. Where squared norms are beyond floating point, nothing is excluded.

Defined cases: vectors that are null, empty or hold a null or a non-finite component take no part, nor do rows without
id; of rows with one id that with the smallest vector counts; vectors of another length than a query are not its candidates;
a query is no candidate of its own; equal scores go to the smaller id; with fewer than k
candidates all are given; a score beyond 64 bits is shown as the nearest 64-bit number, its rank is exact; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annals.llm.common import saved

LEAST_PIVOTS, MOST_PIVOTS, GROUP, SPLIT = 16, 512, 2048, 8192


def whole_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, dim, v array<double>) of the vectors that take part, one an id."""
    good = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    inf = float("inf")
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf), F.lit(False)))
    found = saved(rows.where(good).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector).alias("dim"), F.col(vector).cast("array<double>").alias("v")), "vectors")
    if found.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return found
    return saved(found.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("s")).select("vec_id", "s.*"), "vectors")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): whole numbers as doubles, or as Python integers where a product leaves floating point."""
    with np.errstate(over="ignore"):
        out = np.floor(x * scale)
    if np.isfinite(out).all():
        return out
    return np.array([[math.floor(Fraction(float(v)) * scale) for v in row] for row in x], object).reshape(x.shape)


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of whole-number matrices (as from whole); int64, or objects if any is larger."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    most = int(abs(q).max()) * int(abs(x).max()) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    out = np.empty((len(q), len(x)), object)
    bar = math.isqrt((2**63 - 1) // q.shape[1])
    small_q, small_x = (np.array([max(abs(int(v)) for v in row) <= bar for row in m]) for m in (q, x))
    i, j = np.flatnonzero(small_q), np.flatnonzero(small_x)
    out[np.ix_(i, j)] = (q[i].astype(np.int64) @ x[j].astype(np.int64).T).astype(object)
    whole_q, whole_x = _integers(q), _integers(x)
    for rows, columns in ((np.flatnonzero(~small_q), np.arange(len(x))), (i, np.flatnonzero(~small_x))):
        if len(rows) and len(columns):
            out[np.ix_(rows, columns)] = whole_q[rows].dot(whole_x[columns].T)
    return out


def sort_key(score: int) -> bytes:
    """Bytes that sort as the scores do."""
    if -(2**63) <= score < 2**63:
        return b"\x80" + (score + 2**63).to_bytes(8, "big")
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x81" + body if score > 0 else b"\x7f" + bytes(255 - b for b in body)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids; ids ascend."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    some = np.arange(len(scores))
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.argsort(-scores[some], kind="stable")][:k]


RESULT = "query_id long, vec_id long, score long, key binary"


def _one_dim(rows: DataFrame, queries, dim: int, k: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score, key) of each split's k best, for vectors of one length."""
    spark = rows.sparkSession
    rows = rows.where(F.col("dim") == dim).select("vec_id", "v")
    scaled = lambda x: F.lit(float(scale)) * x
    number = lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    n, top = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + number(x) * number(x)))).first()
    bounded = top is not None and math.isfinite(top)
    top = float(top) if bounded else 0.0
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n) // 4)) if bounded else 1
    picked = rows.withColumn("hash", F.xxhash64("vec_id")).orderBy("hash", "vec_id").limit(count).collect()
    base = whole(np.array([p.v for p in picked], float).reshape(len(picked), dim), scale) if bounded else np.zeros((1, dim))
    pivots = np.hstack([base, np.sqrt(np.maximum(0.0, top - (base**2).sum(axis=1)))[:, None]])
    apart = np.sqrt(np.maximum(0.0, (pivots**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * pivots @ pivots.T))

    def cells(it):
        for batch in it:
            if not batch.num_rows:
                continue
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            if bounded:
                x = whole(_matrix(batch.column("v")), scale)
                is_q = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
                last = np.where(is_q, 0.0, np.sqrt(np.maximum(0.0, top - (x**2).sum(axis=1))))
                full = np.hstack([x, last[:, None]])
                d2 = (full**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * full @ pivots.T
                cell = d2.argmin(axis=1).astype(np.int32)
                far = np.sqrt(np.maximum(0.0, d2[np.arange(len(cell)), cell]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["vec_id", "v", "is_query", "cell", "far"])

    sides = rows.withColumn("is_query", F.lit(False)).unionByName(rows.where(queries).withColumn("is_query", F.lit(True)))
    placed = saved(sides.mapInArrow(cells, "vec_id long, v array<double>, is_query boolean, cell int, far double"), "cells")
    data, asked = placed.where("not is_query"), placed.where("is_query")
    nearest = F.row_number().over(Window.partitionBy("cell", "part").orderBy("far"))
    few = data.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).select("cell", "part", "far").withColumn("r", nearest).where(F.col("r") <= k + 1)
    summary = {row.cell: row.low for row in few.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("far")), 1, k + 1).alias("low")).collect()}
    wide = {r.cell: (r.far, r.n) for r in asked.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    if not wide:
        return spark.createDataFrame([], RESULT)
    # theta of each query cell, and the cells' groups in the order of their pivots' distances from the first
    slack = 1e-6 * (1 + math.sqrt(top))
    limit = {}
    for i, (reach, _) in wide.items():
        upper = sorted(reach + apart[i, j] + s for j, low in summary.items() for s in low)
        limit[i] = (upper[k] if len(upper) > k else float("inf")) + reach + slack
    group_of, fill, g = {}, 0, 0
    for i in sorted(wide, key=lambda i: (apart[0, i], i)):
        if fill and fill + wide[i][1] > GROUP:
            g, fill = g + 1, 0
        group_of[i] = g
        fill += wide[i][1]
    groups = g + 1
    asks_of, least = np.zeros(groups, np.int64), np.full((groups, len(pivots)), np.inf)
    for i, g in group_of.items():
        asks_of[g] += wide[i][1]
        least[g] = np.minimum(least[g], apart[i] - limit[i])
    # at most MOST_PIVOTS ** 2 rows: the distance from which data of a cell is sent to a group
    routes = spark.createDataFrame(pd.DataFrame({"cell": np.tile(np.arange(len(pivots)), groups), "grp": np.repeat(np.arange(groups), len(pivots)), "least": least.ravel()}), "cell int, grp int, least double")
    sent = data.join(F.broadcast(routes), "cell").where(F.col("far") >= F.col("least"))
    sizes = {r.grp: r.n for r in sent.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    # a group with very many queries (one large cell) is cut into parts, each sent the group's data
    plan = spark.createDataFrame([(g, max(1, -(-int(asks_of[g]) // (2 * GROUP))), max(1, -(-sizes.get(g, 0) // SPLIT))) for g in range(groups)], "grp int, parts int, splits int")
    sent = sent.join(F.broadcast(plan), "grp").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("grp", "part", F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int").alias("split"), "vec_id", "v")
    of = spark.createDataFrame(list(group_of.items()), "cell int, grp int").join(plan, "grp")
    asks = asked.join(F.broadcast(of), "cell").select("grp", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.expr("sequence(0, splits - 1)")).alias("split"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        queries_out, ids_out, scores_out = [], [], []
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], whole(_matrix(left.column("v"))[by_id], scale)
            asked_ids, q = right.column("query_id").to_numpy(), whole(_matrix(right.column("q")), scale)
            for at in range(0, len(q), 256):
                scores = inner_products(q[at : at + 256], x)
                for row, own in zip(scores, asked_ids[at : at + 256].tolist()):
                    fit = np.flatnonzero(ids != own)
                    best = fit[_best(row[fit], ids[fit], k)]
                    queries_out += [own] * len(best)
                    ids_out += ids[best].tolist()
                    scores_out += [int(s) for s in row[best]]
        near = [min(2**63 - 1, max(-(2**63), s)) for s in scores_out]
        return pa.table({"query_id": pa.array(queries_out, pa.int64()), "vec_id": pa.array(ids_out, pa.int64()), "score": pa.array(near, pa.int64()), "key": pa.array([sort_key(s) for s in scores_out], pa.binary())})

    return sent.groupBy("grp", "part", "split").cogroup(asks.groupBy("grp", "part", "split")).applyInArrow(solve, RESULT)


def join(rows: DataFrame, queries, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition ``queries`` (on vec_id) holds for, its k best others."""
    spark = rows.sparkSession
    good = whole_vectors(rows, id_col, vector)
    dims = [r.dim for r in good.where(queries).select("dim").distinct().collect()]  # lengths of vectors: few
    found = None
    for dim in dims:
        one = _one_dim(good, queries, dim, k, scale)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
