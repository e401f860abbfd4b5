"""Approximate nearest neighbours by collision counting (query-aware hashing).

Method.  Unit vectors are projected on ``PROJECTIONS`` random lines; each line
is one sorted array, with no buckets.  Around a query's own projection a window
of half-width ``WIDTH * R / 2`` collects its collisions on every line.  Virtual
rehashing widens all windows together (R grows by ``GROWTH`` from ``START``);
only the new ends of a window are read.  A vector that collides on at least
``SHARE`` of the lines is verified by its exact cosine.  A query stops when its
k-th best verified distance is within R, or when the windows cover everything.

Spark deals the vectors into blocks by a hash of their id, and the queries into
blocks of their own; each pair of blocks is one task's work with its own sorted
arrays (every row is indexed), and the k best per block pair are merged.  Block
sizes are parameters, so memory per task is fixed.

Result: ``query_id, rank, vec_id, score`` (cosine in double precision on the
original vectors), nearest first, ties to the smaller id.

Defined cases: null ids, null or zero vectors, and vectors with null or
non-finite components or of another length than the query take no part; rows
with equal ids are separate candidates, none of them for a query of that id;
a query row that is repeated counts once (the smallest vector by array order);
fewer candidates than k: all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
PROJECTIONS = 40
WIDTH = 2.7
SHARE = 0.7
START = 0.3
GROWTH = 1.25
BLOCK_VECTORS = 20_000
BLOCK_QUERIES = 2_000


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _levels() -> np.ndarray:
    out = [START]
    while out[-1] < 2:  # the largest distance of unit vectors
        out.append(out[-1] * GROWTH)
    return np.array([*out, np.inf])


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """``(query index, vector index, cosine)`` of the k nearest found in one block for each query."""
    m = PROJECTIONS
    least = int(np.ceil(SHARE * m))
    lines = np.random.default_rng(4).standard_normal((vectors.shape[1], m))
    unit_v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    unit_q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    on_v, on_q = unit_v @ lines, unit_q @ lines
    order = np.argsort(on_v, axis=0, kind="stable").astype(np.int32)
    levels = _levels()
    half = WIDTH * levels / 2
    low = np.empty((m, len(queries), len(levels)), np.int64)
    high = np.empty_like(low)
    columns = []
    for i in range(m):
        line = on_v[order[:, i], i]
        columns.append(np.ascontiguousarray(order[:, i]))
        low[i] = np.searchsorted(line, on_q[:, i, None] - half, "left")
        high[i] = np.searchsorted(line, on_q[:, i, None] + half, "right")
    out = []
    for q in range(len(queries)):
        count = np.zeros(len(vectors), np.int64)
        checked = ids == query_ids[q]  # its own rows are no candidates
        found, cosines = [], []
        for level, radius in enumerate(levels):
            if level == 0:
                new = [columns[i][low[i, q, 0]:high[i, q, 0]] for i in range(m)]
            else:
                new = [columns[i][low[i, q, level]:low[i, q, level - 1]] for i in range(m)]
                new += [columns[i][high[i, q, level - 1]:high[i, q, level]] for i in range(m)]
            count += np.bincount(np.concatenate(new), minlength=len(vectors))
            ready = np.flatnonzero((count >= least) & ~checked)
            if len(ready):
                checked[ready] = True
                found.append(ready)
                cosines.append(unit_v[ready] @ unit_q[q])
            if found:
                c = np.concatenate(cosines)
                if len(c) >= k and np.sqrt(max(0.0, 2 - 2 * np.partition(c, len(c) - k)[len(c) - k])) <= radius:
                    break
        if found:
            at, c = np.concatenate(found), np.concatenate(cosines)
            # keep ties with the k-th (rounding apart), of copies of one vector the k smallest ids: the rest is
            # ordered by its exact cosines
            bar = np.partition(c, len(c) - k)[len(c) - k] - 1e-9 if len(c) > k else -2.0
            keep = at[c >= bar]
            if len(keep) > 2 * k:
                same = np.unique(vectors[keep], axis=0, return_inverse=True)[1].ravel()
                order = np.lexsort((ids[keep], same))
                run = np.r_[True, np.diff(same[order]) != 0]
                nth = np.arange(len(order)) - np.maximum.accumulate(np.where(run, np.arange(len(order)), 0))
                keep = keep[order[nth < k]]
            exact = sorted((-_cosine(vectors[j], queries[q]), ids[j], j) for j in keep.tolist())
            out += [(q, j, -c) for c, _, j in exact[:k]]
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
           block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest vectors found for each query (both tables: id and vector)."""
    def clean(df):
        v = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return v.where(F.col("id").isNotNull() & usable(F.col("v")))

    data = clean(vectors)
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    sizes = data.agg(F.count("*").alias("n")).first()["n"], asked.agg(F.count("*").alias("n")).first()["n"]
    n_data, n_asked = max(1, -(-sizes[0] // block_vectors)), max(1, -(-sizes[1] // block_queries))
    salt = F.xxhash64(F.col("id"), F.col("v"))
    data = data.withColumn("block", F.pmod(salt, F.lit(n_data)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    asked = asked.withColumn("part", F.pmod(salt, F.lit(n_asked)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_data - 1))))

    def pair(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(d):
            length = d["v"].map(len).to_numpy()
            for size in np.unique(q["v"].map(len)):  # vectors of one length compare with each other
                qs, ds = q[q["v"].map(len) == size], d[length == size]
                if len(ds):
                    qi, di = qs["id"].to_numpy(), ds["id"].to_numpy()
                    for a, b, c in search_block(qi, np.stack(qs["v"].to_list()), di, np.stack(ds["v"].to_list()), k):
                        rows.append((qi[a], di[b], c))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = asked.groupBy("part", "block").cogroup(data.groupBy("part", "block")).applyInPandas(
        pair, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
