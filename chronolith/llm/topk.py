"""Exact top-k inner-product search by distributed histogram selection.

Queries and rows are cut in blocks, and each pair of blocks is scored as one group, round after round, for all queries
in one job a round. Every round counts each query's scores in bins and finds the bin of its k-th highest score; the
next round splits that bin, until a bin is one score wide. Then rows at or above the k-th score are filtered, ties
going to the smaller id. Scores are computed anew in each round instead of being kept: a matrix product costs less than
writing queries x rows scores. Neither queries nor histograms reach the driver.

Only the k highest of a group can matter to the k-th highest of all, so a group counts no bin below its own k-th
score: it sends at most k bins per query, and exactly k rows or fewer in the last round, however many rows tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import materialize

#: Queries and rows of a block: a group holds one block of each.
QUERY_ROWS, BLOCK_ROWS = 4096, 8192
#: Bits of the score that a round settles.
ROUND_BITS = 11
_NONE, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec array<long>) per row, its components floor(scale * x) within 64 bits; unusable vectors are left out."""
    x = F.col("v")
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where(
            x.isNotNull() & F.col("id").isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
        )
        .select("id", F.transform("v", lambda y: F.floor(y * scale)).alias("vec"))
    )


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the places of the rows that have it, and their vectors."""
    column = table.column("vec").combine_chunks()
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    ends = np.cumsum(sizes)
    out = {}
    for dim in np.unique(sizes):
        at = np.nonzero(sizes == dim)[0]
        out[int(dim)] = at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in floating point only where that is exact too; beyond 64 bits, the nearest 64-bit integer but the least."""
    size = lambda a: np.abs(a.astype(np.float64)).max(axis=1, initial=0)
    mq, mx, dim = size(q), size(x), q.shape[1]
    if mq.max(initial=0) * mx.max(initial=0) * dim < 2**53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    out = q @ x.T  # wraps around in the rows and columns that follow
    large_q, large_x = mq * dim > 2**30, mx > 2**31

    def whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.clip(a.astype(object) @ b.astype(object).T, _NONE + 1, _MOST).astype(np.int64)

    if large_q.any():
        out[large_q] = whole(q[large_q], x)
    if large_x.any():
        out[:, large_x] = whole(q, x[large_x])
    return out


def _blocks(queries: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, places of rows and their scores, a part at a time; a query's own row scores _NONE."""
    asked, q_key, r_key = _by_length(queries), queries.column("key").to_numpy(), rows.column("key").to_numpy()
    for dim, (at, x) in _by_length(rows).items():
        if dim not in asked:
            continue
        place, q = asked[dim]
        for a in range(0, len(place), 512):
            for b in range(0, len(at), 4096):
                i, j = place[a : a + 512], at[b : b + 4096]
                s = scores(q[a : a + 512], x[b : b + 4096])
                s[q_key[i][:, None] == r_key[j][None, :]] = _NONE
                yield i, j, s


def _meet(rows: DataFrame, asked: DataFrame, n: int, n_asked: int, run, schema: str) -> DataFrame:
    """run(queries, rows) for each pair of a block of asked and one of rows."""
    rb, qb = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_asked // QUERY_ROWS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: F.pmod(F.xxhash64("key"), F.lit(m)).cast("int")
    left = asked.withColumn("qb", block(qb)).withColumn("rb", every(rb))
    right = rows.withColumn("rb", block(rb)).withColumn("qb", every(qb))
    left = left.toDF(*left.columns)  # else both sides' columns are the same ones
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(run, schema)


def _count(rows: DataFrame, asked: DataFrame, n: int, n_asked: int, shift: int, k: int) -> DataFrame:
    """(key, bin, n) of scores >> shift: those above asked's bin (of the round before) under the largest, those in it by bin."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        key, of = queries.column("key").to_numpy(), queries.column("bin").to_pylist()
        within = np.array([_NONE if x is None else x for x in of], np.int64)
        found = [np.zeros((3, 0), np.int64)]
        for i, _, s in _blocks(queries, rows):
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(i), _NONE + 1)
            a, b = np.nonzero((s >= least[:, None]) & (s > _NONE))
            bins, low = s[a, b] >> shift, within[i[a]]
            keep = bins >> ROUND_BITS >= low
            bins = np.where((bins >> ROUND_BITS > low) & (low > _NONE), _MOST, bins)[keep]
            pairs, times = np.unique(np.stack([key[i[a[keep]]], bins]), axis=1, return_counts=True)
            found.append(np.concatenate([pairs, times[None]]))
        out = np.concatenate(found, axis=1)
        return pa.table({"key": out[0], "bin": out[1], "n": out[2]})

    return _meet(rows, asked, n, n_asked, run, "key long, bin long, n long").groupBy("key", "bin").agg(F.sum("n").alias("n"))


def _kth_bin(counts: DataFrame, k: int) -> DataFrame:
    """(key, bin): per query the bin of its k-th highest score, or its lowest bin if it has fewer."""
    seen = F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("bin")))
    return counts.withColumn("seen", seen).groupBy("key").agg(F.coalesce(F.max(F.when(F.col("seen") >= k, F.col("bin"))), F.min("bin")).alias("bin"))


def _filtered(rows: DataFrame, asked: DataFrame, n: int, n_asked: int, k: int) -> DataFrame:
    """Rows at or above their query's k-th score; of a group only the k first in the final order."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        least, ids = np.array(queries.column("bin").to_pylist(), np.int64), rows.column("id").to_numpy()
        q_key, q_id = queries.column("key").to_numpy(), queries.column("id").to_numpy()
        found = [np.zeros((4, 0), np.int64)]
        for i, j, s in _blocks(queries, rows):
            a, b = np.nonzero((s >= least[i][:, None]) & (s > _NONE))
            score, own = s[a, b], ids[j[b]]
            order = np.lexsort((own, -score, a))
            a, own, score = a[order], own[order], score[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            at = i[a[keep]]
            found.append(np.stack([q_key[at], q_id[at], own[keep], score[keep]]))
        out = np.concatenate(found, axis=1)
        return pa.table({"key": out[0], "query_id": out[1], "vec_id": out[2], "score": out[3]})

    return _meet(rows, asked, n, n_asked, run, "key long, query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with every other row.

    is_query is a condition on the column id. Vectors that are null, empty, or hold null or non-finite components, and
    rows without id, take no part; rows that share an id are rows, and queries, of their own; vectors of another length
    than the query's are no candidates. Components and scores that 64 bits don't hold count as the nearest that they
    hold. A query with fewer than k candidates returns all. Other columns are ignored; an empty table or one without
    queries gives no rows.
    """
    rows = materialize(usable(df, id_col, vec_col, scale).withColumn("key", F.monotonically_increasing_id()), "vectors")
    length = F.aggregate("vec", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    known = rows.agg(F.max(length).alias("size"), F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("asked")).first()
    n, n_asked = known["n"], known["asked"]
    bits = max(1, min(int(known["size"] or 0), 1 << 63)).bit_length() + 1  # Cauchy-Schwarz: |score| <= size
    plain = rows.where(is_query)
    asked, shift = plain.withColumn("bin", F.lit(None).cast("long")), -(-bits // ROUND_BITS) * ROUND_BITS
    while shift > 0:
        shift -= ROUND_BITS
        # scores above the settled bin have the largest bin, so they still count before it
        kth = materialize(_kth_bin(_count(rows, asked, n, n_asked, shift, k), k), "kth")
        asked = plain.join(kth, "key")
    w = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    hits = _filtered(rows, asked, n, n_asked, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")
