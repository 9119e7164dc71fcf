"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest pivots in order; pivots are vectors of a bounded sample. Inverted lists hold,
under every pair of near pivots, the vectors that have both, as ids and pivots alone. The pivots that two vectors of a
list share are counted, and pairs below SHARED are dropped; only vectors that have a pair left are then fetched for
their lists, and the cosine of these pairs is verified in double precision. Equal vectors meet in one representative
first.

The number of pivots grows with the square root of the number of vectors, so that lists stay short, up to MOST_PIVOTS;
beyond that (4 million vectors) lists grow in proportion. There is no cap on lists, candidates or partners: a list
longer than LIST_ROWS is cut in blocks, and pairs of blocks are compared in separate groups, so that a group stays
small however crowded its list is. A pair that several lists hold is counted in the first of them alone, so pairs never
need to be shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import connected_components, map_rows, materialize

#: Fewest and most pivots, vectors of the sample per pivot, nearest pivots of a vector, pivots a pair must share.
PIVOTS, MOST_PIVOTS, SAMPLE, NEAREST, SHARED = 256, 8192, 4, 8, 3
#: No two pivots are as alike as this: of a crowd of near copies one is a pivot at most, so that all of them see the
#: same pivots in nearly the same order.
APART = 0.7
#: Vectors of one block of a list; rows of one group of short lists.
LIST_ROWS, GROUP_ROWS = 1500, 6000


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): every row; v null where the vector is null, empty, zero or holds null or non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    good = (
        v.isNotNull() & F.forall(v, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
        & F.exists(v, lambda y: y != 0.0)
    )
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, v).alias("v"))


def pivot_count(vectors: int) -> int:
    """Pivots for so many vectors: four times the square root, within PIVOTS and MOST_PIVOTS."""
    return min(MOST_PIVOTS, max(PIVOTS, 4 * math.isqrt(vectors)))


def choose_pivots(reps: DataFrame, pivots: int = PIVOTS, sample: int | None = None) -> dict[int, np.ndarray]:
    """By dimension: unit vectors picked from a hash-ordered sample, each as far as possible from those before."""
    rows = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample or SAMPLE * pivots).collect()
    out = {}
    for dim in {len(r["v"]) for r in rows}:
        x = _unit(np.array([r["v"] for r in rows if len(r["v"]) == dim]))
        near, picked = np.full(len(x), -2.0), []
        while len(picked) < min(pivots, len(x)) and near.min() < APART:
            picked.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[picked[-1]])
            near[picked] = 3
        out[dim] = x[picked]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def describe(reps: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """(rep, n, u, near): the unit vector and its nearest pivots in order. Dimensions outside the sample have one pivot, 0."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            near, unit = [None] * batch.num_rows, [None] * batch.num_rows
            column = batch.column(2)
            sizes = column.value_lengths().to_numpy()
            flat, ends = column.flatten().to_numpy(), np.cumsum(sizes)
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                u = _unit(flat[(ends[at] - dim)[:, None] + np.arange(dim)])
                p = pivots.get(int(dim), np.zeros((1, dim)))
                like = -(u @ p.T)
                best = np.sort(np.argpartition(like, min(nearest, len(p)) - 1, axis=1)[:, :nearest], axis=1)
                order = np.take_along_axis(best, np.argsort(np.take_along_axis(like, best, 1), axis=1, kind="stable"), 1).astype(np.int32)
                for k, o, x in zip(at, order, u):
                    near[k], unit[k] = o, x
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, pa.list_(pa.float64())), pa.array(near, pa.list_(pa.int32()))], ["rep", "n", "u", "near"])

        return one

    return map_rows(reps.select("rep", "n", "v"), make, "rep long, n long, u array<double>, near array<int>")


def _keys(near: np.ndarray, pivots: int, dim: int) -> np.ndarray:
    p = np.sort(near)
    if len(p) == 1:
        return np.array([(dim * pivots + p[0]) * pivots + p[0]], np.int64)
    i, j = np.triu_indices(len(p), 1)
    return ((dim * pivots + p[i]) * pivots + p[j]).astype(np.int64)


def postings(described: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(key, rep, near): one row per pair of a vector's near pivots; vectors of different lengths share no key."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [_keys(np.array(x), pivots, d) for x, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            of = np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of))], ["key", "rep", "near"])

        return one

    return map_rows(described.select("rep", "near", F.size("u").alias("d")), make, "key long, rep long, near array<int>")


def tally(key: int, near: np.ndarray, side: np.ndarray | None, shared: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of a list (side: of one pair of its blocks) that share enough pivots, and this key as the first pair."""
    used, place = np.unique(near, return_inverse=True)
    held = np.zeros((len(near), len(used)), np.float32)
    held[np.arange(len(near))[:, None], place.reshape(near.shape)] = 1
    same = np.triu(held @ held.T >= min(shared, near.shape[1]), 1)
    if side is not None:
        same &= side[:, None] != side[None, :]
    i, j = np.nonzero(same)
    # of the pivots up to this key's second they share exactly its own two, if it is the first
    early = used <= key % pivots
    own = 1 if key // pivots % pivots == key % pivots else 2
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        keep[at : at + (1 << 16)] = (held[i[at : at + (1 << 16)]] * held[j[at : at + (1 << 16)]])[:, early].sum(axis=1) == own
    return i[keep], j[keep]


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i and j of x."""
    if len(i) * 8 > len(x) ** 2:
        return (x @ x.T)[i, j]
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", x[i[at : at + (1 << 16)]], x[j[at : at + (1 << 16)]])
    return out


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (before == root).all():
            return root


def _lists(table: pa.Table):
    """(key, first row, row after the last, side) per list of a group, or per pair of blocks, of a table sorted by them."""
    key, lo, hi, b = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "b"))
    cuts = np.nonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0))[0] + 1
    for a, z in zip([0, *cuts], [*cuts, len(key)]):
        if z - a > 1:
            yield int(key[a]), a, z, None if lo[a] == hi[a] else b[a:z]


_ORDER = [("key", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("rep", "ascending")]


def candidates(described: DataFrame, shared: int = SHARED, pivots: int = PIVOTS, list_rows: int = LIST_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, lo, hi, b, rep): the vectors of each list, or pair of blocks lo and hi of one, that share enough with another there."""
    posted = materialize(postings(described, pivots), "postings")
    sizes = posted.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    groups = max(1, -(-posted.count() // group_rows))
    blocks = F.ceil(F.col("rows") / list_rows).cast("int")
    held = posted.join(sizes, "key").withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = held.select("key", "rep", "near", "b", "blocks", other.alias("o")).select(
        "key", "rep", "near", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o"))).alias("grp"),
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by(_ORDER)
        near, kept = table.column("near").combine_chunks(), [np.zeros(0, np.int64)]
        for key, a, z, side in _lists(table):
            p = near.slice(a, z - a).flatten().to_numpy().reshape(z - a, -1)
            kept.append(a + np.unique(np.concatenate(tally(key, p, side, shared, pivots))))
        return table.select(["key", "lo", "hi", "b", "rep"]).take(pa.array(np.concatenate(kept)))

    return placed.groupBy("grp").applyInArrow(run, "key long, lo int, hi int, b int, rep long")


def pair_links(described: DataFrame, threshold: float, shared: int = SHARED, pivots: int = PIVOTS, list_rows: int = LIST_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(src, dst, n): dst null: src has n linked vectors more; n null: src and dst belong together (a spanning forest)."""
    left = materialize(candidates(described, shared, pivots, list_rows, group_rows), "candidates")
    groups = max(1, -(-left.count() // group_rows))
    group = F.when(F.col("lo") == F.col("hi"), F.pmod(F.xxhash64("key", "lo"), F.lit(groups))).otherwise(F.xxhash64("key", "lo", "hi"))
    rows = left.withColumn("grp", group).join(described, "rep").select("grp", "key", "lo", "hi", "b", "rep", "n", "u", "near")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by(_ORDER)
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        u, near = table.column("u").combine_chunks(), table.column("near").combine_chunks()
        src, dst, num = [], [], []
        for key, a, z, side in _lists(table):
            x = u.slice(a, z - a).flatten().to_numpy().reshape(z - a, -1)
            p = near.slice(a, z - a).flatten().to_numpy().reshape(z - a, -1)
            i, j = tally(key, p, side, shared, pivots)
            like = cosines(x, i, j) >= threshold
            i, j = i[like], j[like]
            if not len(i):
                continue
            count = np.bincount(i, n[a:z][j], z - a) + np.bincount(j, n[a:z][i], z - a)
            for k in np.nonzero(count)[0]:
                src.append(int(rep[a + k])), dst.append(None), num.append(int(count[k]))
            root = _forest(i, j, z - a)
            for k in np.nonzero(root != np.arange(z - a))[0]:
                src.append(int(rep[a + k])), dst.append(int(rep[a + root[k]])), num.append(None)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "n": pa.array(num, pa.int64())})

    return rows.groupBy("grp").applyInArrow(run, "src long, dst long, n long")


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", **index: int) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of df.

    n_links counts the other rows whose cosine is at least threshold, component_id is the smallest vec_id reachable
    over links, kept says that it is the row's own. Vectors that are null, empty, zero or hold null or non-finite
    components, and vectors of different lengths, link with nothing. Repeated rows are vectors of their own and link
    with each other; a row with a null vec_id links with nothing and is kept. Other columns are ignored.
    """
    rows = usable(df, id_col, vec_col)
    part = {k: v for k, v in index.items() if k in ("shared", "list_rows", "group_rows")}
    members = rows.where("v is not null and vec_id is not null")
    reps = members.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # written once, so it stays
    m = index.get("pivots") or pivot_count(reps.count())
    described = materialize(describe(reps, choose_pivots(reps, m, index.get("sample")), index.get("nearest", NEAREST)), "pivots")
    found = materialize(pair_links(described, threshold, pivots=m, **part), "links")
    roots = connected_components(found.where("dst is not null").select("src", "dst"))
    counts = found.where("n is not null").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("links"))
    of = reps.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    of = of.select("v", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("root"))
    of = of.join(of.groupBy("root").agg(F.min("first").alias("least")), "root").select("v", "links", "least")
    out = rows.where("vec_id is not null").join(of, "v", "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    out = out.union(rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long"), F.lit(None).cast("long")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall(spark: SparkSession, df: DataFrame, result: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Share of the true links that n_links of result counts, by brute force on the driver: for fixtures and reports."""
    rows = [r for r in usable(df, id_col, vec_col).collect() if r["v"] is not None and r["vec_id"] is not None]
    true = 0
    for dim in {len(r["v"]) for r in rows}:
        x = _unit(np.array([r["v"] for r in rows if len(r["v"]) == dim]))
        for at in range(0, len(x), 1024):
            true += int((x[at : at + 1024] @ x.T >= threshold).sum()) - len(x[at : at + 1024])
    got = result.agg(F.sum("n_links")).first()[0] or 0
    return got / true if true else 1.0
