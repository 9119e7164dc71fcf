"""Near-duplicate texts by 64-bit SimHash: byte-position inverted index, count filter, verification.

Two fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they share at least
six positional bytes. The index lists fingerprints under six choices of four positional bytes, chosen so that any six
bytes hold one of the choices whole (a covering design). Pairs of a list therefore share four to eight positional
bytes; these are tallied, pairs below six are dropped, and the rest are verified by Hamming distance. A list returns a
spanning forest of its links, which connects the same documents as all its pairs would.

Copies meet in one fingerprint before they are listed. A list that is longer than LIST_ROWS is listed anew under its
own four bytes and every choice of two of the others, which pairs that share six bytes have in common; such a list has
six bytes in common, thus 65,536 distinct fingerprints at most, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from chronolith.llm.common import connected_components, discard_since, map_rows, mark, materialize, tidy

#: Byte positions of the lists: each two positions lie outside one of them.
_FOURS = [tuple(sorted(set(range(8)) - set(out))) for out in ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7), (4, 5, 6, 7))]
_mask = lambda at: sum(0xFF << (8 * p) for p in at)
#: Masks of the lists, and under each the masks of its finer ones.
_KEPT = [_mask(at) for at in _FOURS]
_FINER = [[_mask(at + two) for two in combinations(sorted(set(range(8)) - set(at)), 2)] for at in _FOURS]
#: Fingerprints of a list that is not listed anew, and classes of a list whose shingle isn't put last.
LIST_ROWS, HOT_ROWS = 2048, 512
#: Pairs that a task compares at a time.
PAIRS = 300_000
#: Positional bytes by which pairs of texts are tallied, and how many similar ones share: of Jaccard similarity 0.8 they
#: share 51 on average, standard deviation 3.2.
BYTES, SHARED_BYTES = 64, 36
_SEED = 42
#: Bits that texts of similarity 0.8 may differ in (9.7 on average, standard deviation 2.9), and the shingles from which that
#: holds: of 4,000 random pairs of 12 to 64 shingles at the similarity, one in 32,000 differed in more.
WIDE, FEW = 22, 12


def hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the stretches of width words of one text; fewer words than that make one stretch, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), _SEED)] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(_SEED)), np.uint64, len(words) - width + 1)


def majority(h: np.ndarray) -> int:
    """The bits that most of h have set; of no hashes: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of one text; none or no words: 0."""
    return majority(hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) per row of docs; whole texts, null text as empty, repeated rows and null ids kept."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, fp long")


def forest(fps: np.ndarray, free: int, bits: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its list's component) for each linked one of a list that agrees outside free."""
    fps = np.sort(fps.astype(np.uint64))
    n = len(fps)
    found = []
    if free.bit_count() > 16:
        for at in range(0, n, 256):
            x = fps[at : at + 256, None] ^ fps[None, :]
            shared = (x[:, :, None].view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)  # the tally
            i, j = np.nonzero(shared >= 6)
            i, j, near = i + at, j, np.bitwise_count(x[i, j]) <= bits
            keep = near & (i < j)
            found.append(np.stack([i[keep], j[keep]]))
    else:  # six bytes agree, which settles the tally: the neighbours in the other two are looked up
        places = [np.uint64(1 << b) for b in range(64) if free >> b & 1]
        for m in [np.bitwise_or.reduce(c) for k in range(1, bits + 1) for c in combinations(places, k)]:
            to = fps ^ m
            at = np.minimum(np.searchsorted(fps, to), n - 1)
            hit = np.nonzero((fps[at] == to) & (to > fps))[0]
            found.append(np.stack([hit, at[hit]]))
    i, j = np.concatenate(found, axis=1)
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (before == root).all():
            break
    return [(int(fps[k]), int(fps[root[k]])) for k in np.nonzero(root != np.arange(n))[0]]


def links(fps: DataFrame, bits: int = 2, list_rows: int = LIST_ROWS) -> DataFrame:
    """(src, dst) between distinct fingerprints (column fp): a spanning forest of all links of at most bits bits."""
    if not 0 <= bits <= 2:
        raise ValueError("six shared bytes guarantee links of at most 2 bits")
    signed = lambda m: F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")
    post = lambda masks: F.posexplode(F.array(*[F.col("fp").bitwiseAND(signed(m)) for m in masks])).alias("kept", "key")
    posted = fps.select("fp").repartition("fp").select("fp", post(_KEPT))
    size = posted.groupBy("kept", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    held = posted.join(size, ["kept", "key"])
    mask = F.lit(None).cast("long")
    for k, m in enumerate(_KEPT):
        mask = F.when(F.col("kept") == k, signed(m)).otherwise(mask)
    short = held.where(F.col("rows") <= list_rows).select(mask.alias("mask"), "key", "fp")
    finer = F.array(*[F.array(*[signed(m) for m in masks]) for masks in _FINER])
    long = held.where(F.col("rows") > list_rows).select("fp", F.explode(F.element_at(finer, F.col("kept") + 1)).alias("mask"))
    long = long.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct()
    lists = short.union(long).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for kept, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += forest(members.values.to_numpy().view(np.uint64), ~kept & (1 << 64) - 1, bits)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

        return one

    return map_rows(lists.select("mask", "fps"), make, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs.

    Texts are lower-cased (A-Z), split at ASCII white space and cut in word shingles; fingerprints of at most bits
    differing bits link; component_id is the smallest doc_id reachable. Null and blank texts have fingerprint zero
    and link like any other; a null doc_id keeps its row and never names a component; an empty table gives no rows;
    other columns are ignored.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = connected_components(links(classes.select("fp"), bits))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _prefix(n: int, similarity: float) -> int:
    """So many of n shingles that two similar sets have one of them in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1


_ODD = np.random.default_rng(64).integers(1 << 62, 1 << 63, BYTES).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def positional(h: np.ndarray) -> np.ndarray:
    """BYTES positional bytes of a set of hashes, each of one min-hash: two sets share as many as they are similar."""
    least = np.full(BYTES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] * _ODD
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return (least >> np.uint64(8)).astype(np.uint8)


def signed(docs: DataFrame, similarity: float, width: int, text_col: str = "text") -> DataFrame:
    """docs with _class (of its set of shingles), _n (their number), _fp (their SimHash) and _prefix.

    _prefix holds the least hashes of the set, so many that two sets of Jaccard similarity similarity have one of
    them in common.
    """

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for x in batch.column(batch.schema.get_field_index(text_col)):
                h = np.unique(hashes(x.as_py(), width))
                prefix = h[: _prefix(len(h), similarity)]
                found.append((xxhash.xxh64_intdigest(h.tobytes(), _SEED), len(h), majority(h), prefix.tobytes()))
            cls, n, fp, prefix = zip(*found)
            made = [pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(prefix, pa.binary())]
            return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_class", "_n", "_fp", "_prefix"])

        return one

    schema = StructType([*docs.schema.fields, StructField("_class", LongType()), StructField("_n", IntegerType()), StructField("_fp", LongType()), StructField("_prefix", BinaryType())])
    return map_rows(docs, make, schema)


def meetings(size: np.ndarray, cls: np.ndarray, n: np.ndarray, at: np.ndarray, fp: np.ndarray, side: np.ndarray, similarity: float, bits: int) -> Iterator[np.ndarray]:
    """(lesser, greater) classes that may be similar, of lists of these sizes, one after the other; the pairs of a turn at a time.

    n: shingles of a class, at: place of the list's shingle among them, side: pairs of one side don't count unless it is
    -1. What the sizes and places rule out goes, and of classes of at least FEW shingles what the SimHash does. Lists of
    PAIRS pairs, or a single one, are compared in a turn.
    """
    turn, ends = np.cumsum(size.astype(np.int64) ** 2 // 2) // PAIRS, np.cumsum(size)
    for k in np.unique(turn):
        out = [np.zeros((0, 2), np.int64)]
        own = np.flatnonzero(turn == k)
        rows = slice(ends[own[0]] - size[own[0]], ends[own[-1]])
        c, m, p, f, s = cls[rows], n[rows], at[rows], fp[rows], side[rows]
        left = np.repeat(np.cumsum(size[own]), size[own]) - np.arange(len(c))  # members of the list from here on
        apart, start = 1, np.arange(len(c))
        while True:
            start = start[left[start] > apart]
            if not len(start):
                break
            i, j = start, start + apart
            least = similarity / (1 + similarity) * (m[i] + m[j]) - 1e-9
            keep = (np.minimum(p[i], p[j]) + np.minimum(m[i] - p[i], m[j] - p[j]) >= least) & ((s[i] < 0) | (s[i] != s[j]))
            i, j = i[keep], j[keep]
            near = (np.minimum(m[i], m[j]) < FEW) | (np.bitwise_count(f[i] ^ f[j]) <= bits)
            i, j = i[near], j[near]
            out.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])], axis=1))
            apart += 1
        yield np.concatenate(out)


def postings(classes: DataFrame) -> DataFrame:
    """(h, at, cls, n, fp) per shingle of each class's prefix (columns cls, n, fp, prefix)."""

    def post():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            prefix = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            size = [len(x) for x in prefix]
            own = [np.repeat(batch.column(k).to_numpy(), size) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefix)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in size])), *map(pa.array, own)], ["h", "at", "cls", "n", "fp"])

        return one

    return map_rows(classes.select("cls", "n", "fp", "prefix"), post, "h long, at int, cls long, n int, fp long")


def stream_meetings(posted: DataFrame, similarity: float, bits: int, list_rows: int) -> DataFrame:
    """(src, dst) of meetings() in all lists of posted up to list_rows; of a longer list only its shingle, as (h, null)."""

    def run(batches):
        none = np.zeros((5, 0), np.int64)
        held, long = none, None

        def finish(m: np.ndarray):
            """Pairs and long lists of whole runs of one h each."""
            starts = np.flatnonzero(np.r_[True, np.diff(m[0]) != 0])
            size = np.diff(np.r_[starts, m.shape[1]])
            over, keep = m[0, starts[size > list_rows]], np.repeat((size > 1) & (size <= list_rows), size)
            _, at, cls, n, fp = m[:, keep]
            found = meetings(size[(size > 1) & (size <= list_rows)], cls, n, at, fp.view(np.uint64), np.full(len(cls), -1), similarity, bits)
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
            return np.concatenate([pairs[:, 0], over]), np.ma.array(np.concatenate([pairs[:, 1], over]), mask=np.arange(len(pairs) + len(over)) >= len(pairs))

        def table(src, dst):
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst.data, mask=np.ma.getmaskarray(dst))], ["src", "dst"])

        for batch in batches:
            m = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            if long is not None:  # the rest of a list that is known to be long
                m = m[:, m[0] != long]
            if not m.shape[1]:
                continue
            m = np.concatenate([held, m], axis=1)
            last = int(np.searchsorted(m[0], m[0, -1]))
            if last:
                yield table(*finish(np.ascontiguousarray(m[:, :last])))
            held, long = m[:, last:], None
            if held.shape[1] > list_rows:
                long = int(held[0, 0])
                yield table(*finish(held))
                held = none
        if held.shape[1]:
            yield table(*finish(np.ascontiguousarray(held)))

    return posted.select("h", "at", "cls", "n", "fp").repartition("h").sortWithinPartitions("h").mapInArrow(tidy(run), "src long, dst long")


def block_meetings(posted: DataFrame, similarity: float, bits: int, list_rows: int) -> DataFrame:
    """(src, dst) of meetings() in the lists of posted, block by block, so that a group holds two blocks of list_rows at most."""
    size = posted.groupBy("h").agg(F.count("*").alias("rows"))
    held = posted.join(size, "h").withColumn("blocks", F.ceil(F.col("rows") / list_rows).cast("int"))
    held = held.withColumn("b", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("b") == F.col("o"), F.lit(-1)).otherwise(F.col("b"))
    placed = held.select("h", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), F.struct("cls", "n", "at", "fp", side.alias("side")).alias("m"))
    lists = placed.groupBy("h", "lo", "hi").agg(F.collect_list("m").alias("m")).where(F.size("m") > 1).select("m")

    def meet(batches):
        for batch in batches:
            size, m = np.diff(batch.column(0).offsets.to_numpy()), batch.column(0).flatten()
            cls, n, at, fp, side = (m.field(k).to_numpy() for k in range(5))
            for pairs in meetings(size, cls, n.astype(np.int64), at.astype(np.int64), fp.view(np.uint64), side, similarity, bits):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    # few bytes, much work: partitions of so many bytes each would be few
    lists = lists.repartition(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return lists.mapInArrow(tidy(meet), "src long, dst long")


#: Shingles that go to every task instead of all postings to theirs.
BROADCAST_SHINGLES = 500_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SHINGLES else df


def _texts(rows: DataFrame, classes: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(cls, n, fp, text) of the classes wanted (cls), each from one of its rows; texts aren't shuffled where few are wanted."""
    own = materialize(classes.select("cls", "row", "n", "fp").join(_few(wanted), "cls", "left_semi"), "wanted", small=True)
    return rows.select(F.col("_row").alias("row"), F.col(text_col).alias("text")).join(_few(own), "row").select("cls", "n", "fp", "text")


def candidates(rows: DataFrame, classes: DataFrame, similarity: float, width: int, bits: int, text_col: str, list_rows: int) -> DataFrame:
    """(src, dst): pairs of classes that meet in a list.

    A shingle that more than list_rows classes have in their prefix is put last in everyone's order: its list is left
    out, and the classes that have it there take rarer ones into their prefix, with which they meet everyone else's.
    What is a long list even then is compared block by block.
    """
    met = materialize(stream_meetings(postings(classes), similarity, bits, list_rows).distinct(), "met", small=True)
    pairs, hot = met.where("dst is not null"), met.where("dst is null").select(F.col("src").alias("h")).distinct()
    if hot.isEmpty():
        return pairs
    posted = postings(classes)
    touched = materialize(posted.join(_few(hot), "h", "left_semi").select("cls").distinct(), "touched", small=True)
    texts = _texts(rows, classes, touched, text_col)
    if hot.count() <= BROADCAST_SHINGLES:
        common = np.sort(hot.toArrow().column("h").to_numpy())  # 4 MB at most
        held = texts.withColumn("hot", F.lit(None).cast("array<long>"))
    else:
        common, texts = None, materialize(texts, "crowded")

        def spell():
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                sets = [np.unique(hashes(x.as_py(), width)).view(np.int64) for x in batch.column(1)]
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], ["cls", "h"])

            return one

        own = map_rows(texts.select("cls", "text"), spell, "cls long, h long").join(hot, "h", "left_semi").groupBy("cls").agg(F.collect_list("h").alias("hot"))
        held = texts.join(own, "cls")

    def more():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [np.zeros((4, 0), np.int64)]
            for cls, n, fp, text, last in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4).to_pylist()):
                h = np.unique(hashes(text.as_py(), width))
                late = np.isin(h.view(np.int64), common if common is not None else np.array(last, np.int64))
                first = _prefix(len(h), similarity)
                new = np.setdiff1d(np.concatenate([h[~late], h[late]])[:first], h[:first][~late[:first]]).view(np.int64)
                out.append(np.stack([new, np.full(len(new), cls), np.full(len(new), n), np.full(len(new), fp)]))
            h, cls, n, fp = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.zeros(len(h), np.int32)), pa.array(cls), pa.array(n.astype(np.int32)), pa.array(fp)], ["h", "at", "cls", "n", "fp"])

        return one

    again = materialize(map_rows(held.select("cls", "n", "fp", "text", "hot"), more, "h long, at int, cls long, n int, fp long"), "rarer", small=True)
    keys = materialize(again.select("h").distinct().join(_few(hot), "h", "left_anti"), "rarer-keys", small=True)
    # places of the two orders don't compare, so they don't count here
    both = again.union(posted.join(_few(keys), "h", "left_semi").select("h", F.lit(0).alias("at"), "cls", "n", "fp"))
    both = materialize(both, "rarer-lists", small=True)
    second = materialize(stream_meetings(both, similarity, bits, list_rows).distinct(), "met", small=True)
    long = second.where("dst is null").select(F.col("src").alias("h")).distinct()
    pairs = pairs.union(second.where("dst is not null"))
    if not long.isEmpty():
        pairs = pairs.union(block_meetings(both.join(_few(long), "h", "left_semi"), similarity, bits, list_rows))
    return pairs.where("src <> dst").distinct()


def similar(rows: DataFrame, similarity: float, width: int, bits: int, text_col: str = "text", list_rows: int = HOT_ROWS) -> DataFrame:
    """(src, dst): the pairs of classes of rows, a table of signed() with numbers _row, whose sets of shingles are similar."""
    one = lambda c: F.first(c).alias(c[1:])
    classes = rows.where("_n > 0").groupBy(F.col("_class").alias("cls")).agg(F.min("_row").alias("row"), one("_n"), one("_fp"), one("_prefix"))
    classes = materialize(classes, "classes")
    met = materialize(candidates(rows, classes, similarity, width, bits, text_col, list_rows), "near", small=True)
    nodes = materialize(met.select(F.col("src").alias("cls")).union(met.select(F.col("dst").alias("cls"))).distinct(), "nodes", small=True)

    def spell():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(hashes(x.as_py(), width)) for x in batch.column(1)]
            held = pa.array([np.unique(x.astype(np.uint32)).tobytes() for x in sets], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), held, pa.array([positional(x).tobytes() for x in sets], pa.binary())], ["cls", "held", "bytes"])

        return one

    sets = materialize(map_rows(_texts(rows, classes, nodes, text_col).select("cls", "text"), spell, "cls long, held binary, bytes binary"), "sets")
    side = lambda k, what: sets.select(F.col("cls").alias(k), F.col(what).alias(f"_{k}"))

    def both(df: DataFrame, what: str) -> DataFrame:
        return df.join(side("src", what), "src").join(side("dst", what), "dst").select("src", "dst", "_src", "_dst")

    def tally():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BYTES) for k in (2, 3))
            return batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= SHARED_BYTES))

        return one

    def check():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return one

    left = materialize(map_rows(both(met, "bytes"), tally, "src long, dst long"), "tallied", small=True)
    return map_rows(both(left, "held"), check, "src long, dst long")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, bits: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of docs that links of similar texts connect: the least id (null last), then the first row.

    Texts are lower-cased (A-Z), split at ASCII white space and cut in word shingles; a link needs a Jaccard
    similarity of their sets of at least similarity, computed on the sets themselves (32 bits of each stretch's hash).
    Candidates share one of the least shingles, which every similar pair does, differ in at most bits bits of their
    SimHash, and share at least SHARED_BYTES of BYTES positional bytes. Null and blank texts are alike; groups are made of texts, so rows with different texts under one id
    stay and repeated rows leave one; other columns may have any names but those that signed() adds, and _row; an
    empty table gives no rows.
    """
    rows = materialize(signed(docs, similarity, width, text_col).withColumn("_row", F.monotonically_increasing_id()), "signed")
    since = mark()
    found = connected_components(similar(rows, similarity, width, bits, text_col))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    ids = rows.select("_class", "_row", key.alias("key"))
    ids = ids.join(found, ids["_class"] == found["node"], "left").select(F.coalesce("component", "_class").alias("_group"), "key")
    first = ids.groupBy("_group").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = materialize(ids.join(first, "_group").where("key.row <> first.row").select(F.col("key.row").alias("_row")), "copies", small=True)
    discard_since(docs.sparkSession, since, gone)
    return rows.join(_few(gone), "_row", "left_anti").select(*docs.columns)
