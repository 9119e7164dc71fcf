"""Mixing sources to target weights by entropy balancing, in DataFrame and SQL operations alone.

Among all document rates, the mix takes those closest to taking each word once (in Kullback-Leibler divergence over
words) that give each source its target of words. The convex dual has one variable per source; its gradient and
Hessian need the source's sum of size * exp(lambda), which the distributed aggregate gives, and Newton's steps
follow for all sources side by side. The rates are exponentially tilted, exp(lambda of the source), and at most
MOST_COPIES because targets stop there. They are then rounded into copies: everyone gets the whole part, and in the
order of a hash documents get one more until their source's words reach its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import ASCII_SPACE, materialize

WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), 1.5, 2
#: Newton steps: each gains a factor e while far off and squares the error when near.
STEPS = 60
#: Words of one group in which documents are put in order.
GROUP_WORDS = 4_000_000


def word_count(text) -> F.Column:
    """Number of stretches without ASCII white space; null: 0. Each is replaced by one letter, nothing is listed."""
    marks = F.regexp_replace(text, f"[{ASCII_SPACE}]*[^{ASCII_SPACE}]+", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, f"[{ASCII_SPACE}]+$", "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sources (source, source_size) with target: weights by order share out share of all words, none above most times its size.

    The excess of sources that stop goes to the others by weight until none is above. That ends with sources in the
    order of size per weight: those that stop come first, and the level of the others is what is left per weight.
    Sources are ordered in one task, which holds one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("w", F.element_at(turn, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    line = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    known = ranked.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("w"))
    # the level that counts is that of the first source which doesn't stop
    free = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)
    return known.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(free["level"] * F.col("w")).alias("target"))


def tilt(size, target, steps: int = STEPS) -> F.Column:
    """lambda by Newton on the dual size * exp(lambda) - target * lambda, from 0; minus infinity for no target."""
    step = lambda at, _: at - (F.lit(1.0) - target / (size * F.exp(at)))  # gradient / Hessian
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return F.when((size > 0) & (target > 0), solved).otherwise(F.lit(float("-inf")))


#: Up to so many sources, their rates go to every task instead of all documents to their source's.
BROADCAST_SOURCES = 50_000


def _order(id_col: str, text_col: str) -> F.Column:
    """A hash of the row, from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 1)


def rates(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, group_words: int = GROUP_WORDS) -> DataFrame:
    """(source, source_size, target, rate, whole, cut) per source of rows (source, size, h): whole copies for each of
    its documents, and one more for those with h up to cut."""
    sizes = targets(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share, most)
    size = F.col("source_size").cast("double")
    rate = F.exp(tilt(size, F.col("target")))
    whole = F.least(F.floor(rate + 1e-9), F.lit(most))
    known = materialize(
        sizes.select(
            "source", "source_size", "target", rate.alias("rate"), whole.alias("whole"), (F.col("target") - whole * size).alias("rest"),
            F.greatest(F.ceil(size / group_words), F.lit(1)).cast("int").alias("groups"),
        ),
        "tilts",
    )
    placed = with_sources(rows, known).select("source", "size", "h", "whole", "rest", "groups")
    # A source's documents are put in order in as many groups as it has words for; only sums cross groups.
    slot = F.least(F.floor(F.col("h") / F.lit(float(1 << 63)) * F.col("groups")).cast("int"), F.col("groups") - 1)
    placed = placed.where((F.col("rest") > 0) & (F.col("whole") < most)).withColumn("slot", slot)
    sums = placed.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("slot")) - F.col("words"))
    # the source's target is met in one group: those before it lie below the cut as a whole
    at = before.where("before < rest").groupBy("source").agg(F.max(F.struct("slot", "before")).alias("m")).select(F.col("source").alias("of"), F.col("m.slot").alias("at"), F.col("m.before").alias("before"))
    last = placed.join(at, placed["source"].eqNullSafe(at["of"]) & (placed["slot"] == at["at"]))
    seen = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("h"))  # rows of one h together
    cuts = last.withColumn("more", seen - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(
        F.max(F.when(F.col("more"), F.col("h"))).alias("in"), (F.min("h") - 1).alias("none")
    ).select(F.col("source").alias("of"), F.coalesce("in", "none").alias("cut"))
    joined = known.join(cuts, known["source"].eqNullSafe(cuts["of"]), "left")
    return materialize(joined.select("source", "source_size", "target", "rate", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")), "rates")


def with_sources(rows: DataFrame, known: DataFrame, source_col: str = "source") -> DataFrame:
    """rows with known's columns (known: a written table, one row per source)."""
    small = known.count() <= BROADCAST_SOURCES
    named = known.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(named) if small else named, rows[source_col].cast("string").eqNullSafe(named["_source"])).drop("_source")


def _copies() -> F.Column:
    return (F.col("whole") + (F.col("h") <= F.col("cut")).cast("long")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) per row of docs.

    A null text has size 0 and takes no words; a null source is a source of its own, last in order; null ids are
    documents of their own, rows that repeat id and text get the same number of copies. The words that a source takes
    differ from its target by half of its largest document at most (or of what repeats). The order of documents is a
    hash of the row, so reruns agree. No words at all: targets of 0; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), _order(id_col, text_col).alias("h"),
    )
    rows = materialize(rows, "sizes")
    out = with_sources(rows, rates(rows, weights, share, most)).withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def replicate(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, with its columns as they are."""
    rows = docs.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), _order(id_col, text_col).alias("h"))
    rows = materialize(rows, "sizes")
    known = rates(rows, weights, share, most).select("source", "whole", "cut")
    names = [f"_c{k}" for k in range(len(docs.columns))]  # the columns of docs may have any names
    renamed = docs.toDF(*names)
    of = dict(zip(docs.columns, names))
    placed = with_sources(renamed.withColumn("h", _order(of[id_col], of[text_col])), known, of[source_col]).withColumn("copies", _copies())
    taken = placed.where("copies > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return taken.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
