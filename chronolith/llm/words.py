"""Scores of whole texts that are sums over their words: training samples, subword features, cached scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import map_rows, tidy

#: Words, and characters of them, that a task remembers at most; beyond it they are scored again.
KEPT_WORDS, KEPT_CHARS = 200_000, 16_000_000
#: Remainder of crc32(doc_id as text) modulo FOLDS that is never learnt from.
FOLDS, HELD_OUT = 5, 0

_ARROW = {"double": pa.float64(), "int": pa.int32()}


def held_out(id_col) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most rows labelled documents in hash order, none of them held out.

    The sample is bounded by rows and by chars, the longest text that it may hold; texts in it are whole. Rows
    without id, text or label are passed over; of several labels of a document the smallest counts, of several texts
    the greatest.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    picked = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") <= chars)
    # rows bounds the broadcast side
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y"))


def learn(rows: DataFrame, bag: Callable[[str], bytes], train: Callable[[list[tuple[int, bytes, int]]], bytes]) -> bytes:
    """What train makes of rows, a sample(), in one task: it gets (doc_id, bag of the text, y) by doc_id.

    Texts become bags where they lie; the driver gets the model alone.
    """

    def bags():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = pa.array([bag(x.as_py()) for x in batch.column(1)], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), made, batch.column(2)], ["doc_id", "bag", "y"])

        return one

    def model(batches):
        got = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([train(got)], pa.binary())], ["model"])

    return bytes(map_rows(rows, bags, "doc_id long, bag binary, y int").repartition(1).mapInArrow(tidy(model), "model binary").first()["model"])


class Scorer:
    """Per text, what score says of its words (split at white space), put together by add; words are remembered."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], add: Callable = lambda values, words: values.sum(axis=0), most: int = KEPT_WORDS):
        self.score, self.add, self.most = score, add, most
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.values: np.ndarray | None = None
        self.n = self.chars = 0

    def _learn(self, new: list[str]) -> None:
        got = self.score(new)
        if self.values is None:
            self.values = np.zeros((max(1024, len(new)), *got.shape[1:]), got.dtype)
        while self.n + len(new) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.n : self.n + len(new)] = got
        self.at.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)
        self.chars += sum(map(len, new))

    def sums(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Per text the values of its words, added up; None for a text without words."""
        if self.n > self.most or self.chars > KEPT_CHARS:
            self._clear()
        split = [(x or "").split() for x in texts]
        new = [w for w in set().union(*split) if w not in self.at]
        if new:
            self._learn(new)
        get = self.at.__getitem__
        return [self.add(self.values[np.fromiter(map(get, x), np.int64, len(x))], x) if x else None for x in split]


def score_texts(docs: DataFrame, make: Callable[[], tuple[Scorer, Callable]], schema: str, id_col: str = "doc_id", text_col: str = "text", group: int = 64) -> DataFrame:
    """schema's rows (doc_id first) from finish(sums), a few texts at a time."""
    names, types = zip(*(c.split() for c in schema.split(", ")))

    def run():
        scorer, finish = make()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for at in range(0, batch.num_rows, group):
                out += [finish(s) for s in scorer.sums(batch.column(1).slice(at, group).to_pylist())]
            columns = [batch.column(0), *(pa.array(c, _ARROW[t]) for c, t in zip(zip(*out), types[1:]))]
            return pa.RecordBatch.from_arrays(columns, list(names))

        return one

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)
