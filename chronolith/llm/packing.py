"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan is made of counts, not documents: pieces of one length are placed together into the fullest sequences
that hold them. There are at most as many lengths as the capacity, so histogram and plan are small at any size of
the corpus. Pieces then take planned slots by joining on their rank within their length; ranks are counted in
salted groups of bounded size, so a length that a third of all rows share is still spread.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import map_rows, materialize

#: Words that a worker remembers; more make it faster and larger, and change no result.
KEPT_WORDS = 300_000
#: Rows of one length in one ranking group, about.
GROUP_ROWS = 100_000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) runs: best fit over counts, longest first.

    The count pieces from first rank go to as many sequences from first sequence, all at the same offset.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences (first, count)
    sizes: list[int] = []  # heap of rooms that may have runs
    runs, made = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        rank, left, skipped = 0, histogram[length], set()
        while left:
            while sizes and (sizes[0] < length or not room.get(sizes[0])):
                size = heappop(sizes)
                if room.get(size):
                    skipped.add(size)
            if sizes:
                size = sizes[0]
                first, count = room[size].pop()
                if count > left:
                    room[size].append((first + left, count - left))
                    count = left
            else:
                size, first, count = capacity, made, max(1, left // (capacity // length))
                made += count
            runs.append((length, rank, count, first, capacity - size))
            if size > length:
                if not room.get(size - length):
                    heappush(sizes, size - length)
                room[size - length].append((first, count))
            rank, left = rank + count, left - count
        for size in skipped:
            heappush(sizes, size)
    return runs


#: One Words per tokenizer in a Python worker, which runs many tasks one after the other.
_WORDS: dict[str, "Words"] = {}
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_MARKS = ".,!?;:#%&$*|()\""


def _alphabet() -> dict[int, str]:
    """Byte-level BPE's printable letter for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Words:
    """Token ids of whole texts, kept per stretch between plain spaces, at which the tokenizer always splits.

    Only the space, tab and line ends count as such; any other white space is left to the tokenizer. A stretch of
    Latin letters and marks after them is two of the tokenizer's own pieces: its merges are asked for the lower-cased
    letters alone, which many stretches share; everything else goes through the whole tokenizer. most bounds the
    memory of one worker, not the result: beyond it what is kept is dropped and encoded again.
    """

    def __init__(self, path: str, most: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (known["normalizer"] or {}).get("normalizers", [])]
        split = [n["type"] for n in (known["pre_tokenizer"] or {}).get("pretokenizers", [])]
        # the short way is right for this tokenizer's normalizer and pieces; others take the long way throughout
        self.short = steps == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"]
        self.model, self.letters, self.most = self.tokenizer.model, _alphabet(), most
        self._clear()

    def _clear(self) -> None:
        self.chars = 0
        self.kept: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}

    def _encode(self, new: list[str]) -> None:
        whole, kept, cores, short, tokenize = [], self.kept, self.cores, self.short, self.model.tokenize
        for w in new:
            core = w.rstrip(_MARKS)
            low = core.lower()
            plain = low.isascii() and low.isalpha()  # then its bytes are their own letters
            if not (short and (plain or _LATIN.fullmatch(low))):
                whole.append(w)
                continue
            ids = cores.get(low)
            if ids is None:
                text = low if plain else low.encode().decode("latin-1").translate(self.letters)
                cores[low] = ids = array("I", [t.id for t in tokenize(text)]).tobytes()
            if len(core) < len(w):
                marks = w[len(core) :]
                more = kept.get(marks)
                if more is None:
                    kept[marks] = more = self._whole([marks])[0]
                ids += more
            kept[w] = ids
        for at in range(0, len(whole), 20_000):
            some = whole[at : at + 20_000]
            self.kept.update(zip(some, self._whole(some)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids, little-endian unsigned 32-bit."""
        if len(self.kept) > self.most or self.chars > 50 * self.most:
            self._clear()
        split = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts]
        kept = self.kept
        found = [list(map(kept.get, words)) for words in split]
        gaps = [[k for k, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        new = list({words[k] for words, at in zip(split, gaps) for k in at})
        if new:
            self._encode(new)
            self.chars += sum(map(len, new))
        for words, ids, at in zip(split, found, gaps):
            for k in at:
                ids[k] = kept[words[k]]
        return [b"".join(ids) for ids in found]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0, kept_words: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece of each row's token ids followed by the end id.

    Rows of more than capacity ids are cut into pieces of capacity, the last one shorter. Null text is empty, which
    leaves the end id alone.
    """

    def make():
        if tokenizer not in _WORDS:
            _WORDS[tokenizer] = Words(tokenizer)
        words = _WORDS[tokenizer]
        words.most = kept_words

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, ids in zip(part.column(0).to_pylist(), words.encode([x or "" for x in part.column(1).to_pylist()])):
                    raw, n = ids + int(end).to_bytes(4, "little"), len(ids) // 4 + 1
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        out.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(cut: DataFrame, capacity: int = 2048, group_rows: int = GROUP_ROWS) -> DataFrame:
    """cut (any rows with a column length) with sequence_id and offset by the plan of its own histogram."""
    spark = cut.sparkSession
    names = cut.columns
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = spark.createDataFrame(plan(counts, capacity), "length long, first long, n long, sequence long, offset long")
    salts = max(1, -(-max(counts.values(), default=1) // group_rows))
    key = F.xxhash64(*[F.col(c) for c in names])
    salted = cut.select(*names, key.alias("_key"), F.pmod(key, F.lit(salts)).cast("int").alias("_salt"))
    before = (
        salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
        .select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    )
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_key", *names)) - 1
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    at = (ranked["length"] == slots["length"]) & (ranked["_rank"] >= slots["first"]) & (ranked["_rank"] < slots["first"] + slots["n"])
    # The plan has a few runs per length, so its size is bounded by the capacity.
    return ranked.join(F.broadcast(slots), at).select(
        *[ranked[c] for c in names], (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), F.col("offset")
    )


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0, kept_words: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Every row is packed, repeated rows and null ids too; an empty table gives no rows; other columns are ignored.
    Which piece of a length takes which slot depends on a hash of the piece, so reruns agree.
    """
    return assign(materialize(pieces(docs, tokenizer, id_col, text_col, capacity, end, kept_words), "pieces"), capacity)
