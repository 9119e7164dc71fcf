"""The corpus pipeline: documents in, packed sequences out. Counted as part of the subpackage llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet to the shared folder and reads back as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import mixing, packing, quality, secrets, simhash
from chronolith.llm.common import discard, discard_since, mark, materialize

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Fewer than packing alone takes: workers of a pipeline have been through its other stages.
KEPT_WORDS = 200_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; the others go.

    Null and empty texts are scored by the bias alone; repeated rows and null ids are judged like any other; an empty
    table gives no rows; other columns stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = quality.fit(quality.sample(docs, labels, "quality", quality.SAMPLE_ROWS, quality.SAMPLE_CHARS))
    return quality.filter_texts(docs, weights, bias)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id (null ids last), then the first row.

    Near copies have a Jaccard similarity of at least 0.8 in stretches of five words to another of their group. Groups
    are made of texts, so rows with different texts under one id both stay and repeated rows leave one. Null and blank
    texts are one group; an empty table gives no rows; other columns stay as they are.
    """
    return simhash.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked; n_chars follows where it isn't null.

    Each row is masked by itself, whatever its id; null and empty texts stay; an empty table gives no rows.
    """
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it.

    Null and blank texts have no words and are taken by their source's rate; repeated rows and null ids are documents of
    their own; an empty table gives no rows; other columns stay as they are.
    """
    return mixing.replicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every copy, cut and placed.

    Null and empty texts are one end id; repeated rows and null ids are packed like any other; an empty table gives no
    rows; other columns are ignored.
    """
    return packing.pack(docs, TOKENIZER, kept_words=KEPT_WORDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # neither learned models, fingerprints nor token ids can be had in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = mark()
        done = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard_since(spark, since, done)
        if hasattr(docs, "_table_path"):
            discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
