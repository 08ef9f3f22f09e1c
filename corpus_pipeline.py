"""A corpus from raw documents in five stages: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of the one before.  The first four return the columns
of ``documents``; the last one returns a row of token ids for each document.  A stage's frame may be held and read at any time: no stage deletes
what another has made.

Defined results: null texts count as empty in every decision; documents that repeat an id are judged by their texts; extra columns of the input, whatever
their names are, give way to those of ``documents``; an empty table gives an empty result at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.deploy import ship
from cairn.llm import bpe, fair_mix, guess_cost, importance, near_copies
from cairn.session import dropped, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.classify(docs, labels, keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that of the smallest id; of rows that share it, one."""
    return near_copies.distinct_documents(docs, words=5, similarity=0.8).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return guess_cost.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the mix: twice where it takes them twice, cut where it takes a part, none where it takes none."""
    return fair_mix.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, their digest, and the digest of the text that they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Hashed models, fingerprints and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        dropped(before)  # only this function holds it
    return STAGES[-1][1](spark, docs, sf_dir)
