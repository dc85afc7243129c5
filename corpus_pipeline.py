"""From raw documents to token ids: five stages over one table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again for the next. All stages but the last keep the columns of the table.

Defined results: a stage meets NULLs, empty and very long texts, ties, repeated rows, empty
tables and further columns as its operator states; further columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderwatch.llm import bpe, byte_cnn, decontaminate, ngram_join, quality_rules
from orderwatch.llm.shared import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Mean window chance of the best language below which a text counts as no language that was learned.
MIN_LANGUAGE_SCORE = 0.3
# Near duplicates share at least so many percent of their shingles of so many words.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters go."""
    judged = byte_cnn.predict(docs, byte_cnn.fit(docs), carry=True)
    return judged.filter((F.col("lang_pred") != byte_cnn.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the one with the smallest id."""
    return ngram_join.keep_one(docs, words=SHINGLE_WORDS, percent=SHINGLE_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and decoded text."""
    decoded = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER)
    return bpe.digests(decoded, "ids")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontaminate", decontamination),
    ("bpe", tokens),
]

# Learned models, sketches of bytes and BPE are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the documents below ``sf_dir`` that pass all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
