"""From raw documents to token files: identify the language, drop near copies, drop contaminated documents, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's documents. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import decontaminate, lang_id, mixing, ngram_join, token_store
from labelloom.llm.common import crc_mod, table
from labelloom.llm.queries import tokenizer_file
from labelloom.session import store_table

#: A document goes if its best language has a smaller posterior than this.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; those without a letter go."""
    model = lang_id.fit(docs, crc_mod("doc_id", 4) != 2)
    found = lang_id.predict(docs, model, prefix="pipeline_")
    kept = (F.col("pipeline_lang_pred") != lang_id.UNKNOWN) & (F.col("pipeline_score") >= LEAST_SCORE)
    return found.where(kept).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies."""
    return ngram_join.keep_one(docs)


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by passages of the benchmark."""
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), prefix="pipeline_")
    return found.where(~F.col("pipeline_contaminated")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix of the sources takes them."""
    return mixing.mix_sources(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; their documents with place, size and checksum."""
    return token_store.checksums(token_store.token_store(docs, tokenizer_file()))


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("benchmark_overlap", benchmark_overlap),
    ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language model, the hash bands and the tokenizer are beyond SQL.
ORACLE_SQL = None
