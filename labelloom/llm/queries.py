"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import crc_mod, table
from labelloom.llm import decontaminate, html_text, lang_id, lm_score, mixing, ngram_join, ranked_search, suffix_arrays, suffix_automata, token_pairs, token_store, topk, toxicity


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary, the byte-level one if unnamed, as the installed package of public tokenizers has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def q_op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "source", "mix_block", "mix_epoch", "mix_rank")


def _span_total() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def q_op2_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_automata.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", _span_total().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def q_op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_near(table(spark, sf_dir, "documents"))


def q_op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def q_op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = lang_id.fit(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return lang_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def q_op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def q_op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def q_op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_arrays.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        _span_total().alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def q_op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def q_op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_store.checksums(token_store.token_store(docs, tokenizer_file()))


def q_op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_score.score_texts(docs, crc_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def q_op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def q_op13_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_pairs.align_pairs(docs, tokenizer_file(), tokenizer_file("piece_bpe_32k.model")).documents


def named() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}
