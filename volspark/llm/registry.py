"""The thin queries of the corpus operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from volspark.llm import chat, exact_dedup, fingerprint, importance, language, mixing, ngram_join, packing, pieces, prefix_trie, quality, substring_dedup, toxicity
from volspark.llm.common import documents


def tokenizer() -> dict:
    """Paths of the public tokenizer's files; they are parameters of the operator."""
    import public_tokenizers as public

    return {"json_path": public.path("byte_bpe_50k.json"), "ranks_path": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir)).drop("repeats", "kept_text")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), **tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.digests(chat.format_conversations(rows))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    model = pieces.read_model(public.path("piece_bpe_32k.model"))
    return pieces.encode(documents(spark, sf_dir), model, ("n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_language_id, op3_toxicity, op4_exact_dedup, op5_substring_dedup, op6_ngram_jaccard, op7_fingerprints, op8_best_fit_packing, op9_mixing, op10_chat_format, op11_prefix_trie, op12_importance_resampling, op13_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op5_substring_dedup": substring_dedup.ORACLE, "op6_ngram_jaccard": ngram_join.ORACLE, "op9_mixing": mixing.ORACLE, "op10_chat_format": chat.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_importance_resampling": importance.ORACLE}
