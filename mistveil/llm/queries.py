"""Registered queries of the corpus operators. Each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .shared import Owner


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _alone(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose result is written, and whose scratch tables are deleted before it is returned."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Owner(spark) as owner:
            return owner.result(query(spark, sf_dir), query.__name__)

    return run


@_alone
def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rp_forest import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import quality_rules

    return quality_rules(_documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import repeated_lines

    return repeated_lines(_documents(spark, sf_dir))


@_alone
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_documents(spark, sf_dir))


@_alone
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


@_alone
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_and_decode

    return encode_and_decode(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_documents(spark, sf_dir))


@_alone
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array import digest

    return digest(_documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import digest

    return digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rp_forest, op2_toxicity, op3_repetition_rules, op4_line_dedup, op5_simhash, op6_license_scan, op7_best_fit_packing, op8_byte_bpe, op9_language_id, op10_token_files, op11_suffix_array_dedup, op12_conversation_trie, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    from .conversation_trie import SQL

    return {"op12_conversation_trie": SQL}
