"""One query per corpus operator, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, langid, lm, minhash, ogg, packing, quality, suffix, toxicity
from .common import read

TOKENIZER = "word_bpe_49k.json"


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents")).drop("kept", "spans")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read(spark, sf_dir, "documents"), tokenizer())


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(read(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_suffix_dedup, op3_exact_dedup, op4_language, op5_packing, op6_toxicity, op7_bpe, op8_ogg, op9_minhash, op10_lm)}

ORACLES = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256,
               CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes
        FROM d""",
}
