"""The queries opN_<name>: thin views of the operators with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colvane.llm import bloom_lm, bpe, dac, imatch, jaccard, packing, passages, quality, search, toxicity
from colvane.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 3, 1)
    return found.select("doc_id", "held_out", "score", "predicted", "offending")


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.language_model(table(spark, sf_dir, "documents"), 7, 2)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 5, 80)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 4, 2)


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), 50, 0.8)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read(dac.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(table(spark, sf_dir, "embeddings"), 20, 20)


QUERIES = {f.__name__: f for f in (op1_packing, op2_fingerprints, op3_toxicity, op4_bloom_lm, op5_jaccard_join, op6_quality, op7_passages, op8_bpe, op9_token_files, op10_nearest)}

#: What DuckDB can compute whole. The others' rows depend on tokenizer files, trained models or hashes it lacks; they
#: are tested against brute force.
ORACLES: dict[str, str] = {}
