"""A corpus pipeline of five stages; each works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colvane.llm import jaccard, packing, passages, quality, toxicity
from colvane.llm.common import stored, table

#: A document goes if its toxicity is at least REJECT_TOXIC, or if its quality is below REJECT_QUALITY.
REJECT_TOXIC, REJECT_QUALITY = 0.7, 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose own text scores at least REJECT_TOXIC, with or without a doc_id; repeated rows are judged each. Null
    and empty texts score as a sentence with no features. Without usable labels nothing is learned; an empty table stays
    empty; extra columns are kept."""
    score = toxicity.scorer(spark, toxicity.learn(docs, _labels(spark, sf_dir)))
    return docs.where(score(F.col("text")) < REJECT_TOXIC)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose own text scores below REJECT_QUALITY; nulls, repeats and extra columns as in the stage before."""
    score = quality.scorer(spark, quality.learn(docs, _labels(spark, sf_dir)))
    return docs.where(score(F.col("text")) >= REJECT_QUALITY)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one of smallest doc_id, and one row of its equal rows. Rows without a
    doc_id can't be named and all stay; so do the different texts of a kept doc_id. Null and empty texts have no
    shingles, are like nothing and stay. Extra columns are kept; an empty table stays empty."""
    found = jaccard.jaccard_components(docs)
    keys = found.where("doc_id = component_id").select("doc_id").distinct()
    own = F.struct(*docs.columns)
    kept = docs.join(keys, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min(own).alias("r")).select("r.*")
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all documents but their first; n_chars follows. No row goes. Rows without a doc_id,
    rows of a doc_id with different texts, and null or empty texts stay as they are; extra columns are kept."""
    return passages.without_passages(docs, stored(passages.repeated_passages(docs), "passages"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids. A null or empty text is the end id alone, a null doc_id stays
    null, repeated rows are packed each, an empty table gives no rows; other columns are not read."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring_dedup", passages_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizer files are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
