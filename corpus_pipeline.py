"""The corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last give the columns of docs, whatever their names. Null texts count as empty; null doc_ids are keys like others, rows that repeat are
judged each (and near_duplicates keeps one of them); an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import byte_bpe, contamination, language_id, near_duplicates, quality
from tremor.llm.common import fold_is, stored, table

#: A text whose language has less than this share of its n-grams is in no learned language.
LEAST_SHARE = 0.4


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. It learns from labelled rows of the documents at hand; without both labels all are kept.

    An empty text has the score of no text, which decides like any other.
    """
    ranking = quality.fit(docs, table(spark, sf_dir, "labels").where(~fold_is(5, 0)))
    return docs.where(quality.score_of(ranking)(F.col("text")) >= quality.CUT)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are in none of the learned languages, those without a letter (empty ones too) among them. If no document has a language, none is kept."""
    langs, masks = language_id.learn(docs.where(~fold_is(4, 2)))
    verdict = language_id.verdict_of(spark, langs, masks)(F.col("text"))
    return docs.where((verdict["lang_pred"] != "und") & (verdict["score"] >= LEAST_SHARE))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least doc_id. Null doc_ids come last, and of rows that repeat the kept one, one stays."""
    return near_duplicates.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain an item of the benchmark. Rows that repeat a doc_id go together; an empty benchmark takes none."""
    return contamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded again; an empty text has no tokens."""
    return byte_bpe.round_trip(docs)


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", one_of_each_group), ("decontamination", without_benchmark), ("byte_bpe", token_ids)]
#: Learned models and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
