"""A corpus in four stages: language identification, one document of each group of near copies, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and reads it again for the next stage. All stages but the last keep
the columns of documents; other columns are dropped, an empty table stays empty, very long texts are
taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontamination, jaccard_join, language_id
from lodestone.llm.common import crc_of_id, numbered, stored, table, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose words agree on no language even so far is rejected.
LEAST_SCORE = 0.3
#: Near copies: as many percent of the shingles of so many words of two texts are equal.
SHINGLE, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language: those with letters whose best language has at least LEAST_SCORE of the mass. Others go: null and empty texts too. Rows are judged one by one, whatever their ids; without labelled rows nothing stays."""
    docs = docs.select(*COLUMNS)
    texts = docs.withColumn("t", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    model = language_id.train(language_id.labelled_sample(texts.filter(crc_of_id() % 3 != 1)))
    return language_id.predicted(texts, model, list(COLUMNS)).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id, null ids last; of repeated rows one. Rows with equal ids and unlike texts are documents of their own, and texts without words are near nothing."""
    rows = numbered(docs.select(*COLUMNS), "pipeline-rows")
    found = jaccard_join.similarity_components(rows.select(F.col("_row").alias("doc_id"), "text"), shingle=SHINGLE, percent=PERCENT).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("k")).select(F.col("k._row").alias("_row"))
    dropped = stored(found.select("_row").join(kept, "_row", "left_anti"), "pipeline-dropped")
    return without(rows, dropped, "_row").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a window of a benchmark item, whatever their id; null and empty texts stay."""
    rows = numbered(docs.select(*COLUMNS), "pipeline-rows")
    found = decontamination.contamination(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    dirty = stored(found.filter("n_hit > 0").select(F.col("doc_id").alias("_row")), "pipeline-dirty")
    return without(rows, dirty, "_row").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document and decodes it again: numbers of tokens and digests. Repeated ids and rows are answered each, null texts as empty ones."""
    return byte_bpe.op8_bpe_round_trip(docs)


STAGES = [("language_id", language_stage), ("ngram_jaccard_join", jaccard_stage), ("decontamination", decontamination_stage), ("byte_level_bpe", token_stage)]

#: The stages have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
