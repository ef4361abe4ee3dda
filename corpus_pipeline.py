"""A training corpus out of `documents`: five stages, each a DataFrame of the documents that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm.decontamination import decontaminate
from corpusweave.llm.jaccard_join import jaccard_components
from corpusweave.llm.language_id import learn_profiles, predict_language
from corpusweave.llm.line_dedup import dedup_lines
from corpusweave.llm.packing import pack, token_pieces
from corpusweave.llm.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`lang` becomes the predicted language; documents in which none can be told go."""
    told = predict_language(docs, learn_profiles(docs), carry=("text", "source", "n_chars"))
    return told.filter("lang_pred <> 'und'").withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and near lines one stays; documents without a word left go."""
    kept = dedup_lines(docs, carry=("lang", "source"))
    kept = kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))
    return kept.filter(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (nulls last, then the smallest key of the row)."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    first = jaccard_components(docs).groupBy("root_key").agg(F.min(place).alias("first")).select("first.row_key")
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    return keyed.join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0").select("row_key").distinct()
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    return keyed.join(found, "row_key", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and the sequences they go into."""
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]

#: Near-copy components and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
