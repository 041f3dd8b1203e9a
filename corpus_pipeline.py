"""The corpus pipeline: stages over `documents`, each written as Parquet and read
again as the next one's input.

1. language_id     rejects texts without a letter or without a likely language
2. near_duplicates keeps the row of the least id of each group of near copies (five-word grams, 0.8)
3. pii             replaces personal data by the name of its kind
4. mix_sources     repeats, drops and cuts documents until sources have their shares
5. pack            cuts and joins the token ids into sequences

Nulls, empty and long texts, repeated rows and empty tables are handled as the
operators say; a null or empty text goes at the first stage. Extra columns stay
until the last stage. n_chars, where there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinvec.llm import lang_id, mixing, ngram_join, packing, pii
from twinvec.llm.common import written
from twinvec.llm.queries import tokenizer_path
from twinvec.scratch import set_small_batches

MIN_SCORE = 0.1
GRAM_WORDS, PERCENT = 5, 80


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_small_batches(spark)  # for all stages
    model = lang_id.train(docs.where(~lang_id.held_out("doc_id")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tagged = lang_id.predict(docs.select(F.struct(*columns).alias("row"), "text"), model)
    return tagged.where((F.col("lang_pred") != lang_id.UND) & (F.col("score") >= MIN_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(docs, GRAM_WORDS, PERCENT)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("pii", remove_pii), ("mix_sources", mix_sources), ("pack", pack)]
#: Language identification and retrieval cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
