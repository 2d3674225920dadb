"""The corpus pipeline: language, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again before the next one. All but the last return the columns
of ``documents`` and keep rows as they are, whatever their other columns hold. Texts of any
length are judged as a whole, and an empty table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import decontam, jaccard_join, langid, packing, toxicity
from lattica.llm.common import crc_mod, cut, release, remove, shared_dir, table

#: A language is rejected if it is undetermined or less likely than this.
LEAST_LANGUAGE = 0.5
#: A document is toxic from this score on.
TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns as in op2.

    A text that is null or has no letter has none, so its document goes. Repeated rows
    are judged alike and all kept. Languages that tie are below LEAST_LANGUAGE only if three or more do.
    """
    model = langid.fit(docs, train=crc_mod(F.col("doc_id"), 4) != 2)
    p = langid.predict(docs, model, into="__language")
    return p.where((F.col("__language.lang") != langid.UNDETERMINED) & (F.col("__language.score") >= LEAST_LANGUAGE)).drop("__language")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; the model learns as in op5, from this stage's input.

    A null or empty text has the score of one without words, which is clean. Repeated rows
    are judged alike and all kept; a score of just TOXIC is toxic.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.coalesce(crc_mod(F.col("doc_id"), 5) != 0, F.lit(False)))
    return toxicity.score(docs, model, into="__toxicity").where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the one with the smallest id.

    Of rows that share an id one stays, the one with the smallest hash of all its columns. Null and empty
    texts link with nothing. Rows without an id are in no group and all stay.
    """
    first = cut(jaccard_join.contract(docs).where("doc_id = component_id").select("doc_id").distinct())
    release(spark)
    kept = docs.join(first, "doc_id", "left_semi").select(*docs.columns)
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), F.hash(*docs.columns)))).where("__n = 1").drop("__n")
    return kept.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak none; repeated rows are judged alike."""
    found = decontam.leaks(docs, table(spark, sf_dir, "benchmark"), into="__leaks")
    return found.where(F.size("__leaks") == 0).drop("__leaks")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents with their sequences, as in op4; a null or empty text has the end id alone."""
    return packing.contract(docs)


STAGES = [("language_id", language), ("toxicity", toxic), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("best_fit_packing", pack)]

#: Trained models, tokenizers and edit distances have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        to = f"{out}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if k:
            remove(spark, f"{out}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
