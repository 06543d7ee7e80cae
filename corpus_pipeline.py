"""The corpus pipeline: documents -> quality -> one of each near-duplicate
group -> pseudonyms -> packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``:

1. ``quality``   rows that score below 0.3 go
2. ``near_duplicates``   of each group of near duplicates the smallest id stays
3. ``pseudonyms``   personal data in the texts is replaced; ``n_chars``
   follows where an address changes its length
4. ``packing``   texts are tokenized and packed into sequences

A NULL text counts as empty at every stage and stays NULL in what is passed
on; repeated rows are judged alike; extra columns pass through all stages
but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import ngram_join, packing, pseudonyms, quality
from tillroll.llm.common import table, tokenizer_path, written
from tillroll.llm.queries import DEMO_KEY


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, at_least=0.3)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, percent=80)


def stage_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = pseudonyms.pseudonymise(docs, DEMO_KEY)
    if "n_chars" not in docs.columns:
        return named
    return named.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                            .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, max_len=4096)


STAGES = [("quality", stage_quality), ("near_duplicates", stage_near_duplicates),
          ("pseudonyms", stage_pseudonyms), ("packing", stage_packing)]

#: Neither the classifier nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
