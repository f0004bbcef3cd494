"""The corpus pipeline: toxic documents go, near copies go, personal data is redacted, sources are mixed, texts become tokens.

Each stage reads what the one before kept. All but the last return the columns of `documents`; `n_chars` follows the text.
In a mix a document that is taken twice is two equal rows. Models are fitted on the given `labels` and on what the stage
reads, as their operators say. Odd inputs have the results that the operators state.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from workmart.llm import ngram_join, pareto_mix, pii_boost, piece_table, toxicity_ordinal
from workmart.llm.common import read
from workmart.llm.queries import usefulness
from workmart.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_ordinal.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity_ordinal.score(docs.select(*COLUMNS), model).filter("not rejected").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii_boost.find(docs, pii_boost.fit(docs), ["doc_id", "lang", "source", "n_chars"], outputs=("redacted",))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = pareto_mix.mix(docs.select(*COLUMNS), utility=usefulness()).filter("copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_table.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"], outputs=("n_tokens", "ids"))


STAGES = [("toxicity", without_toxic), ("near copies", without_near_copies), ("personal data", without_personal_data), ("mixing", mixed), ("pieces", encoded)]
ORACLE_SQL = None  # models and samples aren't expressible in SQL; tests compare each stage with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
