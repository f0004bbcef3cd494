"""One query for each operator of this subpackage: its whole table, production parameters, the agreed columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathlib import Path

from workmart.llm import ads_search, bfd_shards, byte_gru, ngram_join, norm_topk, pareto_mix, phrase_tiles, pii_boost, piece_table, quality_fm, spelling_variants, toxicity_ordinal, warc_dict
from workmart.llm.common import read


def held_out(id: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2


def usefulness() -> Column:
    """Short texts are half or a quarter as useful to a mix as texts of 64 words and more."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.25), pareto_mix.words_of("text") / 64))


def op1_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "n_chars")
    machine = quality_fm.fit(docs, read(spark, folder, "labels"), keep=~held_out())
    scored = quality_fm.score(docs, machine)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_pii_boost(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return pii_boost.find(docs, pii_boost.fit(docs), ["doc_id"], outputs=("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"))


def op3_ads_search(spark: SparkSession, folder: str) -> DataFrame:
    return ads_search.search(read(spark, folder, "embeddings"), k=20, every=20)


def op4_bfd_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = bfd_shards.shard(read(spark, folder, "documents").select("doc_id", "text"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(read(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


def op6_norm_topk(spark: SparkSession, folder: str) -> DataFrame:
    return norm_topk.search(read(spark, folder, "embeddings"), k=20, every=20)


def op7_toxicity_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return toxicity_ordinal.score(docs, toxicity_ordinal.fit(docs, read(spark, folder, "labels"))).select("doc_id", "severity", "p_toxic", "grade", "rejected")


def op8_warc_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc_dict.write(read(spark, folder, "pages"), warc_dict.archive_folder(spark))
    return warc_dict.read_back(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", "text")
    return pareto_mix.mix(docs, utility=usefulness()).select("doc_id", "size", "source_size", "target", "taken")


def op10_piece_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return piece_table.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def held_out_lang(id: str = "doc_id") -> Column:
    """Rows that the language model may not learn from."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1


def op11_byte_gru(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    model = byte_gru.fit(docs.filter(~held_out_lang()))
    return byte_gru.predict(docs, model).select("doc_id", F.coalesce(held_out_lang(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_phrase_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_tiles.collocations(read(spark, folder, "documents"), least=10, top=2000)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.variants(read(spark, folder, "documents"))


QUERIES = {q.__name__: q for q in (op1_quality_fm, op2_pii_boost, op3_ads_search, op4_bfd_shards, op5_ngram_join, op6_norm_topk, op7_toxicity_ordinal, op8_warc_dictionary, op9_pareto_mix, op10_piece_table,
                                    op11_byte_gru, op12_phrase_tiles, op13_spelling_variants)}
#: DuckDB SQL over the same tables, where SQL can state the result.
ORACLE: dict[str, str] = {"op12_phrase_tiles": (Path(__file__).parent / "op12_phrase_tiles.sql").read_text()}
