"""The registered queries of this subpackage: thin digests of the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.warc import round_trip

    out = round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import classify

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.syncmers import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.neardup import link

    return link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op8_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op11_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.tiered import build, search

    return search(build(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm.oracles import SQL

    return SQL
