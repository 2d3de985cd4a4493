"""The registered query of each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import registry
from .decontaminate import benchmark_hits
from .fingerprints import fingerprint_edits
from .frames import table
from .license_scan import license_scan
from .merkle import manifest_sql, tampered_text, verify
from .mixing import mix_counts
from .parity_join import similarity_components
from .prefix_trie import prefix_trie, trie_sql
from .quality import quality_scores
from .registry import register
from .repeated_spans import removed_spans
from .sharding import shard, shard_sql
from .simhash_tiles import simhash_components
from .token_counts import token_counts
from .url_filter import url_filter


@register("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@register("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


SHARD_BYTES = 1 << 20


@register("op3_sharding", shard_sql(SHARD_BYTES))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), SHARD_BYTES, columns=["doc_id"])


@register("op4_ngram_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


@register("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.drop("text_hash")


@register("op7_repeated_spans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents")).drop("ranges")


@register("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@register("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


@register("op11_prefix_trie", trie_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


@register("op12_merkle", manifest_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(table(spark, sf_dir, "documents"), tampered_text())


@register("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
