"""The registered queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import decontamination, html_text, language_id, line_dedup, mixing, near_duplicates, nearest, oracles, prefix_trie, quality, sharding, spelling, token_counts, token_files
from thalweg.llm.tables import table
from thalweg.session import written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary(token_counts.VOCABULARY), public_tokenizers.PATTERN)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.groups(docs, width=3, similarity=(85, 100))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digests(decontamination.find_hits(docs, table(spark, sf_dir, "benchmark")).drop("text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), _vocabulary(token_files.VOCABULARY), folder)
    return token_files.token_digests(token_files.read_tokens(spark, folder))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.numbered(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(written(spelling.vocabulary(table(spark, sf_dir, "documents")), "vocabulary"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def queries() -> dict:
    found = (op1_token_counts, op2_sharding, op3_mixing, op4_html_text, op5_quality, op6_near_duplicates, op7_decontamination, op8_token_files, op9_line_dedup, op10_nearest, op11_prefix_trie, op12_spelling, op13_language_id)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
