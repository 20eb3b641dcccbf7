"""The registered queries of the text operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingscope.llm import alignment, bpe, decontaminate, html_extract, jaccard, kneser_ney, line_dedup, media, prefix_trie, secret_scan, sharding, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages, with the links between them."""
    records = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages"), date="2024-01-01T00:00:00Z"), keep="source")
    return records.select(
        F.col("source").alias("page_id"),
        "record_id",
        "type",
        "target_uri",
        "date",
        "refers_to",
        F.col("fields")["WARC-Concurrent-To"].alias("concurrent_to"),
        F.col("fields")["WARC-Block-Digest"].alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        F.decode("block", "UTF-8").alias("block"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary; over_limit: more than 1,024."""
    limit = 1024
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, budget=limit)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard.similar(_table(spark, sf_dir, "documents"), words=3, threshold=0.9).drop("set_key")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, counts at most one apart."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the runs that an earlier document, or place, has: all of 50 words, and those of 25 that are met."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), run_words=25, sure_words=50)
    return out.select("doc_id", "text", F.col("line_stats.n_removed").alias("lines_removed"), F.col("line_stats.words_removed").alias("words_removed"))


def op6_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they leak."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=6, coverage=0.5).drop("_key")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of the trusted ones (labelled good and not toxic), and whether it is kept."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return kneser_ney.score(_table(spark, sf_dir, "documents"), trusted)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the multilingual ranks, and the bytes they decode to, as digests."""
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents"), *vocab))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a progressive JPEG, read back, as digests and features."""
    return media.digests(media.load(media.store(_table(spark, sf_dir, "documents"))))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.trie(_table(spark, sf_dir, "conversations")).drop("digest", "parent")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under two tokenizers, aligned."""
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the three forms, and values that would cost many guesses."""
    return secret_scan.find(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_token_counts, op3_ngram_jaccard, op4_sharding, op5_line_dedup, op6_wrapper_induction, op7_decontaminate, op8_kneser_ney, op9_byte_bpe, op10_media_columns, op11_prefix_trie, op12_token_alignment, op13_secret_scan)}

ORACLE_SQL: dict[str, str] = {"op7_decontaminate": decontaminate.leaks_sql(window=6, coverage=0.5), "op11_prefix_trie": prefix_trie.TRIE_SQL}
