"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, collocations, jaccard, license, linededup, mixing, neardup, oracles, runs, sharding, toxicity, urlfilter, warc  # noqa: A004


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    both = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_ann_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "expected_severity", "grade", "rejected")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", F.size("removed_lines").alias("n_removed"), "removed_lines", "text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", value("source"), value("lang"), "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license.scan(docs, license.train(docs))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)) + 8, F.coalesce(F.crc32("text"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("size"), crc.cast("long").alias("text_crc32"))
    return sharding.shuffled(docs, 24)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), 4, 30, 2000, 80)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(op1_bpe, op2_ann_hilbert, op3_ngram_jaccard, op4_url_filter, op5_embedding_neardup, op6_toxicity, op7_line_dedup),
        *(op8_warc, op9_mixing, op10_license, op11_sharding, op12_collocations, op13_periodic_runs),
    )
}
ORACLE_SQL: dict[str, str] = {"op4_url_filter": urlfilter.ORACLE, "op9_mixing": mixing.oracle(), "op12_collocations": collocations.ORACLE, **oracles.SQL}
