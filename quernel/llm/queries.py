"""The registered queries of the ten operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, classify, flatscan, jaccard, licenses, media, mixing, quality, substrings, tokenfile
from quernel.llm.common import documents, shared_dir


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = classify.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = classify.score(docs, model)
    return rows.select("doc_id", classify.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir)).drop("kept", "kept_text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests, and from the units read back how many there are, how many are
    random-access points, and the last one's time."""
    rows = media.read(media.write(documents(spark, sf_dir)), payload=False)
    entries = F.filter("units", lambda u: u["random_access"])
    facts = [F.size("units").alias("n_units"), F.size(entries).alias("n_random_access"), F.element_at("units", -1)["pts"].alias("last_pts")]
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *facts)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(spark, documents(spark, sf_dir), tokenfile.words_encoder(_vocabulary("word_bpe_49k.json")), end_id=1)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat files of all documents' byte-level BPE ids."""
    end, root = 50256, shared_dir(spark)
    ids = flatscan.write_flat(documents(spark, sf_dir), bpe.plain_encoder(_vocabulary("byte_bpe_50k.json")), end, root)
    return flatscan.scan(spark, root, end).join(ids, ["file_id", "ordinal"]).select("doc_id", "n_tokens", "file_id", "ordinal", "begin", "terminated")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_license_scan": op1_license_scan, "op4_compression_classifier": op4_compression_classifier, "op5_suffix_dedup": op5_suffix_dedup, "op6_jaccard_join": op6_jaccard_join, "op7_transport_streams": op7_transport_streams, "op2_token_files": op2_token_files, "op3_mix": op3_mix, "op9_quality_rules": op9_quality_rules, "op8_bpe": op8_bpe, "op10_token_counts": op10_token_counts}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": mixing.sql(), "op6_jaccard_join": jaccard.sql(), "op9_quality_rules": quality.sql()}
