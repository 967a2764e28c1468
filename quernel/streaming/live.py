"""Metrics and severity counts over streams of files and of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import lexical
from quernel.operators import findings, scores
from quernel.sources.files import from_table


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def metrics(docs: DataFrame) -> DataFrame:
    """Each arriving document's metrics: stateless."""
    return lexical.metrics(from_table(docs))


def secrets(docs: DataFrame) -> DataFrame:
    return findings.secrets(from_table(docs))


def repository_metrics(docs: DataFrame) -> DataFrame:
    """Running totals for each source, for complete or update output."""
    return scores.health(scores.repository_metrics(metrics(docs)))


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events of each type in windows of time; rows later than the watermark are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("begin"), "event_type", "n")
