"""The corpus pipeline: rules, near copies, repeated passages, the mix of sources, token ids.

Each stage takes the documents that the one before kept, all of them, and its decisions take effect.
Every stage reads the columns of documents by name and leaves others, whatever they are called; gives
an empty table for an empty one; and takes very long texts as a whole, in a small multiple of their
size. Rows are documents: rows that repeat an id, or have none, are apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, jaccard, mixing, quality, substrings
from quernel.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null, empty and blank texts among them. Rows are judged one by
    one, whatever their ids; nulls in other columns stay."""
    return quality.keep(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are 0.75 alike, and of rows repeated as they are, the one with the least id stays,
    and of one id's the one whose text has the least hash; a document without an id stays only where
    none of its group has one. Texts without words are alike to none and stay."""
    return jaccard.keep(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that stand elsewhere too are cut out, with characters cut in two at
    the edges; documents with nothing left but blanks go, null and empty texts among them. All of a
    text of 200 bytes or more that another row repeats goes, whatever their ids."""
    cut = substrings.dedup(docs, carry=("lang", "source"))
    rows = cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
    return rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the whole times, and once more with a chance, fixed
    by its id, of what is left. Null sources are one source; texts without words are not taken; rows
    repeated as they are share what the mix takes of them evenly."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs, with_mark=True).where("taken > 0").groupBy("doc_id", "text_mark").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    mark = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chance = F.conv(F.substring(F.md5(mark.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    times = F.expr("taken div size") + (F.expr("(taken % size) / size") > chance).cast("long")
    times = taken.select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark"), times.cast("int").alias("_times")).where("_times > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_mark"))
    return docs.join(times, same).select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_one")).drop("_one")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' byte-level BPE ids, and the texts that these decode to, row by row; null texts are
    empty and have no ids."""
    import public_tokenizers

    rows = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mixed),
    ("BPE encoding and decoding", token_ids),
]

#: BPE is beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
