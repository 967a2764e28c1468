"""Token counts from flat token files without an index, by their end-of-document ids.

A flat file is a run of fixed-width little-endian ids; each document ends with the end id. Files
are read in byte ranges that end anywhere, also within an id: a range has the ids that begin in it.
Each range is searched at once over an array, and gives one row: its separators and its size. A
prefix scan over a file's ranges, running sums and the running last separator, tells each range how
many documents ended before it and where the document at its head began, so documents across any
number of ranges are stitched without reading a range again.

A file without a last separator ends with an unterminated document, if any ids are left; two
separators in a row hold an empty document; bytes at a file's end that are no whole id are left out.
Null and empty texts are empty documents. An empty table has no documents. Rows that repeat an id, or
have none, stay apart. Ties need no care, extra columns are not read. A very long text is encoded at
once, in a few times its size, and its file is read in ranges like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.llm.common import Encoder, id_text, parts, ship, slices, stored, tidy
from quernel.sources.files import open_root, walk

BLOCK_BYTES = 1 << 20


def write_flat(docs: DataFrame, encode: Encoder, end_id: int, root: str, dtype: str = "<u2") -> DataFrame:
    """Each input partition as one flat file below root, which all executors reach; returns the document
    ids in the files' order (file_id, ordinal, doc_id), which the scan doesn't use.

    A file has its name only when it is whole, so tasks that fail or run twice do no harm.
    """
    ship(docs.sparkSession)
    end = np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        name, ordinal, out = f"part-{TaskContext.get().partitionId():06d}.bin", 0, None
        unfinished = f"{base}/{name}.{uuid.uuid4().hex}"
        for batch in batches:
            for part in slices(batch):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(unfinished)
                out.write(b"".join(np.frombuffer(x, "<u4").astype(dtype).tobytes() + end for x in encode(part.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ordinal], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))], ["file_id", "first", "doc_ids"])
                ordinal += part.num_rows
        if out is not None:
            out.close()
            fs.move(unfinished, f"{base}/{name}")

    table = stored(id_text(docs).mapInArrow(tidy(run), "file_id string, first long, doc_ids array<long>"))
    ids = table.select("file_id", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
    return ids.select("file_id", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")


def ranges(spark: SparkSession, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file_id, block, begin, end, length): the byte ranges of the flat files below root."""
    files = walk(spark, root).where(F.col("path").endswith(".bin") & (F.col("length") > 0))
    blocks = files.select(F.col("path").alias("file_id"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))
    begin = F.col("block") * block_bytes
    return blocks.select("file_id", "block", begin.alias("begin"), F.least(begin + block_bytes, "length").alias("end"), "length")


def scan(spark: SparkSession, root: str, end_id: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file_id, ordinal, n_tokens, begin, terminated): each document's place in its file below root and
    its tokens without the end id."""
    ship(spark)
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        for batch in batches:
            for name, block, begin, end, length in zip(*(batch.column(i).to_pylist() for i in range(5))):
                # The ids that begin in the range, to the last one's end.
                lo, hi = (min(-(-x // width) * width, length // width * width) for x in (begin, end))
                with fs.open_input_file(f"{base}/{name}") as f:
                    ids = np.frombuffer(f.read_at(hi - lo, lo), dtype)
                at = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int32()))], ["file_id", "block", "n", "seps"])

    # Only the separators' places are kept, some bytes for each document.
    dealt = ranges(spark, root, block_bytes).repartition(parts(spark), "file_id", "block")
    found = stored(dealt.mapInArrow(tidy(run), "file_id string, block long, n long, seps array<int>"))
    w = Window.partitionBy("file_id").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("seps") > 0, F.col("base") + F.element_at("seps", -1))
    light = found.select("file_id", "block", "n", F.size("seps").alias("k"), F.when(F.size("seps") > 0, F.element_at("seps", -1)).alias("tail"))
    light = light.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    light = light.withColumn("last", F.col("base") + F.col("tail"))
    light = light.select("file_id", "block", "base", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("done"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open"))
    placed = found.join(light, ["file_id", "block"])
    ends = F.transform("seps", lambda x: F.col("base") + x)
    begins = F.concat(F.array(F.col("open") + 1), F.transform("ends", lambda x: x + 1))
    docs = placed.withColumn("ends", ends).withColumn("begins", begins).select("file_id", "done", F.posexplode(F.arrays_zip(F.slice("begins", F.lit(1), F.size("ends")).alias("begin"), F.col("ends").alias("end"))).alias("k", "x"))
    docs = docs.select("file_id", (F.col("done") + F.col("k")).alias("ordinal"), (F.col("x.end") - F.col("x.begin")).alias("n_tokens"), F.col("x.begin").alias("begin"), F.lit(True).alias("terminated"))
    whole = placed.groupBy("file_id").agg(F.sum("n").alias("n"), F.sum(F.size("seps")).alias("ordinal"), F.coalesce(F.max(last), F.lit(-1)).alias("last"))
    rest = whole.where(F.col("n") > F.col("last") + 1).select("file_id", F.col("ordinal").cast("long"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), (F.col("last") + 1).alias("begin"), F.lit(False).alias("terminated"))
    return docs.unionByName(rest)
