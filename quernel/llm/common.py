"""What the operators share: the documents table and Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.plans.shared import ship, shared_dir, stored

__all__ = ["Encoder", "documents", "encode_pieces", "id_text", "parts", "raw", "shared_dir", "runs", "ship", "slices", "spread", "stored", "tidy"]

#: Texts to the ids of each, little-endian 32 bits.
Encoder = Callable[[pa.Array], list[bytes]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): other columns, whatever their names, go; null texts are empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def parts(spark: SparkSession) -> int:
    """Partitions that a shuffle gets here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then what it freed goes back to the system: workers live on for other tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


def raw(column: pa.Array) -> list[memoryview]:
    """A string or binary column as buffers, without a copy; null is empty."""
    if len(column) == 0:
        return []
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = memoryview(bufs[2] if bufs[2] is not None else b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    at = offsets.tolist()
    return [data[at[i] : at[i + 1]] if valid is None or valid[i] else data[:0] for i in range(len(at) - 1)]


def spread(piece: np.ndarray, ids: list[bytes], cuts: np.ndarray) -> list[bytes]:
    """The ids of runs of pieces: ids holds those of each distinct piece, piece the distinct one at each
    place, cuts the bounds of the runs."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin = np.cumsum(size) - size
    n = size[piece]
    ends = np.cumsum(n)
    place = np.repeat(begin[piece] - (ends - n), n)
    place += np.arange(len(place))
    data = flat[place].tobytes()
    cut = np.concatenate([[0], ends])[cuts] * 4
    return [data[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]


def encode_pieces(texts: pa.Array, at: str, lookup: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Each text's ids (little-endian 32 bits) as those of its pieces between the character at.

    Pieces are numbered by Arrow, so that lookup sees each distinct piece of these texts once, and
    the ids are put together over arrays.
    """
    if len(texts) == 0:
        return []
    lists = pc.split_pattern(texts, at)
    coded = lists.flatten().dictionary_encode()
    cuts = np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy()]))
    return spread(coded.indices.to_numpy(), lookup(coded.dictionary.to_pylist()), cuts)


def runs(size: list[int], rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most rows items whose sizes are at most `most` together; a larger item is alone."""
    begin = held = 0
    for i, n in enumerate(size):
        if i > begin and (held + n > most or i - begin == rows):
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(size):
        yield begin, len(size)


def slices(batch: pa.RecordBatch, rows: int = 500, most: int = 1 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts, in the column, are `most` bytes at most together."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).tolist()
    for i, j in runs(size, rows, most):
        yield batch.slice(i, j - i)
