"""Token ids in binary containers, each document compressed apart with one shared dictionary.

A container holds documents in ascending id order:

    8 bytes   magic "QTOK0002"
    32 bytes  sha256 of the zstandard dictionary (zeros: none)
    8 bytes   number of documents n, little-endian as all that follows
    8 bytes   1 where ids take 32 bits, 0 where 16
    8 bytes   number m of documents without an id, which come first
    8 n       document ids, signed; 0 for the first m
    8 n       tokens of each document
    8 (n+1)   offsets of the frames from the end of this index
    ...       frames: zstandard, each the document's ids as unsigned 16 bits, or 32

So one document is read with the index and its own frame alone. Containers are rows of a Parquet
table (shard, seq, container), in which (shard, seq) ascends with the document id; the dictionary
is a table of one row. Spark's committed writer makes them safe against lost executors.

The dictionary is trained on a bounded sample of documents, whatever the table's size: SAMPLE_DOCS of
them, and of each SAMPLE_RUNS runs spread over the whole text.

Null and empty texts hold only the end id. Documents with a null id come first, ordered by text, and
are read back with a null id. Rows that repeat an id stand side by side, ordered by text; none is
merged. An empty table gives empty tables and the empty dictionary, as does a sample too small to
train on. A very long text takes a few times its own size in one worker. Extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.llm.common import Encoder, id_text, parts, runs, ship, slices, spread, stored, tidy

MAGIC = b"QTOK0002"
#: Bounds of the sample that the dictionary is trained on: documents, runs of each, bytes of a run.
SAMPLE_DOCS, SAMPLE_RUNS, RUN_BYTES = 1000, 16, 2048
#: A dictionary's greatest and least length.
DICTIONARY_BYTES, LEAST_BYTES = 65_536, 1024
#: A container is closed at this size.
CONTAINER_BYTES = 4 << 20
#: Entries of each worker's table of known words.
KNOWN = 800_000
#: Rows and bytes of text that are encoded at a time; a longer text goes alone.
SLICE_ROWS, SLICE_BYTES = 10_000, 8 << 20
#: Characters of a long text that are cut at once, about, and of texts that are.
PIECE, BATCH = 1 << 18, 1 << 22
#: The pattern by which the scheme cuts a text, and the contractions in it.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_BLANK = regex.compile("[ \n]")
#: Characters whose lower case may depend on their place or be longer.
_ODD = regex.compile("[\u03a3\u0130]")


SPACE, LETTER, NUMBER, OTHER = range(4)


def _classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point, as the scheme's pattern has them."""
    out = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = kind
    return out


class Words:
    """A tokenizers file whose scheme drops white space and marks the ends of words.

    Normalised text is cut into pretokens over arrays of code points: runs of letters, single
    digits, runs of other characters, and the contractions after an apostrophe. Arrow numbers the
    pretokens of many texts, each distinct one goes through the library once, many to a call, and
    ids that end a word tell where the next begins. Calls whose words don't come out even go
    through the library word by word, and texts that more than lower case may change go through it
    as they are, in runs cut at blanks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PRETOKEN:
            raise ValueError("the file's pretokens are not those that are cut here")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.classes = _classes()
        self.known: dict[str, bytes] = {}

    def _single(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(part) or (len(at) and at[-1] != len(ids)):
                self.known.update(zip(part, self._single(part)))
                continue
            data, at = ids.tobytes(), (4 * at).tolist()
            self.known.update((w, data[i:j]) for w, i, j in zip(part, [0, *at], at))

    def _plain(self, text: str) -> bool:
        """Whether lower case alone normalises a text."""
        if "<|" in text and any(t in text for t in self.added):
            return False
        return text.isascii() or (unicodedata.is_normalized("NFC", text) and not _ODD.search(text))

    def words(self, words: list[str]) -> list[bytes]:
        """ids of distinct pretokens."""
        if len(self.known) > KNOWN:
            self.known = {}
        self._learn([w for w in words if w not in self.known])
        return list(map(self.known.__getitem__, words))

    def _cut(self, text: str) -> tuple[np.ndarray, pa.StringArray]:
        """Where in a text in lower case the pretokens begin, by code points, and the pretokens."""
        u = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.classes[u]
        new = np.ones(len(u), bool)
        new[1:] = kind[1:] != kind[:-1]
        new |= kind == NUMBER
        # An apostrophe that other characters don't lead begins a contraction, if one follows.
        for at in np.flatnonzero((u == ord("'")) & new).tolist():
            for end in _CONTRACTIONS:
                if text.startswith(end, at + 1):
                    new[at + 1] = False
                    after = at + 1 + len(end)
                    if after < len(u) and kind[after] == LETTER:
                        new[after] = True
                    break
        dense = np.flatnonzero(kind)
        u, first = u[dense], np.flatnonzero(new[dense])
        data = u.tobytes().decode("utf-32-le").encode()
        at = first
        if len(data) != len(u):
            width = np.ones(len(u) + 1, np.int64)
            width[0] = 0
            for bound in (0x80, 0x800, 0x10000):
                width[1:] += u >= bound
            at = np.cumsum(width)[first]
        offsets = np.append(at, len(data)).astype(np.int32)
        return dense[first], pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))

    def _batch(self, texts: list[str]) -> list[bytes]:
        """ids of plain texts."""
        begins, words = self._cut("\n".join(texts).lower())
        coded = words.dictionary_encode()
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return spread(coded.indices.to_numpy(), self.words(coded.dictionary.to_pylist()), np.searchsorted(begins, bounds))

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """ids of each text, little-endian 32 bits each."""
        # Pieces of texts, cut at blanks where a text is long; a text's ids are those of its pieces.
        pieces, owner = [], []
        for i, text in enumerate(texts.to_pylist()):
            at = 0
            while len(text) - at > PIECE and (blank := _BLANK.search(text, at + PIECE)):
                pieces.append(text[at : blank.start()])
                at = blank.start()
            pieces.append(text[at:] if at else text)
            owner += [i] * (len(pieces) - len(owner))
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        plain = list(map(self._plain, pieces))
        for a, b in runs(list(map(len, pieces)), len(pieces), BATCH):
            ids = iter(self._batch([p for p, ok in zip(pieces[a:b], plain[a:b]) if ok]))
            for i, p, ok in zip(owner[a:b], pieces[a:b], plain[a:b]):
                out[i].append(next(ids) if ok else self._single([p])[0])
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


_words: dict[str, Words] = {}


def words_encoder(path: str) -> Encoder:
    def encode(texts: pa.Array) -> list[bytes]:
        if path not in _words:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _words[path] = Words(path)
        return _words[path].encode_many(texts)

    return encode


def _narrow(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _widen(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _zdict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _samples(docs: DataFrame, encode: Encoder, wide: bool) -> list[bytes]:
    """Serialised ids of the SAMPLE_DOCS documents with the least hash of their id: of each the whole,
    or SAMPLE_RUNS runs of RUN_BYTES in equal steps from its first id to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                    data = _narrow(ids, wide)
                    steps = min(SAMPLE_RUNS, -(-len(data) // RUN_BYTES))
                    width = 4 if wide else 2
                    for k in range(steps):
                        at = (len(data) - RUN_BYTES) * k // (steps - 1) // width * width if steps > 1 else 0
                        out.append((i, data[at : at + RUN_BYTES]))
                ids, data = zip(*out) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "data"])

    # The ids first, which are small to sort; at most SAMPLE_DOCS of them are broadcast.
    chosen = id_text(docs).select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id")
    # Of rows that repeat an id one stands for all, so that the sample stays bounded.
    mark = F.xxhash64("text").alias("mark")
    first = rows.groupBy("doc_id").agg(F.min(mark).alias("first"))
    rows = rows.withColumn("mark", mark).join(F.broadcast(first), "doc_id").where("mark = first").dropDuplicates(["doc_id"]).select("doc_id", "text")
    return [bytes(r.data) for r in sorted(rows.mapInArrow(tidy(run), "doc_id long, data binary").collect(), key=lambda r: (r.doc_id, bytes(r.data)))]


def train(docs: DataFrame, encode: Encoder, wide: bool = False) -> bytes:
    """A dictionary trained on a bounded sample of ids: an eighth as long as the sample, at most
    DICTIONARY_BYTES; none where the sample is too small to train on."""
    ship(docs.sparkSession)
    samples = _samples(docs, encode, wide)
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes() if size >= LEAST_BYTES else b""
    except zstandard.ZstdError:  # too few or too uniform samples
        return b""


def pack(doc_ids: list[int | None], n_tokens: list[int], frames: list[bytes], digest: bytes, wide: bool) -> bytes:
    """A container; documents without an id come first."""
    at = np.cumsum([0, *map(len, frames)]).astype("<i8")
    head = MAGIC + digest + struct.pack("<qqq", len(doc_ids), int(wide), doc_ids.count(None))
    return b"".join([head, np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array(n_tokens, "<i8").tobytes(), at.tobytes(), *frames])


class Container:
    """Reads a container; documents by position."""

    def __init__(self, data: bytes, dictionary: bytes):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token container")
        if bytes(data[8:40]) != digest_of(dictionary):
            raise ValueError("the container was written with another dictionary")
        n, wide, self.nameless = struct.unpack_from("<qqq", data, 40)
        self.data, self.wide, self.end = memoryview(data), bool(wide), 64 + 24 * n + 8
        self.doc_ids, self.n_tokens = (np.frombuffer(data, "<i8", n, 64 + 8 * n * k) for k in range(2))
        self.at = np.frombuffer(data, "<i8", n + 1, 64 + 16 * n)
        self.reader = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> bytes:
        """ids of document k, little-endian 32 bits each."""
        return _widen(self.reader.decompress(self.data[self.end + int(self.at[k]) : self.end + int(self.at[k + 1])]), self.wide)


def digest_of(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest() if dictionary else bytes(32)


def write(docs: DataFrame, encode: Encoder, end_id: int | None, dictionary: bytes, wide: bool = False) -> DataFrame:
    """The containers of all documents as a stored table (shard, seq, n_tokens, container)."""
    spark = docs.sparkSession
    ship(spark)
    tail = b"" if end_id is None else struct.pack("<I", end_id)
    digest = digest_of(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, size = TaskContext.get().partitionId(), 0, 0
        packer = zstandard.ZstdCompressor(level=1, dict_data=_zdict(dictionary))
        doc_ids, counts, frames = [], [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(counts)], pa.int64()), pa.array([pack(doc_ids, counts, frames, digest, wide)], pa.binary())], ["shard", "seq", "n_tokens", "container"])

        for batch in batches:
            for part in slices(batch, SLICE_ROWS, SLICE_BYTES):
                for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                    ids += tail
                    doc_ids.append(i)
                    counts.append(len(ids) // 4)
                    frames.append(packer.compress(_narrow(ids, wide)))
                    size += len(frames[-1])
                    if size >= CONTAINER_BYTES:
                        yield close()
                        doc_ids, counts, frames, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield close()

    rows = id_text(docs)
    rows = rows.repartitionByRange(parts(spark), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return stored(rows.mapInArrow(tidy(run), "shard int, seq int, n_tokens long, container binary"))


def read(containers: DataFrame, dictionary: bytes) -> DataFrame:
    """(shard, seq, doc_id, start, n_tokens, ids_crc32) of each stored document, from the containers;
    start counts all ids of the documents before it."""
    ship(containers.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                box = Container(data, dictionary)
                ids = (box.ids(k) for k in range(len(box)))
                n, crc = zip(*((len(x) // 4, zlib.crc32(x)) for x in ids))
                start = np.cumsum([0, *n[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.int32()), pa.array([seq] * len(n), pa.int32()), pa.array(box.doc_ids.astype(np.int64), mask=np.arange(len(n)) < box.nameless), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = containers.select("shard", "seq", "container").mapInArrow(tidy(run), "shard int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Sums within a shard, then over the shards, of which there are as many as partitions.
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = containers.select("shard", "seq", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(upto(Window.orderBy("shard"))), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n_tokens").over(upto(Window.partitionBy("shard").orderBy("seq"))), F.lit(0))
    starts = sizes.withColumn("inner", inner).join(shards, "shard").select("shard", "seq", (F.col("before") + F.col("inner")).alias("base"))
    return docs.join(starts, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "seq")


def round_trip(spark: SparkSession, docs: DataFrame, encode: Encoder, end_id: int) -> DataFrame:
    dictionary = train(docs, encode)
    return read(write(docs, encode, end_id, dictionary), dictionary)
