"""Quality by compression: dictionaries of good and of bad text, and the difference of the sizes they give.

Two zstandard dictionaries are trained, one on texts labelled good, one on texts labelled bad. A
text is compressed with each, in pieces so that it cannot serve as its own dictionary; the
difference of the sizes by its length goes through a logistic curve fitted on other labelled texts,
weighted to the labels' shares. The fit uses at most SAMPLE texts of each label, and of each the whole
or SAMPLE_PIECES pieces in equal steps from its beginning to its end; all texts are scored whole. A
dictionary is half as long as its sample, at most DICTIONARY_BYTES. Samples that zstandard refuses to
train on, as those of a handful of texts, are the dictionary themselves, as far as they fit in.

Null and empty texts have a difference of 0 and get the curve's value there. Without texts of both
labels the score is the share of good labels, or 0.5 without any. Rows are scored one by one, so
ties, repeated rows and empty tables need no care; only the id and the text are read. Labels count by
row; texts whose id the documents repeat are one sample. Labels without an id are not used. Documents
without an id are scored. A very long text is scored piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import id_text, raw, ship, tidy

#: Bounds of the fit: texts of each label, and pieces of each.
SAMPLE, SAMPLE_PIECES = 2000, 4
DICTIONARY_BYTES, PIECE, LEVEL = 65_536, 1024, 3


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


class Model:
    def __init__(self, good: list[bytes], bad: list[bytes], share: float | None):
        """share: of good labels among all."""
        self.share = 0.5 if share is None else share
        self.a, self.b = 0.0, _logit(self.share)
        if good and bad:
            # The curve is fitted on differences from dictionaries made without the text: each half's
            # texts by the other half's dictionaries, or by all where a half would be empty.
            x, y, w = [], [], []
            for k in (0, 1):
                self._use([_train(t[k::2] or t) for t in (good, bad)])
                for label, texts, part in ((1.0, good, self.share), (0.0, bad, 1 - self.share)):
                    own = texts[1 - k :: 2] or (texts if k == 0 else [])
                    x += map(self.difference, own)
                    y += [label] * len(own)
                    w += [part / len(texts)] * len(own)
            w = np.array(w)
            self.a, self.b = _logistic(np.array(x), np.array(y), w / w.mean())
        self._use([_train(x) for x in (good, bad)])

    def _use(self, dictionaries: list[bytes]) -> None:
        self.dictionaries = dictionaries
        self.__dict__.pop("_packers", None)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def packers(self) -> list:
        if "_packers" not in self.__dict__:
            self._packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False) for d in self.dictionaries]
        return self._packers

    def difference(self, text: memoryview | bytes) -> float:
        """How many bytes in each byte of text the good dictionary saves over the bad one."""
        if not len(text):
            return 0.0
        good, bad = (p.compress for p in self.packers())
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return (sum(len(bad(p)) for p in pieces) - sum(len(good(p)) for p in pieces)) / len(text)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * difference + self.b, -30, 30)))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _train(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 2)
    try:
        return zstandard.train_dictionary(size, pieces, k=64, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # What fits in of each piece, so that none is left out.
        part = DICTIONARY_BYTES // len(pieces) if pieces else 0
        return b"".join(x[:part] for x in pieces)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one value by Newton's method, slightly damped."""
    scale = float(np.std(x)) or 1.0
    m = np.stack([x / scale, np.ones(len(x))], 1)
    t, damp = np.zeros(2), np.diag([1e-3 * len(x), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ t, -30, 30)))
        grad = m.T @ (w * (y - p)) - damp @ t
        step = np.linalg.solve((m * (w * p * (1 - p))[:, None]).T @ m + damp + 1e-9 * np.eye(2), grad)
        t = t + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(t[0] / scale), float(t[1])


def sample(text: Column) -> Column:
    """A text's bytes, or SAMPLE_PIECES pieces of them in equal steps from the first to the last."""
    data, n = text.cast("binary"), F.octet_length(text)
    steps = [F.floor((n - PIECE) * k / (SAMPLE_PIECES - 1)).cast("int") for k in range(SAMPLE_PIECES)]
    return F.when(n <= SAMPLE_PIECES * PIECE, data).otherwise(F.concat(*(F.substring(data, at + 1, PIECE) for at in steps)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model from the labelled rows that aren't held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    counts = {r.y: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = {}
    for y in (1, 0):
        # At most SAMPLE ids: small enough to broadcast whatever the tables' sizes.
        chosen = rows.where(F.col("y") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        found = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", sample(F.col("text")).alias("text"))
        found = found.groupBy("doc_id").agg(F.min("text").alias("text"))
        texts[y] = [bytes(r.text) for r in sorted(found.collect(), key=lambda r: r.doc_id)]
    total = sum(counts.values())
    return Model(texts[1], texts[0], counts.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, difference, score) of each document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.difference(t) for t in raw(batch.column(1))], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(model.score(x))], ["doc_id", "difference", "score"])

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, difference double, score double")
