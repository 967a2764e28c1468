import hashlib
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_texts():
    """Nulls, empty and blank texts, ties, repeated rows, odd characters, a long one."""
    rng = random.Random(7)
    base = words(rng, 300)
    near = base.split(" ")
    near[50] = near[200] = "changed"
    passage = words(random.Random(8), 70)
    return [
        None, "", " \n\t ", "one", "one two three four", "ONE two three four", base, base, " ".join(near), base.upper().replace("W", "w"),
        passage + "\n" + words(rng, 40), words(rng, 40) + " " + passage + " end", "aaaa" * 200, "ab" * 300, "é" * 150 + words(rng, 60) + "漢字😀",
        words(rng, 30) + " <|endoftext|> tail", "x" * 199, "y" * 200, "z" * 64, "\0 null \0", "Released under the MIT License.\n" + words(rng, 60), "a  b   c\n \n d \r\n e\x85f ", words(rng, 30_000, 5000),
    ]


@pytest.fixture(scope="session")
def edge_rows():
    sources = [None, "a", "b", "ü", ""]
    return [(i, t, "en" if i % 3 else None, sources[i % 5], None if t is None else len(t)) for i, t in enumerate(edge_texts())]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """With more columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("key", "n", "size", "target", "k", "shard", "spans", "whole", "score", "component", "row", "words", "block", "mark", "start", "ids", "h", "places")}
    return spark.createDataFrame(edge_rows, SCHEMA).withColumns(extra).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sha():
    return lambda b: hashlib.sha256(b).hexdigest()
