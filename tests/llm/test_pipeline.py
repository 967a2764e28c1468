"""The pipeline against the brute-force versions of its stages."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from quernel.llm import bpe, mixing, quality  # noqa: E402
from .test_dedup import brute_components, brute_cut, corpus  # noqa: E402
from .test_rules_and_mix import brute_counts  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    stops = quality.stop_words()
    rows = [(i, " ".join(w + (" " + rng.choice(stops) if k % 6 == 0 else "") for k, w in enumerate(t.split(" "))), "en", rng.choice(["a", "a", "b", None]), 0) for i, t in corpus(21, 90)]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    df = docs
    for name, stage in pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name.replace(" ", "_")))
        df = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        out[name] = df.collect()
        if name != pipeline.STAGES[-1][0]:
            assert df.columns == list(pipeline.COLUMNS)
    # Rules: the base by brute force, the verdict by the operator, which its own tests hold to SQL.
    verdict = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    kept = out["quality rules"]
    assert {r.doc_id for r in kept} == verdict and all(brute_counts(r.text)[0] >= 20 for r in kept)
    # Near copies: the least id of each component.
    groups = brute_components([(r.doc_id, r.text) for r in kept])
    alone = out["n-gram Jaccard join"]
    assert sorted(r.doc_id for r in alone) == sorted({c for _, c in groups.values()})
    # Passages: what is left, without the texts that lost everything.
    cut = {i: x[3].decode() for i, x in brute_cut([(r.doc_id, r.text) for r in alone]).items()}
    passages = out["suffix-array dedup"]
    assert {r.doc_id: r.text for r in passages} == {i: t for i, t in cut.items() if t.strip(" \t\n\x0b\x0c\r")} and all(r.n_chars == len(r.text) for r in passages)
    # Mix: whole documents, as often as the words taken say, up to one time.
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(spark.createDataFrame(passages, docs.schema)).collect()}
    times = collections.Counter(r.doc_id for r in out["mixing sources"])
    assert all(t // n <= times[i] <= -(-t // n) for i, (t, n) in taken.items() if n) and set(times) <= set(taken)
    # Ids: each row's.
    own = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((r.doc_id, own.encode_many(pa.array([r.text]))[0]) for r in out["mixing sources"])
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in out["BPE encoding and decoding"]) == want
    assert all(r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4")) for r in out["BPE encoding and decoding"])
    # run() does the same.
    assert pipeline.run(spark, str(tmp_path)).count() == sum(want.values())


def test_last_stage_decodes(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 64)
    texts = {1: "plain words here", 2: "é漢字😀 \t odd", 3: "<|endoftext|> tail", 4: "long " * 300, 5: ""}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    rows = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id: r.decoded for r in rows} == texts and len(rows) == len(texts)


def test_slices_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 10)
    monkeypatch.setattr(bpe, "SLICE_ROWS", 3)
    texts = ["a" * 4, "b" * 4, "c" * 4, "d" * 40, None, "", "e", "f", "é" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = [p.column(1).to_pylist() for p in bpe.slices(batch)]
    assert sum(got, []) == texts and all(len(g) == 1 or len(g) <= 3 and sum(len((t or "").encode()) for t in g) <= 10 for g in got)
    assert list(bpe.slices(batch.slice(0, 0))) == []


def edge_table(spark):
    """Nulls in every column, repeated rows and ids, a long text, and columns named as the stages' own."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and"]) if k % 4 == 0 else "".join(rng.choice("abcdefghij") for _ in range(6)) for k in range(n))
    a, b, long = prose(60), prose(70), prose(30_000)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (1, a), (None, a + " more"), (None, prose(50)), (None, None), (4, None), (5, ""), (6, " \n"), (7, long), (7, long), (8, prose(40))]
    rows = [(i, t, None if k % 2 else "en", [None, "s", ""][k % 3], None if k % 5 == 0 else 1) for k, (i, t) in enumerate(rows)]
    extra = {c: F.lit("clash") for c in ("key", "mark", "n", "size", "group", "component", "_own_mark_", "row", "id", "times", "decoded", "spans", "k", "taken")}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra).repartition(3)


def test_stages_on_edge_cases(spark, tmp_path):
    stages = dict(pipeline.STAGES)
    docs = edge_table(spark)
    rules = stages["quality rules"](spark, docs, "")
    assert rules.columns == list(pipeline.COLUMNS)
    assert collections.Counter((r.doc_id, r.text) for r in rules.collect()) == collections.Counter((r.doc_id, r.text) for r in docs.collect() if r.text and brute_counts(r.text)[0] >= 20)
    near = stages["n-gram Jaccard join"](spark, docs, "")
    got = collections.Counter((r.doc_id, r.text) for r in near.collect())
    # Groups: a with id 1, b with id 1, the long text, and what is alike to nothing.
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute_components([(k, t) for k, (_, t) in enumerate(texts)])
    want = collections.Counter()
    for c in {c for n, c in groups.values()}:
        members = [texts[k] for k, (n, x) in groups.items() if x == c]
        ids = [i for i, _ in members if i is not None]
        kept = [m for m in members if m[0] == (min(ids) if ids else None)]
        assert sum(got[m] for m in set(kept)) == 1 or groups[c][0] == 0
        want[c] = 1
    assert sum(got.values()) == len(want) and near.columns == list(pipeline.COLUMNS)
    cut = stages["suffix-array dedup"](spark, docs, "")
    left = [x[3].decode("utf-8", "ignore") for x in brute_cut([(k, t) for k, (_, t) in enumerate(texts) if (t or "") and len(t) < 100_000]).values()]
    assert sorted(r.text for r in cut.collect()) == sorted(t for t in left if t.strip(" \t\n\x0b\x0c\r")) and cut.columns == list(pipeline.COLUMNS)
    mix = stages["mixing sources"](spark, docs, "")
    times = collections.Counter((r.doc_id, r.text) for r in mix.collect())
    assert set(times) <= {(i, t) for i, t in texts if t and t.strip()} and mix.columns == list(pipeline.COLUMNS)
    assert (7, texts[[i for i, _ in texts].index(7)][1]) in times and any(i is None for i, _ in times)
    ids = stages["BPE encoding and decoding"](spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.decoded) for r in ids) == collections.Counter((i, t or "") for i, t in texts)


def test_stages_on_nothing(spark, tmp_path):
    none = edge_table(spark).limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    none.select(*pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
