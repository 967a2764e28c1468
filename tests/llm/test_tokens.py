import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quernel.llm import bpe, flatscan, tokenfile  # noqa: E402

BYTE, WORD = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(3)
    alpha = "aab tThE  \n\n\t'sSé ñ12.,É́ΣİI<|endoftext|>\x1c漢字😀ﬁ　\xa0\0"
    return ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", " ", "  a", "a ", "a" * 500, "x<|endoftext|> y<|startoftext|>", "</w>", "I'LL don'T ΑΣ ΣΑΣ İstanbul", "abab" * 100]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoders_against_the_library(path):
    texts = odd_texts()
    own = bpe.load(path).encode_many(pa.array(texts)) if path == BYTE else tokenfile.words_encoder(path)(pa.array(texts))
    want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == want


def test_decoding_against_the_library():
    t, own = library(BYTE), bpe.load(BYTE)
    for x in odd_texts()[:500]:
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.decode(np.array(ids, "<u4").tobytes()).decode() == t.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([own.id_of[b"\xc3"]], "<u4").tobytes()).decode() == "�"


def test_borders_decide_merges():
    """compatible() says of any two tokens what merging their bytes says."""
    own, rng = bpe.load(BYTE), random.Random(5)
    own_ids = [t for t in (rng.randrange(50256) for _ in range(4000)) if own.merge(own.bytes_of[t]) == [t]]
    pairs = list(zip(own_ids[::2], own_ids[1::2]))
    got = own.compatible(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert got.tolist() == [own.merge(own.bytes_of[a] + own.bytes_of[b]) == [a, b] for a, b in pairs]


def test_long_words_merge_the_same():
    own, t = bpe.load(BYTE), library(BYTE)
    for w in ("a" * 301, "abaabbthethe" * 40, "nationalization" * 20):
        assert own.merge(w.encode()) == t.encode(w, add_special_tokens=False).ids


def test_digests(edge, edge_rows, none, sha):
    t = library(BYTE)
    got = {r.doc_id: r for r in bpe.digests(edge, BYTE).collect()}
    for i, x, *_ in edge_rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()))
    assert len(got) == len(edge_rows) and bpe.digests(none, BYTE).count() == 0
    full = bpe.encode_documents(edge, BYTE).collect()
    assert all(r.decoded == (edge_rows[r.doc_id][1] or "") for r in full)


def test_token_files(spark, edge, edge_rows, none):
    t, encode = library(WORD), tokenfile.words_encoder(WORD)
    got = tokenfile.round_trip(spark, edge, encode, 1).orderBy("doc_id").collect()
    start = 0
    for r, (i, x, *_) in zip(got, edge_rows, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.round_trip(spark, none, encode, 1).count() == 0


def test_repeated_ids_and_many_containers(spark, monkeypatch):
    rows = [(5, "b b"), (5, "a"), (5, "a"), (1, None), (9, "c " * 50)]
    encode = tokenfile.words_encoder(WORD)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokenfile.round_trip(spark, df, encode, 1).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 5, 5, 5, 9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_null_ids_come_first_and_stay_null(spark):
    rows = [(None, "b"), (-(1 << 63), "x y"), (None, "a"), (0, "c"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = tokenfile.round_trip(spark, df, tokenfile.words_encoder(WORD), 1).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, None, -(1 << 63), 0]
    assert sorted(r.n_tokens for r in got[:3]) == [1, 2, 2] and [r.n_tokens for r in got[3:]] == [3, 2]


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(tokenfile, "PIECE", 20)
    monkeypatch.setattr(tokenfile, "BATCH", 50)
    texts = [" ".join(odd_texts()[i : i + 30]) for i in range(0, 1500, 30)]
    want = [e.ids for e in library(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenfile.words_encoder(WORD)(pa.array(texts))] == want


def test_contractions_as_the_library_cuts_them():
    texts = ["don't", "we'll've", "''s", "\"'s", "'s's", "a'", "'re1", "'dd", "I'LL", "x'm'", "'", "3's", "é's", "'l", "'v", "'r e"]
    want = [e.ids for e in library(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenfile.words_encoder(WORD)(pa.array(texts))] == want


def test_the_sample_reaches_the_end_of_long_texts(spark):
    encode = tokenfile.words_encoder(WORD)
    text = "head " * 40_000 + "tail " * 2000
    df = spark.createDataFrame([(1, text), (1, text), (2, "short"), (None, "none")], "doc_id long, text string")
    tail = encode(pa.array(["tail"]))[0][:2]
    samples = tokenfile._samples(df, encode, False)
    assert len(samples) == tokenfile.SAMPLE_RUNS + 1 and max(map(len, samples)) == tokenfile.RUN_BYTES
    assert any(tail in x for x in samples)


def test_containers_refuse_another_dictionary():
    frame = tokenfile.pack([3], [2], [b""], tokenfile.digest_of(b"x"), False)
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfile.Container(frame, b"y")
    with pytest.raises(ValueError, match="not a token container"):
        tokenfile.Container(b"?" * 80, b"x")


def test_dictionary_is_trained_and_used(spark):
    """On a small table too."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(400))) for i in range(120)], "doc_id long, text string")
    encode = tokenfile.words_encoder(WORD)
    dictionary = tokenfile.train(df, encode)
    assert dictionary[:4] == b"\x37\xa4\x30\xec"
    boxes = tokenfile.write(df, encode, None, dictionary)
    box = tokenfile.Container(boxes.orderBy("shard", "seq").first().container, dictionary)
    assert box.ids(3) == encode(pa.array([df.where("doc_id = 3").first().text]))[0]


@pytest.mark.parametrize("block", [2, 3, 7, 64, 1 << 20])
def test_flat_scan(spark, edge, edge_rows, tmp_path, block):
    """Ranges may end anywhere, also within an id: one of two bytes holds no whole document."""
    small = edge.where("length(coalesce(text, '')) < 700")
    root = f"file://{tmp_path}/flat"
    ids = flatscan.write_flat(small, bpe.plain_encoder(BYTE), 50256, root)
    got = flatscan.scan(spark, root, 50256, block_bytes=block).join(ids, ["file_id", "ordinal"]).collect()
    own = bpe.load(BYTE)
    want = {i: len(own.encode_many(pa.array([x or ""]), special=False)[0]) // 4 for i, x, *_ in edge_rows if len(x or "") < 700}
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)


def test_flat_files_without_an_end(spark, tmp_path):
    np.array([7, 7, 0, 0, 5], "<u2").tofile(tmp_path / "a.bin")
    np.array([0], "<u2").tofile(tmp_path / "b.bin")
    np.array([1, 2, 3], "<u2").tofile(tmp_path / "c.bin")
    with open(tmp_path / "c.bin", "ab") as f:
        f.write(b"x")  # half an id
    (tmp_path / "d.bin").write_bytes(b"")
    (tmp_path / "part-1.bin.unfinished").write_bytes(b"1234")
    for size in (2, 3, 4, 100):
        rows = flatscan.scan(spark, str(tmp_path), 0, block_bytes=size).collect()
        got = sorted((r.file_id[-5], r.ordinal, r.n_tokens, r.begin, r.terminated) for r in rows)
        assert got == [("a", 0, 2, 0, True), ("a", 1, 0, 3, True), ("a", 2, 1, 4, False), ("b", 0, 0, 0, True), ("c", 0, 3, 0, False)]


def test_wide_ids(spark, tmp_path):
    np.array([70_000, 9, 0, 1, 0], "<u4").tofile(tmp_path / "a.bin")
    for size in (1, 5, 100):
        rows = flatscan.scan(spark, str(tmp_path), 0, "<u4", size).collect()
        assert sorted((r.ordinal, r.n_tokens) for r in rows) == [(0, 2), (1, 1)]


def test_flat_scan_of_nothing_and_of_repeated_ids(spark, none, tmp_path):
    roots = [f"file://{tmp_path}/{k}" for k in range(2)]
    ids = flatscan.write_flat(none, bpe.plain_encoder(BYTE), 50256, roots[0])
    assert ids.count() == 0
    (tmp_path / "0").mkdir(exist_ok=True)
    assert flatscan.scan(spark, roots[0], 50256).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a"), (None, None), (1, "c d e")], "doc_id long, text string")
    ids = flatscan.write_flat(rows, bpe.plain_encoder(BYTE), 50256, roots[1])
    got = flatscan.scan(spark, roots[1], 50256).join(ids, ["file_id", "ordinal"]).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (0, 2), (1, 1), (1, 1), (1, 3)]
