import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import classify, licenses, media
from quernel.llm.textkernel import _mark, shingles, word_hashes


def test_licenses_in_documents(edge, edge_rows, none):
    got = {r.doc_id: r for r in licenses.scan(edge).collect()}
    assert len(got) == len(edge_rows) and licenses.scan(none).count() == 0
    for i, t, *_ in edge_rows:
        assert (got[i].best_template == "mit-line") == ("MIT License" in (t or "")) and got[i].n_matches == len(got[i].matches)


def brute(text, templates):
    """Templates of which any window of their own length holds three quarters."""
    h, out = shingles(word_hashes(text, _mark), 5), {}
    for name, t in templates.items():
        s = set(shingles(word_hashes(t.encode(), _mark), 5).tolist())
        out[name] = max((len(s & set(h[k : k + len(s)].tolist())) / len(s) for k in range(max(1, len(h) - len(s) + 1))), default=0) if len(h) else 0
    return {n for n, share in out.items() if share >= 0.75}


def test_scan_against_brute_force():
    rng = random.Random(2)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for _ in range(150):
        name = rng.choice(scanner.names)
        t = licenses.TEMPLATES[name].split()
        for _ in range(rng.randint(0, 1 + len(t) // 25)):
            t[rng.randrange(len(t))] = "other"
        filler = lambda: " ".join(f"f{rng.randrange(999)}" for _ in range(rng.randint(0, 200)))
        text = f"{filler()} {' '.join(t)}, {filler()}".encode()
        got = {scanner.names[j] for j, *_ in scanner.scan(text)}
        assert got >= brute(text, licenses.TEMPLATES)
        for j, share, first, n in scanner.scan(text):
            assert share >= 0.75 and n <= 3 * len(scanner.sets[j]) + 20


def test_scan_across_segments(monkeypatch):
    monkeypatch.setattr(licenses, "SEGMENT", 64)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for pad in range(40, 90, 7):
        text = ("x y z " * pad + licenses.TEMPLATES["bsd-conditions"] + " q" * 50).encode()
        (found,) = [x for x in scanner.scan(text) if scanner.names[x[0]] == "bsd-conditions"]
        assert found[1] == 1.0 and found[2] == 3 * pad


def test_templates_below_a_shingle(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(f"f{rng.randrange(999)}" for _ in range(n))
    texts = [f"{filler(3000)} Copyright. ALL rights\nreserved! {filler(2000)}", "All rights reserved.", f"{filler(50)} all rights are reserved {filler(50)}", "rights reserved", f"{filler(9)} Released under the MIT License. All rights reserved."]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [[m.template for m in got[i].matches] for i in range(5)] == [["all-rights-reserved"], ["all-rights-reserved"], [], [], ["all-rights-reserved", "mit-line"]]
    assert (got[0].matches[0].containment, got[0].matches[0].first_word, got[0].matches[0].n_words) == (1.0, 3001, 3)
    assert got[4].best_template == "mit-line"
    scanner = licenses.Scanner({str(n): " ".join("abcdef"[:n]) for n in range(1, 7)})
    assert [scanner.names[j] for j, *_ in scanner.scan(b"x x a b c d x")] == ["1", "2", "3", "4"]
    with pytest.raises(ValueError, match="no words"):
        licenses.Scanner({"blank": " . "})


def test_too_many_templates():
    with pytest.raises(ValueError, match="at most"):
        licenses.Scanner({str(i): "a b c d e f" for i in range(licenses.MOST_TEMPLATES + 1)})


def labelled(spark, n=600):
    rng = random.Random(5)
    good = ["river", "stone", "morning", "because", "under", "whether", "light", "small", "they", "walked"]
    rows = []
    for i in range(n):
        y = i % 3 != 0
        w = [rng.choice(good) + str(rng.randrange(30)) if y else rng.choice("xyz") * rng.randint(2, 5) + rng.choice(["%%", "##", "|"]) for _ in range(rng.randint(20, 120))]
        rows.append((i, " ".join(w), int(y)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(10**6, 1), (None, 0), (3, None)], "doc_id long, quality int"), {i: y for i, _, y in rows}


def test_classifier_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    rows = classify.score(docs, classify.fit(docs, labels)).withColumn("held_out", classify.held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    held = [r for r in rows if r.held_out]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97


def test_classifier_edges(spark, edge, edge_rows, none):
    docs, labels, _ = labelled(spark, 90)
    model = classify.fit(docs, labels)
    got = classify.score(edge, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got) and classify.score(none, model).count() == 0
    for y, share in ((labels.where("quality = 1"), 1.0), (labels.where("false"), 0.5)):
        assert classify.score(edge, classify.fit(docs, y)).first().score == pytest.approx(share, abs=1e-5)


def test_streams_are_lossless(edge, edge_rows, none, sha):
    got = {r.doc_id: r for r in media.read(media.write(edge)).collect()}
    for i, t, *_ in edge_rows:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha(p), zlib.crc32(p[-64:]))
        assert r.media_bytes % 188 == 0 and "lost=0" in r.feature and f"units={-(-len(p) // media.UNIT)};" in r.feature
    assert got[6].feature == got[7].feature and media.read(media.write(none)).count() == 0
    full = media.read(media.write(edge)).collect()
    assert all(bytes(r.payload) == media.payload_of((edge_rows[r.doc_id][1] or "").encode()) for r in full)
    assert all([u.pts for u in r.units] == [media.TICKS * k for k in range(len(r.units))] and r.units[0].random_access for r in full)


def test_every_length():
    for n in [*range(0, 420, 7), 4032, 4095, 4096, 4097, 4160, 4096 * 8, 4096 * 8 + 64, 4096 * 17 + 5]:
        p = media.payload_of(bytes(i * 7 % 251 for i in range(n)))
        q, pts, at, rap, counts = media.demux(media.mux(p))
        assert q == p and counts["lost"] == 0 and rap.tolist() == [k % media.RAP == 0 for k in range(len(pts))]


def test_damage_is_seen():
    m = np.frombuffer(media.mux(media.payload_of(b"x" * 9000)), np.uint8).copy().reshape(-1, 188)
    assert media.demux(np.delete(m, 10, axis=0).tobytes()[:])[4]["lost"] == 1
    bad = m.copy()
    bad[0, 12] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        media.demux(bad.tobytes())
    bad = m.copy()
    bad[5, 0] = 0
    with pytest.raises(ValueError, match="sync"):
        media.demux(bad.tobytes())
    with pytest.raises(ValueError, match="missing"):
        media.demux(m[1:].tobytes())


def test_checksum_of_sections():
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def packet(pid, body=b"", start=False, counter=0, field=None):
    """A transport packet; without a body it has no payload."""
    n = 184 - len(body)
    if field is None and n:
        field = b"\0" * (n > 1)
    fill = b"" if field is None else bytes([n - 1]) + field.ljust(n - 1, b"\xff")
    control = (0x20 if fill else 0) | (0x10 if body else 0)
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, control | counter & 15]) + fill + body


def foreign():
    """A stream of another writer's: a network entry, two programs, a table over two packets, a stream
    whose units have no length, one no time, with a packet sent twice and one without a payload."""
    def section(table, number, body):
        return media._section(table, number, body)

    pat = section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p in ((0, 0x10), (5, 0x20), (6, 0x21))))
    info = b"\x05\x10" + b"i" * 16
    entry = lambda kind, pid, extra=b"": bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(extra)).to_bytes(2, "big") + extra
    long_ = section(2, 5, (0xE000 | 0x31).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info + entry(0x1B, 0x31, b"d" * 200) + entry(0x0F, 0x32))
    other = section(2, 6, b"\xe0\x41\xf0\x00" + entry(0x06, 0x41))
    pad = lambda x: x.ljust(184, b"\xff")
    time = bytes([0x21, 0, 1, 0, 0x15])  # 10
    one = b"\0\0\1\xe0\0\0\x80\x80\5" + time + bytes(range(170))
    two = b"\0\0\1\xe0\0\0\x80\0\0" + b"second"
    data = [
        packet(0, pad(b"\0" + pat), True), packet(0x20, (b"\0" + long_)[:184], True), packet(0x20, pad((b"\0" + long_)[184:]), counter=1), packet(0x21, pad(b"\0" + other), True),
        packet(0x31, b"late", counter=4), packet(0x31, one, True, 5, None), packet(0x32, b"\0\0\1\xc0\0\4abcd", True, 9),
        packet(0x31, counter=5), packet(0x31, b"rest", counter=6), packet(0x31, b"rest", counter=6), packet(0x31, two, True, 7, b"\x40"), packet(0x1FFF, b"\xff" * 184),
    ]
    return b"".join(data), bytes(range(170)) + b"rest" + b"second"


def test_streams_of_other_writers():
    data, want = foreign()
    payload, pts, at, rap, n = media.demux(data)
    assert payload == want and pts.tolist() == [10, -1] and at.tolist() == [0, 174] and rap.tolist() == [False, True]
    assert (n["program"], n["type"], n["streams"], n["lost"], n["repeated"]) == (5, 0x1B, 3, 0, 1)
    lost = media.demux(data[: 188 * 8] + data[188 * 10 :])[4]["lost"]
    assert lost == 1
    with pytest.raises(ValueError, match="no program"):
        media.demux(data, 0x99)


def test_scores_by_hand(spark):
    """Sizes, differences and the curve again, without the operator's code."""
    docs, labels, _ = labelled(spark, 120)
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(5000, None), (None, "good words " * 400), (5001, "")], "doc_id long, text string").select(*(c if c in ("doc_id", "text") else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns)))
    model = classify.fit(docs, labels)
    import math

    import zstandard

    def size(text, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary)
        c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[k : k + 1024])) for k in range(0, len(text), 1024))

    for r in docs.select("doc_id", "text").join(classify.score(docs, model), "doc_id").collect():
        t = (r.text or "").encode()
        d = (size(t, model.dictionaries[1]) - size(t, model.dictionaries[0])) / len(t) if t else 0.0
        assert r.difference == pytest.approx(d) and r.score == pytest.approx(1 / (1 + math.exp(-min(max(model.a * d + model.b, -30), 30))))
    assert classify.score(docs, model).count() == docs.count()


def test_samples_reach_the_end_of_long_texts(spark):
    texts = ["a" * 50_000 + "z" * 2000, "short", "b" * 4096, "é" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.s) for r in df.select("doc_id", classify.sample(F.col("text")).alias("s")).collect()}
    assert got[0] == b"a" * 3072 + b"z" * 1024 and got[1] == b"short" and got[2] == b"b" * 4096 and len(got[3]) == 4096


def test_dictionaries_of_few_texts():
    """Trained where zstandard can; else all pieces have a part in it."""
    rng = np.random.default_rng(1)
    many = [bytes(rng.choice(list(b"abcdef "), 900)) for _ in range(40)]
    assert classify._train(many)[:4] == b"\x37\xa4\x30\xec"
    assert classify._train([b"one", b"two"]) == b"onetwo" and classify._train([]) == b""


def test_templates_from_a_table(spark):
    rows = spark.createDataFrame([("own", "the quick brown fox jumps over"), ("other", "pack my box with five dozen jugs")], "name string, text string")
    docs = spark.createDataFrame([(1, "say the quick brown fox jumps over it"), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: r.best_template for r in licenses.scan(docs, licenses.templates(rows)).collect()}
    assert got == {1: "own", 2: None}
    with pytest.raises(ValueError, match="two texts"):
        licenses.templates(rows.unionByName(rows))
