import collections
import os
import random
import re

import duckdb
import pytest

from quernel.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = set()
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            hit.update(range(k, k + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules(edge, edge_rows, none):
    got = {r.doc_id: r for r in quality.judge(edge).collect()}
    for i, t, *_ in edge_rows:
        r, n = got[i], brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    assert len(got) == len(edge_rows) and quality.judge(none).count() == 0


def test_rules_on_repeats(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        w = [rng.choice("abc") for _ in range(rng.randint(5, 60))]
        texts.append(rng.choice([" ", "\n"]).join(w))
    texts += ["a b c d e f g h " * 2, "a\na\n \n\nb", "# % word|"]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[i]) for i, r in got.items())


def test_rules_are_one_projection(edge):
    plan = quality.judge(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_kept_documents_are_whole(edge):
    kept = quality.keep(edge)
    assert kept.columns == edge.columns and kept.count() == quality.judge(edge).where("kept").count()


def brute_seats(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_apportionment(spark):
    rng = random.Random(3)
    for seats in (0, 1, 7, 100, 1237):
        weights = [float(rng.choice([0, 1, 1, 5, 50, rng.randint(1, 1000)])) for _ in range(rng.randint(1, 30))] + [1.0]
        df = spark.createDataFrame([("g", i, w, seats) for i, w in enumerate(weights)], "g string, k int, w double, seats long")
        got = [r.won for r in mixing.apportion(df, ["g"], "k", "w", "seats").orderBy("k").collect()]
        assert got == brute_seats(weights, seats)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rest, w = total - sum(target.values()), sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / w >= 2 * sizes[s]]
        if not full:
            target |= {s: rest * weight[s] / w for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    return target


def test_mix(edge, edge_rows, none):
    got = mixing.mix(edge).collect()
    assert len(got) == len(edge_rows) and mixing.mix(none).count() == 0
    size, by = {}, collections.Counter()
    for i, t, _, s, _ in edge_rows:
        size[i] = len(WORD.findall(t or ""))
        by[s] += size[i]
    target = brute_targets(by)
    for r in got:
        s = edge_rows[r.doc_id][3]
        assert r.size == size[r.doc_id] and r.source_size == by[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
    assert sorted(map(tuple, mixing.mix(edge).collect())) == sorted(map(tuple, got))


def test_sources_come_near_their_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 900), rng.choice("aaaaaaabcdef")) for i in range(3000)]
    taken, target = collections.Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[rows[r.doc_id][2]] += r.taken
        target[rows[r.doc_id][2]] = r.target
    assert all(abs(taken[s] / target[s] - 1) < 0.01 for s in target)


def test_tiny_sources_beside_a_huge_one(spark, monkeypatch):
    sizes = {"a": 2_000_000, "b": 1, "c": 31, "d": 64, "e": 5000, "f": 2000, "g": 90_000}
    rows, rng = [], random.Random(9)
    for s, n in sizes.items():
        while n:
            k = min(n, rng.randint(1, 20 + n // 20))
            rows.append((len(rows), "w " * k, s))
            n -= k
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (64, 4096):  # as of a small corpus, and of a very large one
        monkeypatch.setattr(mixing, "LEAST", least)
        for share in (1.5, 0.3):
            taken, target = collections.Counter(), {}
            for r in mixing.mix(df, share=share).collect():
                assert 0 <= r.taken <= 2 * r.size
                taken[rows[r.doc_id][2]] += r.taken
                target[rows[r.doc_id][2]] = r.target
            assert all(abs(taken[s] - target[s]) <= max(0.04 * target[s], 1) for s in sizes), (least, share, taken, target)


def test_repeated_ids_are_taken_apart(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (1, None, "x"), (None, "a", None)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert sorted(r.size for r in rows) == [0, 1, 3, 3] and all(r.taken <= 2 * r.size for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for got, sql in ((mixing.mix(docs), mixing.sql()), (quality.judge(docs), quality.sql())):
        a, b = got.toPandas(), db.execute(sql).df()
        cols = sorted(b.columns)
        assert cols == sorted(a.columns)
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
        assert a.equals(b)


def test_mix_against_sql(spark, tmp_path):
    """Large and small sources together, null ones and texts without words."""
    rng = random.Random(15)
    rows, i = [], 0
    for source, words in (("big", 40_000), ("mid", 9000), ("tiny", 10), ("tiny2", 25), ("tiny3", 40), (None, 700), ("one", 1), ("zero", 0)):
        left = words
        while left >= 0:
            n = min(left, rng.randint(1, 300))
            rows.append((i, "w " * n if n else rng.choice([None, "", " \n"]), "en", source, 0))
            i, left = i + 1, left - n if n else -1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in db.execute(f"SELECT doc_id, size, source_size, target, taken, weight, block FROM ({mixing.sql()})").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken, r.weight, r.block) for r in mixing.mix(df).collect()}
    assert got.keys() == want.keys() and all(got[k][:2] + got[k][3:] == want[k][:2] + want[k][3:] and got[k][2] == pytest.approx(want[k][2]) for k in got)
    taken, target = {}, {}
    for k, _, _, source, _ in rows:
        taken[source] = taken.get(source, 0) + got[k][3]
        target[source] = got[k][2]
    assert all(abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]) for s in taken)


def test_a_heading_that_comes_back_rejects_no_text(spark):
    prose = " ".join(f"the word{k} of" for k in range(40))
    rows = [(1, f"Heading\n{prose}\nHeading"), (2, "\n".join([" ".join(f"the {w}{k}" for k in range(7)) for w in "ab"] * 3 + [prose[:40]]))]
    got = {r.doc_id: r.failed_rules for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "" and "repeated_lines" in got[2]
