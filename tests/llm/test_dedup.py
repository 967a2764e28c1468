import collections
import random
import re

import numpy as np
import pytest

from quernel.llm import components, jaccard, substrings, textkernel

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    s = {i: shingles(t) for i, t in rows}
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            both = len(s[a] & s[b])
            if a < b and both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def brute_cut(rows, span=200):
    n = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        n.update(b[k : k + span] for k in range(len(b) - span + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if n[b[k : k + span]] > 1:
                gone[k : k + span] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, kept)
    return out


def corpus(seed, docs=120):
    """Families of near copies at all distances, shared passages, a common line, exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(3)]
    rows, families = [], [[word() for _ in range(rng.choice([3, 6, 30, 120, 300]))] for _ in range(8)]
    for i in range(docs):
        w = list(rng.choice(families))
        kind = rng.random()
        if kind < 0.2:
            w = [word() for _ in range(rng.randint(0, 150))]
        elif kind < 0.8:
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.7, 1))]
        t = " ".join(w)
        if rng.random() < 0.3:
            t += rng.choice(["\n", " "]) + rng.choice(passages)
        rows.append((i, t))
    return rows


def join(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("chunk", [1 << 20, 1500])
def test_join_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus(11)
    assert join(spark, rows) == brute_components(rows)


def test_join_edges(spark, edge, edge_rows, none):
    want = brute_components([(i, t) for i, t, *_ in edge_rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(edge).collect()} == want
    assert jaccard.join(none).count() == 0
    assert join(spark, [(1, "a b c"), (2, "A  B\nC"), (3, "a b"), (3, "a b"), (4, None), (5, " ")]) == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (0, 5)}


def by_row(rows):
    """Brute force with rows, not ids, as documents: (id, set's size, component's least id) of each."""
    comps = brute_components([(k, t) for k, (_, t) in enumerate(rows)])
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comps[k][1]].append(i)
    return collections.Counter((i, comps[k][0], min(least[comps[k][1]], default=None) if comps[k][0] else i) for k, (i, _) in enumerate(rows))


def repeated_ids(seed):
    """One id on several texts, texts without an id, and rows repeated as they are."""
    rng = random.Random(seed)
    a, b = (" ".join(f"{p}{rng.randrange(500)}" for _ in range(60)) for p in "xy")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (None, a + " more"), (None, "alone " * 3), (None, None)]
    rows += [(rng.choice([1, 5, 9, None]), t) for _, t in corpus(seed, 60)]
    return rows + [(7, a)] * 3 + rows[:3]


@pytest.mark.parametrize("chunk", [1 << 17, 1500, 200])
def test_join_of_repeated_and_null_ids(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = repeated_ids(31)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_row(rows)


def test_join_of_a_large_group(spark, monkeypatch):
    """Many chunks of near copies, with two families that share keys but aren't linked."""
    monkeypatch.setattr(jaccard, "CHUNK", 400)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    other = base[:38] + [f"v{k}" for k in range(22)]
    rows = []
    for i in range(150):
        w = list(base if i % 7 else other)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert join(spark, rows) == brute_components(rows)


def test_sets_of_a_slice_drop_out_only_when_all_its_rows_are_counted(spark):
    owners, counts = np.array([0, 3, 4]), np.array([1, 255, 700])
    got = np.zeros(5, np.int64)
    packed = jaccard._pack(owners, counts)
    np.add.at(got, *jaccard._unpack(*packed))
    assert got.tolist() == [1, 0, 0, 255, 700]
    keys = [bytes([k]) * 16 for k in range(5)]
    sizes = np.array([2, 2, 2, 300, 1000], "<u4").tobytes()
    rows = []
    for name, counted in ((b"all", 3), (b"some", 2)):
        rows.append((None, None, None, None, name, b"", b"", 3, b"".join(keys), sizes))
        rows.append((None, None, None, None, name, *packed, counted, None, None))
    found = spark.createDataFrame(rows, jaccard._SCHEMA)
    assert sorted(r.key for r in jaccard.lonely(found).collect()) == [keys[0], keys[1], keys[2], keys[4]]


def test_tree_finds_all_links():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for _ in range(300):
        b = base[rng.integers(6)]
        keep = b[rng.random(len(b)) < rng.uniform(0.7, 1)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 25), dtype=np.uint64)])))
    got, want = jaccard._Union(), jaccard._Union()
    for i, j in jaccard.Tree(sets).links(list(range(300)), got.find):
        got.join(i, j)
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert [got.find(i) for i in range(300)] == [want.find(i) for i in range(300)]


@pytest.mark.parametrize("meet", [1024, 2])
def test_only_sets_that_may_link_meet_with_their_shingles(monkeypatch, meet):
    monkeypatch.setattr(jaccard, "MEET", meet)
    monkeypatch.setattr(jaccard, "ABREAST", 2)
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(1 << 62, size=n, dtype=np.uint64)
    a, c = fresh(200), fresh(200)
    sets = [a, np.concatenate([a[:180], fresh(20)]), np.concatenate([a[:100], fresh(100)]), a[:120], c, np.concatenate([c[:190], fresh(10)]), fresh(50), fresh(50)]
    # The first two are alike, the two of c are one component already; the last two are alone or strangers.
    rows = [(k, 0, 0, comp, i, len(sets[i]), jaccard._bitmaps([sets[i]])[0].tobytes()) for k, comp, i in ((1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 4), (2, 4, 5), (3, 6, 6), (4, 0, 0), (4, 6, 6))]
    kinds = [jaccard.pa.int64()] * 6 + [jaccard.pa.binary()]
    batches = [jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(c, t) for c, t in zip(zip(*part), kinds)], list("kjicdnb")) for part in (rows[:1], rows[1:])]
    got = [tuple(r.values()) for b in jaccard._hopeful(iter(batches)) for r in b.to_pylist()]
    assert got == ([(1, 0, 0, 0, 0), (1, 0, 0, 1, 1)] if meet > 4 else [r[:5] for r in rows if r[0] == 1])


@pytest.mark.parametrize("most", [1 << 26, 1 << 6])
def test_texts_without_a_chosen_set_are_not_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MOST_BITS", most)
    texts = spark.range(5000).selectExpr("id AS doc_id", "cast(id AS string) AS text", "xxhash64(id) AS mark")
    chosen = texts.where("doc_id % 50 = 0").selectExpr("mark AS rep_mark")
    got = {r.doc_id for r in jaccard._likely(texts, chosen).collect()}
    assert got >= set(range(0, 5000, 50)) and len(got) < (5000 if most < 1 << 20 else 500)
    assert jaccard._likely(texts, chosen.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, x) for x in range(201, 230)] + [(7, 7)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(spark, rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("chunk, most", [(50_000, 100_000), (3, 100_000), (3, 0)])
def test_cut_against_brute_force(spark, monkeypatch, chunk, most):
    """Also where anchors are too many for a task, and those too many to broadcast."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "MOST_BROADCAST", most)
    rows = corpus(12, 80) + [(900, "ab" * 400), (901, "a" * 199), (902, "b" * 200), (903, "b" * 201), (904, "xyz " * 30 + "q" * 500), (905, None)]
    assert cut(spark, rows) == brute_cut(rows)


@pytest.mark.parametrize("chunk", [50_000, 3])
def test_cut_of_repeated_and_null_ids(spark, monkeypatch, chunk):
    """Documents are rows: a text that one id holds beside another keeps what it alone has."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rows = repeated_ids(32) + [(1, "q" * 150 + "".join(map(chr, range(48, 123))) * 3)]
    want = brute_cut([(k, t) for k, (_, t) in enumerate(rows)])
    want = collections.Counter((rows[k][0], *x) for k, x in want.items())
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_places_are_put_together_across_slices(spark, monkeypatch):
    """However texts fall into slices, and slices into partitions."""
    for module in (substrings, jaccard):
        monkeypatch.setattr(module, "SLICE_ROWS", 7)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 3000)
    rows = corpus(13, 70)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup(df).collect()} == brute_cut(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == brute_components(rows)


@pytest.mark.parametrize("g", [2, 3, 8, 9, 20])
def test_windows_of_sorted_contexts(g):
    """Pairs and distances give the windows that a comparison of all windows gives."""
    rng = random.Random(g)
    for _ in range(20):
        core = bytes(rng.choice(b"ab") for _ in range(260))
        group = {}
        while len(group) < g:
            p, n = rng.randrange(0, 101), rng.randrange(200, 301)
            c = bytearray(core[100 - p : 100 - p + n].ljust(200, b"c"))
            for _ in range(rng.randrange(3)):
                c[rng.randrange(len(c))] = rng.choice(b"xyz")
            group[p, bytes(c)] = None
        group = list(group)
        at = collections.Counter((p - k, c[k : k + 200]) for p, c in group for k in range(len(c) - 199) if k <= p)
        want = [{k for k in range(len(c) - 199) if k <= p and at[p - k, c[k : k + 200]] > 1} for p, c in group]
        assert [{k for a, b in runs for k in range(a, b + 1)} for runs in substrings.repeats(group)] == want


def test_cut_edges(edge, edge_rows, none, sha):
    want = brute_cut([(i, t) for i, t, *_ in edge_rows])
    got = {r.doc_id: r for r in substrings.dedup(edge, carry=("lang", "source")).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == want
    assert all(r.kept_sha256 == sha(bytes(r.kept)) and r.source == edge_rows[i][3] and "�" not in r.kept_text for i, r in got.items())
    assert substrings.dedup(none).count() == 0


def test_deep_shallow_order():
    rng = random.Random(5)
    for _ in range(2000):
        prefix = b"x" * rng.choice([0, 7, 30])
        s = [prefix + bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 8, 9, 24, 30, 60]))) for _ in range(rng.randint(1, 12))]
        order, common = substrings.deep_shallow(s)
        t = [s[i] for i in order]
        assert t == sorted(s) and sorted(order) == list(range(len(s)))
        assert common == [0, *(substrings.common_prefix(a, b) for a, b in zip(t, t[1:]))]


def test_segments_of_a_long_text_agree(monkeypatch):
    rng = random.Random(9)
    t = bytes(rng.choice(b"abc ") for _ in range(5000)) + b"r" * 700
    windows = lambda: {(int(p), w) for h, ps, a, b in substrings.anchors(t) for p, lo, hi in zip(ps, a, b) for w in range(int(lo), int(hi) + 1)}
    whole = windows()
    assert sorted(w for _, w in whole) == list(range(len(t) - 199)) and all(w <= p <= w + 100 for p, w in whole)
    monkeypatch.setattr(substrings, "SEGMENT", 777)
    assert windows() == whole


def test_word_hashes_don_t_depend_on_blocks(monkeypatch):
    t = ("word Word x " * 300 + "y" * 900 + " z").encode()
    a = textkernel.word_hashes(t)
    monkeypatch.setattr(textkernel, "BLOCK", 97)
    b, begin, end = textkernel.word_hashes(t, spans=True)
    assert (a == b).all() and a[0] == a[1] and [t[i:j] for i, j in zip(begin, end)] == t.split()
