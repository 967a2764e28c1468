import itertools
import random

from quernel.functions.astfacts import ast_facts
from quernel.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame([("r", *p) for p in pairs], "repo_id string, src string, dst string")


def brute_cycles(pairs, longest):
    pairs, nodes, out = set(pairs), sorted({x for p in pairs for x in p}), set()
    for n in range(1, longest + 1):
        for c in itertools.permutations(nodes, n):
            if c[0] == min(c) and all((a, b) in pairs for a, b in zip(c, c[1:] + c[:1])):
                out.add((*c, c[0]))
    return out


def brute_components(pairs):
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    return {(a, min(b for x, b in reach if x == a and (b, a) in reach)) for a, _ in reach if (a, a) in reach}


def test_cycles_and_components(spark):
    rng = random.Random(2)
    cases = [[("a", "b")], [("a", "a")], [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d")], [("b", "c"), ("c", "d"), ("d", "b"), ("a", "b")]]
    cases.append([(x, y) for x in "abcdefg" for y in "abcdefg" if rng.random() < 0.25])
    for pairs in cases:
        e = edges(spark, pairs)
        assert {tuple(r.path) for r in graph.cycles(e, 4).collect()} == brute_cycles(pairs, 4)
        assert {(r.node, r.component) for r in graph.on_cycles(e).collect()} == brute_components(pairs)


def test_repositories_stay_apart(spark):
    """No cycle, neighbour or end goes from one repository to another."""
    e = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "a"), ("r2", "a", "c"), ("r3", "a", "b"), ("r3", "b", "a")], "repo_id string, src string, dst string")
    assert [(r.repo_id, r.path) for r in graph.cycles(e).collect()] == [("r3", ["a", "b", "a"])]
    assert {tuple(r) for r in graph.on_cycles(e).collect()} == {("r3", "a", "a"), ("r3", "b", "a")}
    got = graph.neighbourhood(e, spark.createDataFrame([("r1", "a")], "repo_id string, node string")).collect()
    assert {tuple(r) for r in got} == {("r1", "a", "a"), ("r1", "a", "b")}
    known = spark.createDataFrame([(r, m) for r in ("r1", "r2", "r3") for m in "abc"], "repo_id string, module string")
    top = graph.top(graph.degrees(known, e.selectExpr("*", "true AS internal")), "imports", 1).collect()
    assert [(r.repo_id, r.module, r.imports) for r in top] == [("r1", "a", 1), ("r2", "a", 1), ("r3", "a", 1)]


def test_a_root_package_has_no_name(files):
    assert links(files({"__init__.py": "", "a.py": "from . import b\n", "b.py": ""})) == {("a", "b")}


def test_module_names(spark, files):
    got = {r.path: r.module for r in graph.modules(files({"a/b.py": "", "a/__init__.py": "", "__init__.py": "", "p.py": "", "p/__init__.py": "", "x.js": ""})).collect()}
    assert got == {"a/b.py": "a.b", "a/__init__.py": "a", "__init__.py": "", "p/__init__.py": "p"}


def links(f, fixed=False):
    return {(r.src, r.dst) for r in graph.edges(f, ast_facts(f), fixed).collect() if r.internal}


def test_fixed_variants(files):
    f = files({"pkg/__init__.py": "from .a import x\n", "pkg/a.py": "from pkg import b\nfrom nowhere import one\n", "pkg/b.py": ""})
    assert links(f) == {("pkg.a", "pkg")}
    assert links(f, fixed=True) == {("pkg", "pkg.a"), ("pkg.a", "pkg.b")}


def test_relative_levels(files):
    f = files({"a/b/c.py": "from . import d\nfrom .. import e\nfrom ...x import y\nfrom ....z import w\n", "a/b/d.py": "", "a/e.py": "", "x.py": "", "z.py": ""})
    assert links(f) == {("a.b.c", "a.b.d"), ("a.b.c", "a.e"), ("a.b.c", "x"), ("a.b.c", "z")}


def test_neighbourhood_and_filters(spark):
    e = edges(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("d", "e")])
    got = {r.node for r in graph.neighbourhood(e, spark.createDataFrame([("r", "a")], "repo_id string, node string")).collect()}
    assert got == {"a", "b", "c"}
    kept = graph.filter_edges(e, spark.createDataFrame([("r", "c"), ("r", "d")], "repo_id string, node string")).collect()
    assert [(r.src, r.dst) for r in kept] == [("c", "d")]


def test_modules_are_found_once_for_a_graph(files, monkeypatch):
    from quernel.plans import repository

    made = []
    plain = graph.modules
    monkeypatch.setattr(repository.graph, "modules", lambda rows: made.append(1) or plain(rows))
    r = repository.Repository(files({"a.py": "import b\n", "b.py": "import os\n"}), parts=("graph",))
    assert {(e.src, e.dst, e.internal) for e in r.edges.collect()} == {("a", "b", True), ("b", "os", False)}
    assert r.node_link.count() == 1 and r.degrees.count() == 2 and made == [1]
