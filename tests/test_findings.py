import pytest
from pyspark.sql import functions as F

from quernel.functions import astfacts
from quernel.functions.astfacts import facts
from quernel.operators import findings
from quernel.functions.astfacts import ast_facts


def of(df):
    return {(r.file, r.type, r.message) for r in df.collect()}


def kinds(text):
    return [f[1] for f in facts(text)]


def complexity(text):
    return next(f[3] for f in facts(text) if f[1] == "module")


def test_complexity_weights():
    assert complexity("") == 1
    assert complexity("if a:\n pass\nelif b:\n pass\n") == 3
    assert complexity("x = a and b and c or d") == 4
    assert complexity("x = [i for i in a for j in b if j]") == 3
    assert complexity("try:\n pass\nexcept A:\n pass\nexcept B:\n pass\n") == 3
    assert complexity("match x:\n case 1: pass\n case _: pass\n") == 3
    assert complexity("try:\n pass\nexcept* A:\n pass\n") == 1
    assert complexity("async def f():\n async for x in y:\n  pass\n") == 1
    assert complexity("x = 1 if a else 2\nwhile x: pass\nfor i in x: pass\n") == 4


@pytest.mark.parametrize(("text", "depth"), [("def f(): pass", 1), ("def f():\n return a", 3), ("def f():\n g(1)", 4), ("def f(x):\n for i in x:\n  if i:\n   g(i)", 6), ("def f(x):\n if x:\n  for i in x:\n   if i:\n    g(h(1))", 8)])
def test_nesting(text, depth):
    assert next(f[6] for f in facts(text) if f[1] == "function") == depth


def test_what_does_not_parse():
    for text in ("def (:", "\ufeffx = 1", "x\0", "(" * 5000 + ")" * 5000):
        assert kinds(text) == ["parse_error"], text[:10]


def test_deep_trees_don_t_break():
    assert kinds("x = " + "-" * 90 + "1")[0] == "module"
    assert kinds("x = " + "+".join(["a"] * 3000))[0] in ("module", "parse_error")


def test_boundaries(files):
    body = lambda n: "def f():\n" + " pass\n" * (n - 1)
    args = lambda n: f"def f({', '.join('abcdefgh'[:n])}): pass\n"
    ifs = lambda n: "def f():\n" + " if a: b\n" * n
    found = of(findings.rule_findings(ast_facts(files({"l50.py": body(50), "l51.py": body(51), "p5.py": args(5), "p6.py": args(6), "c9.py": ifs(9), "c10.py": ifs(10)}))))
    assert {(f, t) for f, t, _ in found} == {("l51.py", "Long Function"), ("p6.py", "Too Many Parameters"), ("c10.py", "High Complexity")}


def test_async_functions_are_not_looked_at(files):
    assert not of(findings.rule_findings(ast_facts(files({"a.py": "async def f(a, b, c, d, e, f, g):\n pass\n"}))))


def test_unused_names(files):
    text = "from __future__ import annotations\nfrom x import *\nimport a.b, c as d, e\na = e\nf: int = 1\ng, h = 1, 2\ni = 1\ni += 1\nj = k = 2\nprint(j)\n"
    f = ast_facts(files({"m.py": text}))
    assert {m.split()[0] for _, _, m in of(findings.unused_imports(f))} == {"annotations", "*", "a.b", "d"}
    assert {m.split()[0] for _, _, m in of(findings.unused_variables(f))} == {"a", "i", "k"}


def test_dead_functions(files):
    f = ast_facts(files({"m.py": "def a(): pass\ndef b(): a()\ndef main(): pass\nclass C:\n def c(self): self.c()\n"}))
    assert {m.split()[0] for _, _, m in of(findings.dead_functions(f))} == {"b", "c"}


def test_secrets(files):
    texts = {"a.py": 'password = "hunter22"\nPassword = \'x y\'\n', "b.py": "key = 'sk-" + "a" * 24 + "'", "c.py": "url = mongodb://u:p@h/db", "d.py": "passwords are fine", "e.py": "-----BEGIN RSA PRIVATE KEY-----", "f.py": "t = 'ghp_" + "a1" * 18 + "' AKIA" + "A" * 16}
    got = {(r.file, r.type, r["count"]) for r in findings.secrets(files(texts)).collect()}
    assert got == {("a.py", "Hardcoded Password", 2), ("b.py", "OpenAI API Key", 1), ("c.py", "MongoDB URL", 1), ("e.py", "Private Key", 1), ("f.py", "GitHub Token", 1), ("f.py", "AWS Access Key", 1)}


def test_static_pipeline_order(files):
    text = "import os\ndef add(a, b, c, d, e, f, g):\n    password = 'abc12345'\n    return a\ndef sum_values(a, b):\n    password = 'abc12345'\n    return a\n"
    rows = findings.static_findings(files({"m.py": text})).orderBy("ord", "seq").collect()
    assert [r.type for r in rows] == ["Too Many Parameters", "Unused Variable", "Hardcoded Password", "Duplicate Function", "Unused Import"]
    assert rows[3].message == "sum_values duplicates add"


def test_architecture(files):
    texts = {f"f{i}.txt.py": "x\n" for i in range(98)} | {"big.js": "x\n" * 301, "ok.py": "x = 1\n" * 300, "god.py": "def f(): pass\n" * 21}
    f = files(texts)
    got = {(t, file) for file, t, _ in of(findings.architecture(f, ast_facts(f)))}
    assert got == {("Large Repository", None), ("Large Module", "big.js"), ("God Module", "god.py")}
    assert not of(findings.architecture(files({"a.py": "x"}))) and not of(findings.architecture(files({})))


def test_added_lines(spark):
    d = spark.createDataFrame([("1", "+a\n++++x\n+++ b/f\n-c\n+ d\r\n+\n+e")], "id string, diff string")
    assert findings.added_lines(d).first().text == "a\n d\n\ne"
    d = spark.createDataFrame([("1", "+ a\n+\n+ b")], "id string, diff string")
    assert findings.added_lines(d, fixed=True).first().text == "a\n\nb"


def test_repository_security(files):
    f = files({"a.py": "pwd = 'secret1'\nimport os\n", "b.js": "x"})
    found = findings.static_findings(f)
    rows = {r.file: r for r in findings.repository_security(f, found).collect()}
    assert [x.type for x in rows["a.py"].secrets] == ["Hardcoded Password"] and rows["a.py"].issues == [] and rows["b.js"].secrets == []
    fixed = {r.file: r for r in findings.repository_security(f, found, fixed=True).collect()}
    assert [x.type for x in fixed["a.py"].issues] == ["Hardcoded Password"]


def test_bodies_are_compared_where_sums_agree():
    text = "def a(x):\n    return x\ndef b(y):\n    return x\ndef c():\n    return 1\ndef d():\n    return 2\ndef e():\n    if a: b\ndef f():\n    if b: a\n"
    key = {f[2]: f[7] for f in facts(text) if f[1] == "function"}
    assert key["a"] == key["b"] is not None and key["c"] is key["d"] is None and (key["e"] is None or key["e"] != key["f"])


def test_kinds():
    text = "import a\nfrom b import c\ndef f():\n    x = c()\n"
    assert {f[1] for f in facts(text, frozenset(("import", "module")))} == {"import", "module"}
    assert [f for f in facts(text) if f[1] == "function"] == facts(text, frozenset(("function",)))
    assert facts("(", frozenset(("module",))) == []


def test_secrets_of_every_rule_in_any_case(files):
    texts = (
        "PassWord = 'x'", "PASSWD='y'", "pwd = \"z\"", "sk-" + "a" * 20, "AKIA" + "A1" * 8, "ghp_" + "a" * 36, "ghs_" + "a" * 36, "mongodb+srv://h", "redis://u:p@h", "-----BEGIN RSA PRIVATE KEY-----",
        "TOKEN = '12345678'", "Api_Key='12345678'", "APIKEY='12345678'", "Secret = '12345678'", "nothing",
    )
    found = findings.secrets(files({f"{k:02}.py": t for k, t in enumerate(texts)})).orderBy("file").collect()
    assert [r.file for r in found] == [f"{k:02}.py" for k in range(14)]
    assert {r.type for r in found} == {t for t, _, _ in findings.SECRET_RULES}


TEXTS = (
    "", "if (x) { y }\n", "x = 1 \\\nfoo\n", "# a \\\nimport b\n", "@a\n@b(\n c\n)\ndef f(): pass\n", "def f():\n  pass\n# c\n  x = 1\n", "import a\n  import b\n",
    "try:\n  import a\nexcept A:\n  pass\nelse:\n  x\nfinally:\n  import b\n", "if a:\n  import b\nelif c:\n  import b\nelse_ = 2\n", '"""Doc\n\nMore words\n# x\n"""\nimport a\nimport a\n', "x = '''\n# '''\ny = 2\n",
    "x = [\nfoo,\n# c\nbar]\nimport z\n", "from __future__ import barry_as_FLUFL\n1 <> 2\n", "x\0y", "a\r\nb\r\n", "# a\rimport b\n", "x = 1;\nimport a; import b\nfrom c import d", "def f():\n  return 1\nx = 1\ndef g():\n  return 1\nx = y\n",
)


@pytest.mark.parametrize("kinds", [astfacts.KINDS, frozenset(("import", "from")), frozenset(("module", "function", "used"))])
def test_remembered_statements_give_the_facts_of_the_whole_file(kinds):
    def whole(text):
        try:
            return astfacts._joined([astfacts._piece(text, kinds)], kinds)
        except (SyntaxError, ValueError):
            return [(0, "parse_error", *[None] * 6)] if "parse_error" in kinds else []

    for _ in range(3):
        for text in (*TEXTS, *(a + b for a in TEXTS for b in TEXTS)):
            assert facts(text, kinds) == whole(text), text


def test_what_a_worker_has_met_twice_is_not_parsed_again(monkeypatch):
    astfacts._known.clear()
    text = "import os\ndef f():\n    return g(1)\n"
    first = facts(text), facts(text)
    parsed = []
    plain = astfacts._tree
    monkeypatch.setattr(astfacts, "_tree", lambda x: parsed.append(x) or plain(x))
    assert facts(text) == first[0] == first[1] and parsed == []
    facts(text + "import new\n")
    assert parsed == ["import new"]


MORE = (
    "import m1\nm1.go()\n", "import m2\nm2.go()\n# c\n\n# d\n", "from m1 import m2 as m3, x\nm3 = m2\n", "import a. _0\n", "from ._0 import b1\n", "import m1 . _0\n", "from .m1 import _0, _1\n", "_1 = _0 = m1\n",
    "x1 = 'y1'\n", "a1 = [b1, c1, a1.b1]\n", "x = 1.e5 + 0x5 - 1_5\n", "x1 = 1if y1 else 2\n", "def f1(a, b, c, d, e, g):\n    def h():\n        return 1\n    return h\ndef k():\n    return 1\n# end\n", "def k():\n    return 1\nclass C:\n    def m(self):\n        return 1\n",
    "def f():\n    x = 1\n    return 2\ndef g():\n    return 2\n\n\n# z\n", "def f():\n" + "    x1\n" * 60, "def f():\n    return 1 \\\n# c\n", "def f():\n    'a\\\n# b'\n", "def f(\n# c\n",
)


@pytest.mark.parametrize("kinds", [astfacts.KINDS, frozenset(findings.FACTS), frozenset(("import", "from"))])
def test_remembered_lines_and_definitions_give_the_facts_of_the_whole_file(kinds):
    def whole(text):
        try:
            rows = astfacts._joined([astfacts._piece(text, astfacts.KINDS)], astfacts.KINDS)
        except SyntaxError:
            return [(0, "parse_error", *[None] * 6)] if "parse_error" in kinds else []
        if "notable" not in kinds:
            return [r for r in rows if r[1] in kinds]
        named = lambda kind: {r[2] for r in rows if r[1] == kind}
        loaded, used = named("loaded"), named("used")
        beyond = lambda r: r[7] or r[3] > 50 or r[4] > 5 or r[5] > 10 or r[6] > 6
        return [r for r in rows if (r[1] == "function" and beyond(r)) or (r[1] == "assigned" and r[2] not in loaded) or (r[1] == "imported" and r[2] not in used)]

    texts = (*MORE, *(a + b for a in MORE for b in MORE))
    for _ in range(4):
        for text in texts:
            assert facts(text, kinds) == whole(text), text


def test_lines_like_others_and_definitions_met_twice_are_not_parsed_again(monkeypatch):
    astfacts._known.clear()
    text = "import m{k}\nm{k}.go()\nclass C:\n    pass\ndef f():\n    return 1\n# pad\n"
    for k in range(3):
        facts(text.format(k=k))
    parsed = []
    plain = astfacts._tree
    monkeypatch.setattr(astfacts, "_tree", lambda x: parsed.append(x) or plain(x))
    got = facts(text.format(k=7) + "# pad\n")
    assert parsed == [] and [r[2] for r in got if r[1] == "import"] == ["m7"] and {r[2] for r in got if r[1] == "used"} == {"m7"}


def test_facts_alone_tell_all_findings(files):
    """What few facts and no texts tell is what all facts and the texts do, secrets of broken files included."""
    texts = {f"{k}.py": t for k, t in enumerate((*MORE, "pwd = 'x'\nPwd='y'\n", "if (pwd='x')\n", "x = 'token = \"12345678\"'\n", "PA\u017f\u017fWD = 'x'\n"))}
    rows = files(texts)
    few, full = (findings.static_findings(None, astfacts.ast_facts(rows, findings.FACTS)), findings.static_findings(rows))
    key = lambda df: sorted(tuple(r) for r in df.select("file", "ord", "seq", "type", "severity", "message", F.coalesce("count", F.lit(0))).collect())
    assert key(few) == key(full) and {r[3] for r in key(few)} >= {"Hardcoded Password", "Duplicate Function", "Parse Error", "Too Many Parameters", "Hardcoded Token"}


def test_secrets_of_parts_met_before_are_not_searched_again(monkeypatch):
    from quernel.functions import secrets

    texts = [f"import m{{k}}\n{a}def f():\n    {b}\n# {c}\n# {c}\n" for a in ("", "pwd = 'x'\n") for b in ("return 1", "pwd = 'y'") for c in ("z", "pwd = 'z'", "sk-" + "a" * 20)]
    searched = []
    plain = secrets.matches
    monkeypatch.setattr(secrets, "matches", lambda x: searched.append(x) or plain(x))
    for k in range(3):
        for text in texts:
            text = text.format(k=k)
            got = [(f[0], f[2], f[3]) for f in facts(text, frozenset(findings.FACTS)) if f[1] == "secret"]
            assert got == plain(text), text
        if k:
            assert all(x.startswith("import") and "def" not in x and "#" not in x for x in searched)
        searched.clear()


def test_findings_stand_where_facts_are(files):
    """Only duplicate functions are sent to where they meet."""
    few = astfacts.ast_facts(files({"a.py": "import os\n"}), findings.FACTS)
    plan = findings.static_findings(None, few)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_sizes_are_what_patterns_count(files):
    """Lines and complexity of each file, in the pass that reads its tree."""
    from quernel.functions import lexical

    texts = {f"{k}.py": t for k, t in enumerate((*TEXTS, *MORE, "if (x) { y } else\u2028for é1 if_ _while while", "\x0b\x0c\r\r\n\x1c", "else: é\x85if\n", "x = 1 if a else 2\n", "a\n\nb"))}
    rows = files(texts)
    facts_of = astfacts.ast_facts(rows, ("size", "module"))
    trees = facts_of.where("kind = 'module'").selectExpr("repo_id", "path", "a AS ast_complexity")
    plain = {r.path: (r.lines, r.complexity_score) for r in lexical.metrics(rows, trees).collect()}
    assert {r.path: (r.a, r.b) for r in facts_of.where("kind = 'size'").collect()} == plain
    assert not astfacts.ast_facts(rows, ("size",)).where("kind <> 'size'").count()


def test_definitions_of_files_that_differ_elsewhere_are_not_parsed_again(monkeypatch):
    astfacts._known.clear()
    texts = ["class A:\n    pass\n" * (n + 1) + "def f():\n    pass\n" * (k + 1) for n in range(3) for k in range(3)]
    for text in ("import a1\n" + t for t in (*texts[:3], *texts[:3], *texts[::3], *texts[::3])):
        facts(text)
    parsed = []
    plain = astfacts._tree
    monkeypatch.setattr(astfacts, "_tree", lambda x: parsed.append(x) or plain(x))
    monkeypatch.setattr(astfacts, "_merged", None)
    for t in texts[4:6]:
        facts("import a2\n" + t)
    assert parsed == []
