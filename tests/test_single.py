from quernel.plans.single import Diff, Single


def test_file(files):
    s = Single(files({"a.py": "import os\ndef f(a, b, c, d, e, g):\n    password = 'abc12345'\n    return a\n"}))
    assert [tuple(r)[2:5] for r in s.metrics.collect()] == [(4, 1, 0)]
    assert {(r.issue, r.severity) for r in s.fixes.collect()} == {("Too Many Parameters", "Medium"), ("Unused Variable", "Low"), ("Hardcoded Password", "Critical"), ("Unused Import", "Low")}
    assert tuple(s.scores.first()) == ("repo", 71, 76, 1, 0, 1, 2)
    assert {(r.type, r.theme) for r in s.themes.collect()} >= {("Hardcoded Password", "security"), ("Unused Import", "smells")}
    assert s.security_summary.first().critical == 1 and s.suggested_fixes.count() == 1
    c = s.comparison.first()
    assert c.difference == c.new_score - 65
    assert "Static Analysis Score: 71/100" in s.summary.first().summary and "- Too Many Parameters" in s.summary.first().summary


def test_clean_file(files):
    s = Single(files({"a.py": "x = 1\nprint(x)\n"}))
    assert tuple(s.scores.first()) == ("repo", 100, 100, 0, 0, 0, 0) and s.findings.count() == 0 and s.summary.count() == 1


def test_diff(spark):
    d = Diff(spark.createDataFrame([("7", "+import os\n+pwd = 'abcdef'\n")], "id string, diff string"))
    assert [tuple(r) for r in d.comparison.collect()] == [("7", 65, 0, -65, "Declined")]
    assert d.scores.first().static_score == 78
