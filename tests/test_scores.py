import pytest

from quernel.functions import lexical
from quernel.operators import reports, reviews, scores
from pyspark.sql import functions as F


def found(spark, severities, kinds=None):
    kinds = kinds or ["x"] * len(severities)
    return spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(zip(severities, kinds))], "g int, seq int, severity string, type string")


@pytest.mark.parametrize(("severities", "static", "security", "risk"), [
    (["Critical", "High"], 70, 75, 30), (["Critical"], 80, 85, 20), (["High"], 90, 90, 10), (["Medium"], 95, 95, 5), (["Low"], 98, 98, 2), ([None], 98, 98, 2), (["odd"], 100, 98, 2), (["Critical"] * 9, 0, 0, 180),
])
def test_point_tables(spark, severities, static, security, risk):
    f = found(spark, severities)
    assert scores.static_score(f, ["g"]).first().static_score == static
    assert scores.security_score(f, ["g"]).first().security_score == security
    assert scores.file_risk(f, ["g"]).first()[1:] == (risk, len(severities))


def test_architecture_score(spark):
    kinds = ["God Module", "Large Module", "other"]
    assert scores.architecture_score(found(spark, [None] * 3, kinds), ["g"]).first().architecture_score == 80
    assert scores.architecture_score(found(spark, [None] * 9, ["God Module"] * 9), ["g"]).first().architecture_score == 0


def test_counts(spark):
    f = found(spark, ["Critical", "odd", None, "Low"])
    assert scores.severity_distribution(f, ["g"]).first()[1:] == (1, 0, 0, 1)
    assert scores.severity_counts(f, ["g"]).first()[1:] == (1, 0, 0, 3)
    s = scores.security_summary(found(spark, ["Critical", "Critical", "High"], ["OpenAI API Key", "MongoDB URL", "Long Function"]), ["g"]).first()
    assert s[1:] == (2, 0, 0, 0, ["MongoDB URL", "OpenAI API Key"])


def test_root_causes_and_fixes(spark):
    f = found(spark, ["Low", None, "High"], ["Unused Import", "Unused Import", "High Complexity"])
    assert [tuple(r) for r in scores.root_causes(f).collect()] == [("Unknown", 3)]
    assert [tuple(r) for r in scores.root_causes(f, "type").collect()] == [("Unused Import", 2), ("High Complexity", 1)]
    assert {(r.issue, r.severity) for r in scores.fix_suggestions(f).collect()} == {("Unused Import", "Low"), ("Unused Import", "Unknown")}


@pytest.mark.parametrize(("avg", "functions", "classes", "imports", "score", "band"), [
    (1.0, 1, 0, 2, 100, "Excellent"), (3.0, 200, 50, 100, 98, "Excellent"), (2.0, 201, 51, 101, 87, "Excellent"), (200.0, 501, 101, 301, 35, "Poor"), (41.0, 0, 0, 0, 80, "Excellent"), (43.0, 0, 0, 0, 78, "Good"),
])
def test_health(spark, avg, functions, classes, imports, score, band):
    df = spark.createDataFrame([("r", avg, functions, classes, imports)], "repo_id string, avg_complexity double, functions long, classes long, imports long")
    r = scores.health(df).first()
    assert (r.health_score, r.health) == (score, band)


def test_grades(spark):
    df = spark.createDataFrame([(x,) for x in (100, 90, 89, 75, 74, 60, 59, 40, 39, 0)], "s int")
    assert [r[0] for r in df.select(scores.grade(F.col("s"))).collect()] == list("AABBCCDDFF")


def test_history(spark):
    df = spark.createDataFrame([("a", 1, 90), ("a", 2, 40), ("a", 3, 40)], "g string, v int, s int")
    rows = reviews.history(df, ["g"], "v", "s").orderBy("v").collect()
    assert [(r.difference, r.status) for r in rows] == [(25, "Improved"), (-50, "Declined"), (0, "Unchanged")]


def test_reviews(spark):
    text = "1. Security Vulnerabilities\nSeverity: CRITICAL\nseverity:low\n#### 2. x\nCode Smell\n### Overall Code Quality Score\n8/100, 90/100"
    r = reviews.parsed(spark.createDataFrame([(text,), ("none",), ("10/1000",)], "review string")).collect()
    assert r[0].score == 8 and r[0].security == "Security Vulnerabilities\nSeverity: CRITICAL\nseverity:low" and r[0].smells == "Code Smell" and r[0].performance == "No performance issues detected."
    assert (r[0].critical, r[0].high, r[0].medium, r[0].low) == (1, 0, 0, 1)
    assert r[1].score is None and r[1].security == "No security issues detected." and r[2].score == 10


def test_reviewer_skips_what_fails(spark):
    def reviewer(prompt):
        if "bad" in prompt:
            raise ValueError
        return prompt

    asked = spark.createDataFrame([("r", f"{i}.py", "bad" if i == 1 else str(i)) for i in range(6)] + [("r", "0.txt", "x")], "repo_id string, path string, prompt string")
    assert [r.review for r in reviews.review(asked, reviewer).orderBy("file").collect()] == ["0", "2", "3"]
    assert reports.review_summary(reviews.review(asked)).first().summary.startswith("\nRepository AI Summary\n\nFiles Reviewed: 3\n\n\n\nFile: 0.py\n")


def test_reports(spark):
    f = spark.createDataFrame([("r", "a", 0, 0, "T", "High", "m", 2), ("r", "a", 1, 0, None, None, None, None)], "repo_id string, file string, ord int, seq int, type string, severity string, message string, count int")
    assert reports.findings_text(f).first().report == "Type: T\nSeverity: High\nMessage: m\nCount: 2\n\nType: Unknown\nSeverity: Unknown\n"
    assert reports.findings_text(f.where("ord = 0"), strict=True).first().report.endswith("Count: 2\n\n")
    with pytest.raises(Exception, match="has no type"):
        reports.findings_text(f, strict=True).collect()


def test_lines_as_splitlines(spark):
    import random

    rng = random.Random(1)
    texts = ["", "a", "a\n", "a\n\n", "\r\n", "\r", "a\x1cb", "a\u2028", "\x85x", "é\n\n\r"] + ["".join(rng.choice("ab é\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029\x1f") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", lexical.n_lines(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [len(t.splitlines()) for t in texts]


def test_lexical_golden(files):
    text = "import os\n\nclass A:\n    async def  f(x):\n        for i in x:\n            if i:\n                pass\n# subclass of B; forfor, if_\n"
    r = lexical.metrics(files({"a.py": text})).first()
    assert (r.lines, r.functions, r.classes, r.imports, r.loops, r.conditionals, r.complexity_score, r.risk) == (8, 1, 2, 1, 1, 1, 3, "Low")


def test_counts_are_those_of_the_plain_patterns(spark):
    texts = ["", "\n", "if", "xif if_ elif\nelse:", "for x in y\r\nwhile\rforé éfor", "a\u2028b", "a\nb\x0b", "async  def f(\ndef g(\nclass A", " import a\n\n  from b import c\nimportant", "no\nend", None]
    rows = spark.createDataFrame([("r", str(k), ".py", t) for k, t in enumerate(texts)], "repo_id string, path string, ext string, text string")
    word = lambda ws: rf"(?<!{lexical.WORD})(?:{'|'.join(ws)})(?!{lexical.WORD})"
    plain = {"functions": lexical.FUNCTION, "classes": lexical.CLASS, "imports": lexical.IMPORT, "loops": word(lexical.LOOPS), "conditionals": word(lexical.CONDITIONALS)}
    n = F.regexp_count("text", F.lit(lexical.LINE_END)) + F.when((F.length("text") > 0) & ~F.col("text").rlike(rf"(?:{lexical.LINE_END})\z"), 1).otherwise(0)
    want = rows.select("path", n.alias("lines"), *(F.regexp_count("text", F.lit(p)).alias(c) for c, p in plain.items())).orderBy("path").collect()
    assert lexical.metrics(rows).select("path", "lines", *plain).orderBy("path").collect() == want
