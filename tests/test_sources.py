import zipfile

from pyspark.sql import functions as F

from quernel.plans.repository import Repository
from quernel.sources import files as sources
from quernel.streaming import live


def test_folder_and_policies(spark, tmp_path):
    root = tmp_path / "r (1)"
    for p, b in {"a.py": b"x\r\ny\rz", "B.PY": b"x", "bad.py": b"\xff\xfe", "c.ts": b"1", "node_modules/d.js": b"1", "sub/venv/e.py": b"1", "empty.js": b"", "n.txt": b"1", "pkg/__init__.py": b"1", "_own/.f.py": b"", ".hidden/g.py": b"1"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b)
    df = sources.read_folder(spark, str(root)).cache()
    assert df.where("path = 'a.py'").first().text == "x\ny\nz"
    of = lambda policy: {r.path for r in df.where(sources.belongs(F.col("path"), policy)).collect()}
    names = {"pkg/__init__.py", "_own/.f.py", ".hidden/g.py"}
    assert of("metrics") == {"a.py", "node_modules/d.js", "sub/venv/e.py", "empty.js"} | names
    assert of("wide") == of("metrics") | {"c.ts"}
    assert of("explorer") == {"a.py", "B.PY", "c.ts", "empty.js"} | names
    assert of("python") == {"a.py", "sub/venv/e.py"} | names
    assert sources.concatenated(df).first().n_files == 7
    # Files that can't be read count where they are kept.
    assert sources.concatenated(sources.read_folder(spark, str(root), unreadable=True)).first().n_files == 8
    assert sources.read_folder(spark, str(root), endings=None).where("path = 'n.txt'").count() == 1
    assert sources.read_folder(spark, str(root / "a.py")).count() == 0
    (tmp_path / "none").mkdir()
    assert sources.read_folder(spark, str(tmp_path / "none")).count() == 0


def test_written_files_come_back(spark, tmp_path):
    rows = [("r", "a/_b.py", b"1\r\n"), ("r", "c.py", None), ("s", "d e/f+%20.py", b"x")]
    df = spark.createDataFrame(rows, "repo_id string, path string, content binary")
    root = f"file://{tmp_path / 'out 1'}"
    assert sources.write_folder(df, root).where("n_bytes > 0").count() == 2
    want = [("r", "a/_b.py", "1\n"), ("r", "c.py", ""), ("s", "d e/f+%20.py", "x")]
    assert sorted((r.repo_id, r.path, r.text) for r in sources.read_folder(spark, root, repo_id=None).collect()) == want
    assert sources.write_zips(df, root + "/zips").count() == 2
    assert sorted((r.repo_id[:-4], r.path, r.text) for r in sources.read_zips(spark, root + "/zips").collect()) == want


def test_zips(spark, tmp_path):
    for n in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr("p/a.py", f"{n} = 1\r\n")
    rows = sources.read_zips(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.text) for r in rows) == [("p/a.py", "one = 1\n"), ("p/a.py", "two = 1\n")] and len({r.repo_id for r in rows}) == 2


def test_upload_keeps_line_ends(spark):
    assert sources.upload(spark, "a.py", b"x\r\n").first().text == "x\r\n"


def test_repository(files):
    """The panels of a small repository together."""
    texts = {"a.py": 'password = "abcdef12"\n', "b.py": "import os\n", "pkg/c.py": "import b\ndef f(x):\n    return x\n", "w.js": "if (x) { y }\n"}
    r = Repository(files(texts))
    s = r.health.first()
    assert (s.files, s.lines, s.functions, s.classes, s.imports, s.health_score) == (4, 6, 1, 0, 2, 99)
    risk = {x.file: (x.risk_score, x.issues) for x in r.file_risk.collect()}
    # A secret and a variable, an import, nothing but an import; other languages are not looked at.
    assert risk == {"a.py": (22, 2), "b.py": (2, 1), "pkg/c.py": (2, 1)}
    debt = {x.file: x.score for x in r.debt.collect()}
    assert debt == {"a.py": 88, "b.py": 93, "pkg/c.py": 93, "w.js": 100 - 5 - 2 * 2}
    modules = {x.module: x.risk_score for x in r.module_risk.collect()}
    assert modules == {"a": 12, "b": 3 + 1 + 7, "pkg.c": 2 + 7}
    assert {x.module: x.priority_score for x in r.refactoring.collect()} == modules
    fixed = {x.module: x.priority_score for x in Repository(files(texts), fixed=True).refactoring.collect()}
    assert fixed == {"a": 12 + 1 + 12, "b": 11 + 1 + 7, "pkg.c": 9 + 1 + 7}
    assert r.dependencies["cycles"].count() == 0 and '"id":"pkg.c"' in r.dependencies["json"].first().json
    assert "Files Analyzed: 4" in r.summary.first().summary and r.reviews.count() == 3
    assert r.architecture.count() == 0 and [tuple(x) for x in r.root_causes.collect()] == [("Unknown", 4)]


def test_empty_repository(files):
    r = Repository(files({}))
    for df in (r.health, r.findings, r.debt, r.module_risk, r.refactoring, r.file_risk, r.security, r.root_causes, r.summary):
        assert df.count() == 0


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "def f(x):\n for i in x: pass\n", "en", "s", 3), (2, "pwd = 'abc'", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "in"))
    docs = live.read_documents(spark, str(tmp_path / "in"))
    for name, df, mode in (("s_metrics", live.repository_metrics(docs), "complete"), ("s_secrets", live.secrets(docs), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("s_metrics").first().files == 2 and spark.table("s_secrets").first().type == "Hardcoded Password"
