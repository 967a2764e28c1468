"""Queries over source code made from the part table, one repository for each brand.

Each part is a Python module whose size, functions, classes, branches, imports and secret follow from
its columns, so that SQL over the columns can say what every analysis must find. Some parts are also
a package of the module's name, and some have a script in another language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import findings, graph, rankings, reports, reviews, scores
from quernel.plans.repository import PARSED, Repository
from quernel.plans.shared import shared_dir, stored
from quernel.registry import query, table
from quernel.sources import files as sources

SECRET = "abcdef12"
#: Parts in a task, at least and at most: a part is a few bytes in the table, but kilobytes of source code.
#: Between the two as many as give each core a few tasks; small tasks by the thousand cost more than their work.
PARTS, MOST_PARTS, WAVES = 2000, 50_000, 4


def _repeated(n: str, most: int, line: str) -> str:
    """Spark SQL: the lines for 1 to n, which is at most `most`; all there can be are constants."""
    texts = [repr("".join(line.format(i=i) for i in range(1, k + 1))) for k in range(most + 1)]
    return f"element_at(array({', '.join(texts)}), cast(greatest({n}, 0) + 1 as int))"


_MODULE = f"""concat(if(p_partkey % 4 = 0, 'import os\n', ''), 'import m', p_partkey + 1, '\nm', p_partkey + 1, '.go()\n',
  if(p_size % 3 = 0, 'password = "{SECRET}"\n', ''),
  {_repeated("p_partkey % 13", 12, "class C{i}:\n    pass\n")}, {_repeated("p_size % 25", 24, "def f{i}():\n    return {i}\n")},
  'def work(x):\n', {_repeated("p_partkey % 30", 29, "    if x == {i}:\n        pass\n")}, '    return x\n', repeat('# pad\n', p_size * 10))"""

# The same text, and what is in it, in DuckDB's SQL.
_REPEATED = "array_to_string(list_transform(range(1, {n} + 1), lambda i: {line}), '')"
_CODE = f"""
p AS (SELECT p_brand AS repo_id, p_partkey AS key, p_partkey % 30 AS k, p_partkey % 13 AS nc, p_size % 25 AS nf, p_size * 10 AS pad,
  (p_size % 3 = 0)::INTEGER AS secret, (p_partkey % 4 = 0)::INTEGER AS os FROM part),
code AS (SELECT *, 'm' || key || '.py' AS path, 'py' AS kind, (os + 2 + secret + 2 * nc + 2 * nf + 2 + 2 * k + pad)::INTEGER AS lines,
  CASE WHEN os = 1 THEN 'import os' || chr(10) ELSE '' END || 'import m' || (key + 1) || chr(10) || 'm' || (key + 1) || '.go()' || chr(10)
  || CASE WHEN secret = 1 THEN 'password = "{SECRET}"' || chr(10) ELSE '' END
  || {_REPEATED.format(n="nc", line="'class C' || i || ':' || chr(10) || '    pass' || chr(10)")}
  || {_REPEATED.format(n="nf", line="'def f' || i || '():' || chr(10) || '    return ' || i || chr(10)")}
  || 'def work(x):' || chr(10) || {_REPEATED.format(n="k", line="'    if x == ' || i || ':' || chr(10) || '        pass' || chr(10)")}
  || '    return x' || chr(10) || repeat('# pad' || chr(10), pad::BIGINT) AS text FROM p
UNION ALL SELECT * REPLACE (0 AS k, 0 AS nc, 0 AS nf, 0 AS pad, 0 AS secret, 0 AS os), 'm' || key || '/__init__.py', 'init', 0, '' FROM p WHERE key % 7 = 0
UNION ALL SELECT * REPLACE (1 AS k, 0 AS nc, 0 AS nf, 0 AS pad, 0 AS secret, 0 AS os), 'w' || key || '.js', 'js', 1, 'if (x) {{ y }}' || chr(10) FROM p WHERE key % 5 = 0)"""
_METRICS = f"""{_CODE},
m AS (SELECT repo_id, path, kind, lines, (CASE WHEN kind = 'py' THEN nf + 1 ELSE 0 END)::INTEGER AS functions, nc::INTEGER AS classes,
  (CASE WHEN kind = 'py' THEN os + 1 ELSE 0 END)::INTEGER AS imports, 0 AS loops, k::INTEGER AS conditionals, (1 + k)::INTEGER AS complexity_score FROM code)"""
_BAND = "CASE WHEN complexity_score < 10 THEN 'Low' WHEN complexity_score < 20 THEN 'Medium' ELSE 'High' END"
_FOUND = f"""{_METRICS},
found AS (SELECT repo_id, path AS file, 0 AS ord, 'Long Function' AS type, 'Medium' AS severity, 'work has ' || (2 + 2 * k) || ' lines.' AS message FROM code WHERE kind = 'py' AND 2 + 2 * k > 50
UNION ALL SELECT repo_id, path, 0, 'High Complexity', 'High', 'work complexity = ' || (1 + k) FROM code WHERE kind = 'py' AND 1 + k > 10
UNION ALL SELECT repo_id, path, 0, 'Parse Error', 'High', 'Unable to parse source code.' FROM code WHERE kind = 'js'
UNION ALL SELECT repo_id, path, 1, 'Unused Variable', 'Low', 'password assigned but never used.' FROM code WHERE secret = 1
UNION ALL SELECT repo_id, path, 2, 'Hardcoded Password', 'Critical', 'Matches of the rule: 1' FROM code WHERE secret = 1
UNION ALL SELECT repo_id, path, 4, 'Unused Import', 'Low', 'os imported but never used.' FROM code WHERE os = 1)"""
_POINTS = scores.points_sql("severity", scores.FILE_RISK)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = p.count()
    enough = max(WAVES * spark.sparkContext.defaultParallelism, n // MOST_PARTS + 1)
    p = p.repartition(min(n // PARTS + 1, enough), "p_partkey")
    rows = p.select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"), F.lit(".py").alias("ext"), F.expr(_MODULE).alias("text"))
    package = p.where("p_partkey % 7 = 0").select("p_brand", F.concat(F.lit("m"), "p_partkey", F.lit("/__init__.py")), F.lit(".py"), F.lit(""))
    script = p.where("p_partkey % 5 = 0").select("p_brand", F.concat(F.lit("w"), "p_partkey", F.lit(".js")), F.lit(".js"), F.lit("if (x) { y }\n"))
    return rows.union(package).union(script)


def code(spark: SparkSession, sf_dir: str, fixed: bool = False, parts: tuple[str, ...] = tuple(PARSED)) -> Repository:
    return Repository(code_files(spark, sf_dir), fixed, parts)


@query(f"WITH {_METRICS} SELECT m.* EXCLUDE (kind), {_BAND} AS risk FROM m")
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity by the tree where there is one, by keywords in the scripts."""
    return code(spark, sf_dir, parts=("metrics",)).wide_metrics


@query(f"WITH {_FOUND} SELECT repo_id, file, type, severity, message FROM found")
def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir, parts=("findings",)).all_findings.select("repo_id", "file", "type", "severity", "message")


_ARCH = f"""{_FOUND},
arch AS (SELECT repo_id, NULL AS file, 'Large Repository' AS type, 'Medium' AS severity, 'Repository contains ' || count(*) || ' files.' AS message FROM code GROUP BY repo_id HAVING count(*) > 100
UNION ALL SELECT repo_id, path, 'Large Module', 'Medium', path || ' has ' || lines || ' lines.' FROM code WHERE lines > 300
UNION ALL SELECT repo_id, path, 'God Module', 'High', path || ' has ' || lines || ' lines, ' || (nf + 1) || ' functions, ' || nc || ' classes.' FROM code WHERE kind = 'py' AND (lines > 500 OR nf + 1 > 20 OR nc > 10))"""


@query(f"WITH {_ARCH} SELECT * FROM arch")
def code_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir, parts=("sizes",)).architecture.select("repo_id", "file", "type", "severity", "message")


@query(f"WITH {_ARCH} SELECT repo_id, greatest(0, 100 - sum(CASE type WHEN 'God Module' THEN 15 WHEN 'Large Module' THEN 5 ELSE 3 END))::INTEGER AS architecture_score FROM arch GROUP BY repo_id")
def code_architecture_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.architecture_score(code(spark, sf_dir, parts=("sizes",)).architecture, ["repo_id"])


_RISK = f"""{_FOUND},
risk AS (SELECT c.repo_id, path AS file, coalesce(sum({_POINTS}) FILTER (WHERE type IS NOT NULL), 0)::INTEGER AS risk_score, count(type)::INTEGER AS issues
  FROM code c LEFT JOIN found f ON f.repo_id = c.repo_id AND f.file = c.path WHERE kind <> 'js' GROUP BY c.repo_id, path)"""


@query(f"WITH {_RISK} SELECT * FROM risk")
def code_file_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without findings are there too."""
    return code(spark, sf_dir, parts=("findings",)).file_risks


_DEBT = f"""{_FOUND},
issues AS (SELECT repo_id, file, count(*) AS n FROM found GROUP BY ALL),
debt AS (SELECT m.repo_id, path AS file, greatest(0, 100 - 5 * coalesce(n, 0) - 2 * complexity_score - CASE WHEN lines > 500 THEN 10 ELSE 0 END)::INTEGER AS score,
  coalesce(n, 0)::INTEGER AS issues, complexity_score AS complexity, lines AS loc FROM m LEFT JOIN issues i ON i.repo_id = m.repo_id AND i.file = m.path)"""
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"


@query(f"WITH {_DEBT} SELECT *, {_GRADE} AS grade, row_number() OVER (ORDER BY score, repo_id, file) AS place FROM debt")
def code_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least score first: place is the row's place in the operator's order."""
    # Sorted output, numbered in the order it comes in: the partitions of a sort are ranges. It is stored,
    # as a second run of the sort may draw them elsewhere.
    rows = code(spark, sf_dir, parts=("sizes", "findings")).debt
    numbered = stored(rows.select("*", F.monotonically_increasing_id().alias("_at")))
    sizes = numbered.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    numbered = numbered.withColumn("part", F.shiftright("_at", 33)).join(F.broadcast(before), "part")
    return numbered.withColumn("place", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "_at", "before")


@query(f"WITH {_DEBT} SELECT repo_id, replace(regexp_replace(file, '\\.[^./]*$', ''), '/', '.') AS module, (100 - score)::INTEGER AS technical_debt FROM debt")
def code_module_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.debt_by_module(code(spark, sf_dir, parts=("sizes", "findings")).debts)


def _security(spark: SparkSession, sf_dir: str, fixed: bool) -> DataFrame:
    rows = code(spark, sf_dir, fixed, ("findings",)).security
    types = [F.array_join(F.transform(c, lambda x: x["type"]), ",").alias(c) for c in ("secrets", "issues")]
    return rows.select("repo_id", "file", *types)


_SECRETS = "CASE WHEN secret = 1 THEN 'Hardcoded Password' ELSE '' END AS secrets"


@query(f"WITH {_CODE} SELECT repo_id, path AS file, {_SECRETS}, '' AS issues FROM code")
def code_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _security(spark, sf_dir, False)


@query(f"WITH {_CODE} SELECT repo_id, path AS file, {_SECRETS}, CASE WHEN secret = 1 THEN 'Unused Variable,Hardcoded Password' ELSE '' END AS issues FROM code")
def code_security_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type or message names security: the variable is called password."""
    return _security(spark, sf_dir, True)


_GRAPH = f"""{_CODE},
known AS (SELECT repo_id, 'm' || key AS module, max(path) AS path FROM code WHERE kind <> 'js' GROUP BY ALL),
live AS (SELECT code.*, module FROM code JOIN known USING (repo_id, path)),
edges AS (SELECT l.repo_id, l.module AS src, 'm' || (key + 1) AS dst, k.module IS NOT NULL AS internal FROM live l LEFT JOIN known k ON k.repo_id = l.repo_id AND k.module = 'm' || (key + 1) WHERE kind = 'py'
UNION ALL SELECT repo_id, module, 'os', false FROM live WHERE os = 1)"""


@query(f"WITH {_GRAPH} SELECT * FROM known")
def code_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir, parts=()).modules


@query(f"WITH {_GRAPH} SELECT * FROM edges")
def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir, parts=("graph",)).edges


@query(f"WITH {_GRAPH} SELECT repo_id, count(*) FILTER (WHERE internal) AS internal, count(*) FILTER (WHERE NOT internal) AS external FROM edges GROUP BY repo_id")
def code_dependency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir, parts=("graph",)).dependency_counts


@query(f"""WITH {_GRAPH},
n AS (SELECT repo_id, string_agg('{{"id":"' || module || '","label":"' || module || '","title":"' || module || '","shape":"box"}}', ',' ORDER BY module) AS nodes FROM known GROUP BY repo_id),
e AS (SELECT repo_id, string_agg('{{"from":"' || src || '","to":"' || dst || '"}}', ',' ORDER BY src, dst) AS edges FROM edges WHERE internal GROUP BY repo_id)
SELECT n.repo_id, '{{"nodes":[' || nodes || '],"edges":[' || coalesce(edges, '') || ']}}' AS json FROM n LEFT JOIN e USING (repo_id)""")
def code_node_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir, parts=("graph",)).node_link.select("repo_id", "json")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in scores.SEVERITIES)
_HEALTH = f"""{_RISK},
s0 AS (SELECT repo_id, count(*) AS files, sum(functions) AS functions, sum(classes) AS classes, sum(imports) AS imports, floor(sum(complexity_score) / count(*) * 100 + 0.5) / 100 AS avg FROM m GROUP BY repo_id),
s AS (SELECT repo_id, files, round_even(greatest(0.0, 100 - least(0.5 * avg, 40.0) - CASE WHEN functions > 500 THEN 10 WHEN functions > 200 THEN 5 ELSE 0 END
  - CASE WHEN classes > 100 THEN 10 WHEN classes > 50 THEN 5 ELSE 0 END - CASE WHEN imports > 300 THEN 5 WHEN imports > 100 THEN 2 ELSE 0 END), 0)::INTEGER AS health FROM s0),
sev AS (SELECT repo_id, {_COUNTS} FROM found WHERE file LIKE '%.py' GROUP BY repo_id),
five AS (SELECT repo_id, string_agg('- ' || file || ' (' || risk_score || ')', chr(10) ORDER BY risk_score DESC, file) AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC, file) AS r FROM risk) WHERE r <= 5 GROUP BY repo_id)"""


@query(f"""WITH {_HEALTH} SELECT s.repo_id, concat_ws(chr(10), 'Files Analyzed: ' || files, '', 'Critical Findings: ' || coalesce(critical, 0), 'High Findings: ' || coalesce(high, 0),
  'Medium Findings: ' || coalesce(medium, 0), 'Low Findings: ' || coalesce(low, 0), '', 'Repository Health Score: ' || health || '/100', '', 'Top Risk Files:', top) AS summary
FROM s LEFT JOIN sev USING (repo_id) LEFT JOIN five USING (repo_id)""")
def code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir, parts=("sizes", "findings")).summary


def _points(t: tuple) -> str:
    return f"greatest(0, 100 - coalesce(sum({scores.points_sql('severity', t)}), 0))::INTEGER"


@query(f"""WITH {_FOUND},
rated AS (SELECT repo_id, {_points(scores.STATIC)} AS static, {_points(scores.SECURITY)} AS security, {_COUNTS} FROM found GROUP BY repo_id),
five AS (SELECT repo_id, string_agg('- ' || type, chr(10) ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file, ord, CASE type WHEN 'Long Function' THEN 0 ELSE 1 END) AS r FROM found) WHERE r <= 5 GROUP BY repo_id)
SELECT repo_id, concat_ws(chr(10), 'Code Quality Score: 70/100', 'Static Analysis Score: ' || static || '/100', 'Security Score: ' || security || '/100', '', 'Critical Issues: ' || critical, 'High Issues: ' || high,
  'Medium Issues: ' || medium, 'Low Issues: ' || low, '', 'Top Findings:', top) AS summary FROM rated JOIN five USING (repo_id)""")
def code_executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code(spark, sf_dir, parts=("findings",)).all_findings
    by = ["repo_id"]
    rated = scores.static_score(found, by).join(scores.security_score(found, by), by).join(scores.severity_distribution(found, by), by)
    return reports.executive_summary(rated.withColumn("score", F.lit(70)), found)


def _reviewer(prompt: str) -> str:
    """Fails on some files, so that others take their place."""
    if "import os" in prompt:
        raise ValueError("no review")
    return f"{prompt.count('# pad')}/100"


_REVIEWED = f"""{_CODE},
ok AS (SELECT repo_id, path, pad || '/100' AS review, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS r FROM code WHERE os = 0)"""


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ask(files: DataFrame) -> DataFrame:
        return reviews.prompts(files, reports.findings_text(Repository(files, parts=("findings",)).findings))

    return reviews.review(code(spark, sf_dir).of("reviewer"), _reviewer, ask=ask)


@query(f"WITH {_REVIEWED} SELECT repo_id, path AS file, review FROM ok WHERE r <= 3")
def code_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir)


@query(f"""WITH {_REVIEWED} SELECT repo_id, chr(10) || 'Repository AI Summary' || chr(10) || chr(10) || 'Files Reviewed: ' || count(*) || chr(10) || chr(10)
  || string_agg(chr(10) || chr(10) || 'File: ' || path || chr(10) || review || chr(10), '' ORDER BY path) AS summary FROM ok WHERE r <= 3 GROUP BY repo_id""")
def code_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.review_summary(_reviews(spark, sf_dir))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_REPORT = f"""{_FOUND},
blocks AS (SELECT repo_id, file, string_agg(concat_ws(chr(10), 'Type: ' || type, 'Severity: ' || severity, 'Message: ' || message, CASE ord WHEN 2 THEN 'Count: 1' END, ''), chr(10)
  ORDER BY ord, CASE type WHEN 'Long Function' THEN 0 ELSE 1 END) AS report FROM found GROUP BY ALL)"""


def _prompt_sql(before: str, after: str) -> str:
    return f"{_quoted(before)} || text || {_quoted(reviews.FINDINGS)} || coalesce(report, {_quoted(reviews.NO_FINDINGS)}) || {_quoted(after)}"


@query(f"""WITH {_REPORT} SELECT c.repo_id, path, md5({_prompt_sql(reviews.REVIEW, reviews.QUESTIONS)}) AS review, md5({_prompt_sql(reviews.FIX, reviews.FIXES)}) AS fixes
FROM code c LEFT JOIN blocks b ON b.repo_id = c.repo_id AND b.file = c.path""")
def code_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = code(spark, sf_dir, parts=("findings",))
    rows = reviews.both_prompts(r.files, reports.findings_text(r.all_findings))
    return rows.select("repo_id", "path", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("review", "fixes")))


@query(f"WITH {_REPORT} SELECT repo_id, file, report || chr(10) AS report FROM blocks")
def code_strict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.findings_text(code(spark, sf_dir, parts=("findings",)).all_findings, strict=True)


# Files as bytes: some with other line ends, some in folders that an analysis prunes, some with upper
# case endings, some that aren't text, some that no analysis wants.
_STORED = f"""{_CODE},
stored AS (SELECT repo_id, CASE WHEN kind = 'js' AND key % 2 = 0 THEN 'node_modules/' || path WHEN kind = 'py' AND key % 9 = 0 THEN 'm' || key || '.PY' ELSE path END AS path, text FROM code)"""


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_files(spark, sf_dir)
    key = F.regexp_extract("path", "[0-9]+", 0).cast("long")
    windows = F.when(key % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    script = F.col("path").endswith(".js") & (key % 2 == 0)
    shout = F.col("path").rlike(r"^m[0-9]+\.py$") & (key % 9 == 0)
    path = F.when(script, F.concat(F.lit("node_modules/"), "path")).when(shout, F.regexp_replace("path", "py$", "PY")).otherwise(F.col("path"))
    rows = rows.select("repo_id", path.alias("path"), windows.cast("binary").alias("content"))
    p = table(spark, sf_dir, "part").where("p_partkey % 11 = 0")
    broken = p.select("p_brand", F.concat(F.lit("broken"), "p_partkey", F.lit(".py")), F.unhex(F.lit("FFFE00")))
    other = p.select("p_brand", F.concat(F.lit("notes"), "p_partkey", F.lit(".txt")), F.encode(F.lit("notes"), "utf-8"))
    return rows.union(broken).union(other)


_POLICIES = " UNION ALL ".join(
    f"SELECT '{name}' AS policy, repo_id, path, md5(text) AS md5 FROM stored WHERE {test}"
    for name, test in (
        ("metrics", "path SIMILAR TO '.*\\.(py|js)'"),
        ("wide", "path SIMILAR TO '.*\\.(py|js)'"),
        ("python", "path LIKE '%.py'"),
        ("reviewer", "true"),
        ("explorer", "path NOT LIKE 'node_modules/%'"),
    )
)


@query(f"WITH {_STORED} {_POLICIES}")
def folder_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files written to a folder and read back, as each analysis sees them."""
    root = shared_dir(spark)
    sources.write_folder(_bytes(spark, sf_dir), root)
    rows = sources.read_folder(spark, root, repo_id=None)
    seen = F.filter(F.array(*(F.when(sources.belongs(F.col("path"), p), F.lit(p)) for p in sources.POLICIES)), lambda x: x.isNotNull())
    return rows.select(F.explode(seen).alias("policy"), "repo_id", "path", F.md5(F.col("text").cast("binary")).alias("md5"))


@query(f"""WITH {_STORED}, p2 AS (SELECT repo_id, count(*) AS n FROM p WHERE key % 11 = 0 GROUP BY repo_id)
SELECT repo_id, (count(*) + coalesce(max(n), 0))::BIGINT AS n_files, md5(string_agg(chr(10) || chr(10) || '# FILE: ' || regexp_extract(path, '[^/]*$') || chr(10) || chr(10) || text, '' ORDER BY path)) AS md5
FROM stored LEFT JOIN p2 USING (repo_id) WHERE path SIMILAR TO '.*\\.(py|js)' GROUP BY repo_id""")
def folder_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not text count, but add nothing."""
    root = shared_dir(spark)
    sources.write_folder(_bytes(spark, sf_dir), root)
    rows = sources.concatenated(sources.read_folder(spark, root, repo_id=None, unreadable=True))
    return rows.select("repo_id", "n_files", F.md5(F.col("text").cast("binary")).alias("md5"))


@query(f"""WITH {_STORED} SELECT repo_id, path, md5(text) AS md5 FROM stored
UNION ALL SELECT repo_id, 'notes' || key || '.txt', md5('notes') FROM p WHERE key % 11 = 0""")
def zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository written as an archive and read back."""
    root = shared_dir(spark)
    sources.write_zips(_bytes(spark, sf_dir), root)
    rows = sources.read_zips(spark, root)
    return rows.select(F.regexp_extract("repo_id", r"([^/]*)\.zip$", 1).alias("repo_id"), "path", F.md5(F.col("text").cast("binary")).alias("md5"))


@query(f"""WITH {_FOUND} SELECT repo_id, file, type, CASE type WHEN 'Hardcoded Password' THEN 'security' WHEN 'Long Function' THEN 'performance' WHEN 'Unused Variable' THEN 'smells' WHEN 'Unused Import' THEN 'smells' ELSE 'other' END AS theme FROM found""")
def code_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.by_theme(code(spark, sf_dir, parts=("findings",)).all_findings).select("repo_id", "file", "type", "theme")


@query(f"""WITH {_GRAPH}, risky AS (SELECT repo_id, module FROM known JOIN code USING (repo_id, path) WHERE 1 + k >= 20)
SELECT e.repo_id, src, dst FROM edges e JOIN risky a ON a.repo_id = e.repo_id AND a.module = src JOIN risky b ON b.repo_id = e.repo_id AND b.module = dst""")
def code_risky_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between modules of high complexity."""
    r = code(spark, sf_dir, parts=("sizes", "graph"))
    nodes = r.modules.join(r.sizes.select("repo_id", "path", "risk"), ["repo_id", "path"]).withColumnRenamed("module", "node")
    return graph.filter_edges(r.edges, graph.nodes_where(nodes, "risk", ["High"])).select("repo_id", "src", "dst")


@query(f"WITH {_GRAPH} SELECT repo_id, src AS node FROM edges WHERE internal UNION SELECT repo_id, dst FROM edges WHERE internal")
def code_linked_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ends_where(code(spark, sf_dir, parts=("graph",)).edges, "internal", ["true"])
