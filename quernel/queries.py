"""The registered queries of the core library, with their SQL.

The driver's tables stand in for repositories: documents are files and their sources repositories,
orders are findings by their priority. In the module graph parts are modules and quarters
repositories: a line of an order imports the part of the order's next line. codebase.py has source
code made from the part table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel import codebase  # noqa: F401  registers its queries
from quernel.functions import lexical
from quernel.functions.astfacts import ast_facts
from quernel.operators import findings, graph, rankings, reports, reviews, scores
from quernel.plans.shared import stored
from quernel.registry import QUERIES, SQL, Query, query, table
from quernel.sources.files import SCHEMA, from_table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "documents"))


#: Priorities as severities; one is unknown on purpose.
_SEVERITY = {"1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "NOT SPECIFIED", "5-LOW": "Low"}
_SEVERITY_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEVERITY.items()) + " END"
_TYPES = tuple(scores.FIXES) + ("High Complexity", "Parse Error", "OpenAI API Key", "MongoDB URL")
_TYPE_SQL = "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("seq"), F.expr(_SEVERITY_SQL).alias("severity"), F.expr(_TYPE_SQL).alias("type"))


_ORDERS = f"f AS (SELECT o_custkey AS custkey, o_orderkey AS seq, {_SEVERITY_SQL} AS severity, {_TYPE_SQL} AS type FROM orders)"
_M = lexical.metrics_sql()
_STATS = f"""{_M},
s0 AS (SELECT repo_id, count(*) AS files, sum(lines)::BIGINT AS lines, sum(functions)::BIGINT AS functions, sum(classes)::BIGINT AS classes, sum(imports)::BIGINT AS imports, sum(complexity_score)::BIGINT AS c FROM m GROUP BY repo_id),
s AS (SELECT repo_id, files, lines, functions, classes, imports, floor(c / files * 100 + 0.5) / 100 AS avg_complexity FROM s0)"""


@query(f"WITH {_M} SELECT * FROM m")
def lexical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.metrics(files(spark, sf_dir))


@query(f"WITH {_STATS} SELECT * FROM s")
def repo_metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.repository_metrics(lexical_metrics(spark, sf_dir))


@query(f"""WITH {_STATS},
h AS (SELECT *, round_even(greatest(0.0, least(100.0, 100 - least(0.5 * avg_complexity, 40.0) - CASE WHEN functions > 500 THEN 10 WHEN functions > 200 THEN 5 ELSE 0 END
  - CASE WHEN classes > 100 THEN 10 WHEN classes > 50 THEN 5 ELSE 0 END - CASE WHEN imports > 300 THEN 5 WHEN imports > 100 THEN 2 ELSE 0 END)), 0)::INTEGER AS health_score FROM s)
SELECT *, CASE WHEN health_score >= 80 THEN 'Excellent' WHEN health_score >= 60 THEN 'Good' WHEN health_score >= 40 THEN 'Fair' ELSE 'Poor' END AS health FROM h""")
def health_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.health(repo_metrics_by_source(spark, sf_dir))


@query(f"WITH {_STATS} SELECT repo_id, u.metric, u.value FROM s, LATERAL (VALUES ('Files', files), ('Functions', functions), ('Classes', classes), ('Imports', imports)) u(metric, value)")
def overview_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.overview(repo_metrics_by_source(spark, sf_dir))


@query(f"""WITH {_STATS} SELECT repo_id, chr(10) || 'Repository Summary' || chr(10) || chr(10) || 'This repository contains ' || files || ' source files.' || chr(10) || chr(10) || 'Statistics:' || chr(10)
  || '- Total Files: ' || files || chr(10) || '- Total Lines: ' || lines || chr(10) || '- Total Functions: ' || functions || chr(10) || '- Total Classes: ' || classes || chr(10) || '- Total Imports: ' || imports || chr(10) || chr(10)
  || 'Assessment:' || chr(10) || chr(10) || CASE WHEN avg_complexity > 15 THEN '- High complexity detected. Consider refactoring large functions.' ELSE '- Complexity appears manageable.' END || chr(10)
  || CASE WHEN functions > 50 THEN '- Large codebase with many functions.' || chr(10) ELSE '' END || CASE WHEN classes > 20 THEN '- Object-oriented structure detected.' || chr(10) ELSE '' END
  || chr(10) || 'Overall repository health appears reasonable. Further AI analysis is recommended.' AS summary FROM s""")
def repository_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.repository_summary(repo_metrics_by_source(spark, sf_dir))


@query(f"WITH {_M} SELECT path AS file, complexity_score AS complexity, lines AS loc FROM m")
def complexity_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.heatmap(lexical_metrics(spark, sf_dir))


@query(f"WITH {_M} SELECT path AS file, lines, complexity_score AS complexity, risk FROM m")
def file_complexity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.complexity_risk(lexical_metrics(spark, sf_dir))


_ARCH = f"""{_M}, arch AS (SELECT repo_id, NULL::VARCHAR AS file, 0 AS ord, 'Large Repository' AS type, 'Medium' AS severity, 'Repository contains ' || count(*) || ' files.' AS message FROM m GROUP BY repo_id HAVING count(*) > 40
UNION ALL SELECT repo_id, path, 1, 'Large Module', 'Medium', path || ' has ' || lines || ' lines.' FROM m WHERE lines > 30)"""


def _architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are short: lower limits than the operator's own."""
    rows = findings.architecture(files(spark, sf_dir), limits=findings.Limits(files=40, lines=30))
    return rows.select("repo_id", "file", "ord", "type", "severity", "message")


@query(f"WITH {_ARCH} SELECT * FROM arch")
def architecture_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _architecture(spark, sf_dir)


@query(f"WITH {_ARCH} SELECT repo_id, greatest(0, least(100, 100 - sum(CASE type WHEN 'God Module' THEN 15 WHEN 'Large Module' THEN 5 WHEN 'Large Repository' THEN 3 ELSE 0 END)))::INTEGER AS architecture_score FROM arch GROUP BY repo_id")
def architecture_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.architecture_score(_architecture(spark, sf_dir), ["repo_id"])


_RULES = " UNION ALL ".join(f"SELECT source AS repo_id, doc_id || '.py' AS file, {k} AS seq, '{t}' AS type, '{s}' AS severity, len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))::INTEGER AS count FROM documents" for k, (t, s, p) in enumerate(findings.SECRET_RULES))
_SECRETS = f"x AS ({_RULES}), f AS (SELECT repo_id, file, 2 AS ord, seq, type, severity, 'Matches of the rule: ' || count AS message, count FROM x WHERE count > 0)"


@query(f"WITH {_SECRETS} SELECT * FROM f")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.secrets(files(spark, sf_dir))


_SECURITY_TEST = " OR ".join(f"contains(type, '{w}')" for w in findings.SECURITY_TYPES)
_COUNTS = "count(*) FILTER (WHERE severity = 'Critical')::INTEGER AS critical, count(*) FILTER (WHERE severity = 'High')::INTEGER AS high, count(*) FILTER (WHERE severity = 'Medium')::INTEGER AS medium"


@query(f"WITH {_ORDERS} SELECT custkey, {_COUNTS}, count(*) FILTER (WHERE severity IS NULL OR severity NOT IN ('Critical', 'High', 'Medium'))::INTEGER AS low, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM f WHERE {_SECURITY_TEST} GROUP BY custkey")
def security_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.security_summary(order_findings(spark, sf_dir), ["custkey"]).withColumn("types", F.array_join("types", ","))


def _by_customer(name: str, table_: tuple, floor: bool) -> str:
    total = f"sum({scores.points_sql('severity', table_)})"
    return f"WITH {_ORDERS} SELECT custkey, " + (f"greatest(0, 100 - {total})::INTEGER AS {name}" if floor else f"{total}::INTEGER AS {name}, count(*)::INTEGER AS issues") + " FROM f GROUP BY custkey"


@query(_by_customer("static_score", scores.STATIC, True))
def static_score_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.static_score(order_findings(spark, sf_dir), ["custkey"])


@query(_by_customer("security_score", scores.SECURITY, True))
def security_score_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.security_score(order_findings(spark, sf_dir), ["custkey"])


@query(_by_customer("risk_score", scores.FILE_RISK, False))
def file_risk_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.file_risk(order_findings(spark, sf_dir), ["custkey"])


@query(f"WITH {_ORDERS} SELECT {_COUNTS}, count(*) FILTER (WHERE severity = 'Low')::INTEGER AS low FROM f")
def severity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.severity_distribution(order_findings(spark, sf_dir), [])


@query(f"WITH {_ORDERS} SELECT custkey, {_COUNTS}, count(*) FILTER (WHERE severity IS NULL OR severity NOT IN ('Critical', 'High', 'Medium'))::INTEGER AS low FROM f GROUP BY custkey")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.severity_counts(order_findings(spark, sf_dir), ["custkey"])


_FIX_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scores.FIXES.items()) + " END"


@query(f"WITH {_ORDERS}, g AS (SELECT type AS issue, custkey, seq, coalesce(severity, 'Unknown') AS severity, {_FIX_SQL} AS fix FROM f) SELECT * FROM g WHERE fix IS NOT NULL")
def fix_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.fix_suggestions(order_findings(spark, sf_dir))


@query("SELECT coalesce(event_type, 'Unknown') AS cause, count(*) AS n FROM events GROUP BY 1")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.root_causes(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT 'Unknown' AS cause, count(*) AS n FROM events HAVING count(*) > 0")
def root_causes_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.root_causes(table(spark, sf_dir, "events"), None, "event_id")


_THEME = f"CASE WHEN {_SECURITY_TEST} THEN 'security' WHEN type IN ('Long Function', 'Deep Nesting') THEN 'performance' WHEN type IN ('Unused Variable', 'Unused Import', 'Duplicate Function', 'Too Many Parameters', 'Dead Function') THEN 'smells' ELSE 'other' END"


@query(f"WITH {_ORDERS} SELECT {_THEME} AS theme, type, count(*) AS n FROM f GROUP BY ALL")
def findings_by_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.by_theme(order_findings(spark, sf_dir)).groupBy("theme", "type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)
UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)
UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def unused_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no row of another table names, as an unused import is named by no expression."""
    out = None
    for kind, own, key, other, ref in (
        ("customer", "customer", "c_custkey", "orders", "o_custkey"),
        ("part", "part", "p_partkey", "lineitem", "l_partkey"),
        ("order", "orders", "o_orderkey", "lineitem", "l_orderkey"),
        ("document", "documents", "doc_id", "labels", "doc_id"),
    ):
        named = table(spark, sf_dir, other).select(F.col(ref).alias("id")).distinct()
        rows = table(spark, sf_dir, own).select(F.lit(kind).alias("kind"), F.col(key).alias("id")).join(named, "id", "left_anti").select("kind", "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT doc_id, first AS duplicates FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal texts, by an aggregation over fingerprints: no group meets in one task."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("duplicates"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(first, "key").where("doc_id <> duplicates").select("doc_id", "duplicates")


_LINES = """l AS (SELECT DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS repo_id, l_orderkey, l_linenumber, 'p' || l_partkey AS module, l_partkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
known AS (SELECT DISTINCT repo_id, module FROM l),
links AS (SELECT DISTINCT a.repo_id, a.module AS src, b.module AS dst, b.l_partkey FROM l a JOIN l b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
_EDGES = f"{_LINES}, e AS (SELECT repo_id, src, dst, p_size > 5 AS internal FROM links JOIN part ON l_partkey = p_partkey)"
_DEGREES = f"""{_EDGES},
ex AS (SELECT repo_id, src AS module, count(*) FILTER (WHERE internal)::INTEGER AS imports, count(*) FILTER (WHERE NOT internal)::INTEGER AS external_imports FROM e GROUP BY ALL),
im AS (SELECT repo_id, dst AS module, count(*)::INTEGER AS imported_by FROM e WHERE internal GROUP BY ALL),
d AS (SELECT repo_id, module, coalesce(imports, 0) AS imports, coalesce(imported_by, 0) AS imported_by, coalesce(external_imports, 0) AS external_imports
  FROM known LEFT JOIN ex USING (repo_id, module) LEFT JOIN im USING (repo_id, module))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("repo_id"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return line.join(o, "l_orderkey").withColumn("module", F.concat(F.lit("p"), "l_partkey"))


def _order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(repo_id, module) and edges (repo_id, src, dst, internal); parts of small size are external."""
    rows = _lines(spark, sf_dir)
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("module").alias("dst"), F.col("l_partkey").alias("p_partkey"))
    e = rows.join(after, ["l_orderkey", "l_linenumber"]).select("repo_id", F.col("module").alias("src"), "dst", "p_partkey").distinct()
    size = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 5).alias("internal"))
    return rows.select("repo_id", "module").distinct(), e.join(size, "p_partkey").select("repo_id", "src", "dst", "internal")


@query(f"WITH {_EDGES} SELECT * FROM e")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_graph(spark, sf_dir)[1]


@query(f"WITH {_DEGREES} SELECT * FROM d")
def degree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*_order_graph(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT repo_id, count(*) FILTER (WHERE internal) AS internal, count(*) FILTER (WHERE NOT internal) AS external FROM e GROUP BY repo_id")
def dependency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_counts(import_edges(spark, sf_dir))


@query(f"WITH {_DEGREES} SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY imported_by DESC, module) <= 10")
def most_depended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(degree_counts(spark, sf_dir), "imported_by")


@query(f"WITH {_DEGREES} SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY imports DESC, module) <= 10")
def most_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(degree_counts(spark, sf_dir), "imports")


@query(f"""WITH {_EDGES}, b AS (SELECT repo_id, src AS a, dst AS b FROM e UNION SELECT repo_id, dst, src FROM e)
SELECT repo_id, module AS center, module AS node FROM known UNION SELECT repo_id, a, b FROM b UNION SELECT x.repo_id, x.a, y.b FROM b x JOIN b y ON y.repo_id = x.repo_id AND y.a = x.b""")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, e = _order_graph(spark, sf_dir)
    return graph.neighbourhood(e, known.withColumnRenamed("module", "node"))


@query(f"""WITH {_EDGES}, t AS (SELECT repo_id, src, dst FROM e)
SELECT repo_id, src || '>' || dst AS path FROM t WHERE src = dst
UNION SELECT a.repo_id, a.src || '>' || a.dst || '>' || a.src FROM t a JOIN t b ON b.repo_id = a.repo_id AND b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
UNION SELECT a.repo_id, a.src || '>' || a.dst || '>' || b.dst || '>' || a.src FROM t a JOIN t b ON b.repo_id = a.repo_id AND b.src = a.dst
  JOIN t c ON c.repo_id = a.repo_id AND c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def cycles_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of at most three modules: the length is the query's."""
    return graph.cycles(stored(import_edges(spark, sf_dir)), 3).select("repo_id", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {_EDGES}, r(repo_id, a, b) AS (SELECT repo_id, src, dst FROM e UNION SELECT r.repo_id, a, dst FROM r JOIN e ON e.repo_id = r.repo_id AND b = src)
SELECT x.repo_id, x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a GROUP BY ALL""")
def nodes_on_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.on_cycles(import_edges(spark, sf_dir))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/.]+', '.', 'g') AS name FROM pages WHERE url IS NOT NULL), k AS (SELECT DISTINCT regexp_extract(name, '^[^.]+(\.[^.]+)?') AS module FROM p),
x AS (SELECT page_id, name, unnest(range(1, len(string_split(name, '.')) + 1)) AS n FROM p)
SELECT page_id, max(module) AS resolved FROM (SELECT x.page_id, module, row_number() OVER (PARTITION BY x.page_id ORDER BY n DESC) AS r FROM x JOIN k ON module = array_to_string(string_split(name, '.')[1:n], '.')) WHERE r = 1 GROUP BY page_id""")
def prefix_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[/.]+", ".")
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.lit("web").alias("repo_id"), "page_id", bare.alias("name"))
    known = p.select("repo_id", F.regexp_extract("name", r"^[^.]+(\.[^.]+)?", 0).alias("module")).distinct()
    return graph.resolve(p, known).where("resolved IS NOT NULL").select("page_id", "resolved")


_DEBT = f"""{_SECRETS}, {_M}, n AS (SELECT repo_id, file, count(*)::INTEGER AS issues FROM f GROUP BY ALL),
debt AS (SELECT m.repo_id, path AS file, greatest(0, 100 - 5 * coalesce(issues, 0) - 2 * complexity_score - CASE WHEN lines > 500 THEN 10 ELSE 0 END)::INTEGER AS score, coalesce(issues, 0) AS issues, complexity_score AS complexity, lines AS loc
  FROM m LEFT JOIN n ON n.repo_id = m.repo_id AND n.file = m.path)"""
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"


@query(f"WITH {_DEBT} SELECT *, {_GRADE} AS grade FROM debt")
def debt_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and rules in one projection over one scan."""
    rows = files(spark, sf_dir).withColumn("issues", findings.n_secret_rules(F.col("text")))
    return scores.debt(lexical.metrics(rows, keep=("issues",)))


@query(f"WITH {_DEBT} SELECT repo_id, floor(avg(score) * 100 + 0.5) / 100 AS debt_score, count(*) AS files FROM debt GROUP BY repo_id")
def debt_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.repository_debt(debt_by_document(spark, sf_dir))


# A part's returned lines of a quarter are its debt; parts without any have no score.
_RISK = f"""{_DEGREES},
nd AS (SELECT repo_id, module, greatest(0, 100 - 20 * count(*))::INTEGER AS score FROM l WHERE l_returnflag = 'R' GROUP BY ALL),
nc AS (SELECT repo_id, module, count(*)::INTEGER AS c FROM l GROUP BY ALL),
risk AS (SELECT repo_id, module, (2 * imports + 3 * imported_by + external_imports + coalesce(100 - score, 0))::INTEGER AS risk_score, coalesce(100 - score, 0)::INTEGER AS technical_debt,
  imports, imported_by, external_imports FROM d LEFT JOIN nd USING (repo_id, module))"""


def _part_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.concat("module", F.lit(".py")))


def _part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("repo_id", "l_orderkey", "l_linenumber", "module", "l_partkey", "l_returnflag").distinct()


def _part_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_lines(spark, sf_dir).where("l_returnflag = 'R'").groupBy("repo_id", "module")
    return _part_file(rows.agg(F.greatest(F.lit(0), 100 - 20 * F.count(F.lit(1))).cast("int").alias("score"))).drop("module")


def _part_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_lines(spark, sf_dir).groupBy("repo_id", "module").agg(F.count(F.lit(1)).cast("int").alias("complexity_score"))
    return _part_file(rows).withColumnRenamed("file", "path").drop("module")


@query(f"WITH {_RISK} SELECT * FROM risk")
def module_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.module_risk(degree_counts(spark, sf_dir), rankings.debt_by_module(_part_debt(spark, sf_dir)))


@query(f"WITH {_RISK} SELECT repo_id, module, risk_score AS priority_score, risk_score, 0 AS complexity, 100 AS technical_debt FROM risk")
def refactoring_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.refactoring(module_risk(spark, sf_dir), _part_metrics(spark, sf_dir), _part_debt(spark, sf_dir))


@query(f"""WITH {_RISK} SELECT r.repo_id, r.module, (risk_score + c + 100 - coalesce(score, 100))::INTEGER AS priority_score, risk_score, c AS complexity, coalesce(score, 100)::INTEGER AS technical_debt
FROM risk r JOIN nc USING (repo_id, module) LEFT JOIN nd USING (repo_id, module)""")
def refactoring_priority_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _part_file(_order_graph(spark, sf_dir)[0]).withColumnRenamed("file", "path")
    return rankings.refactoring(module_risk(spark, sf_dir), _part_metrics(spark, sf_dir), _part_debt(spark, sf_dir), known)


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*)::INTEGER AS n FROM events GROUP BY ALL), h AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY day), 65) AS old FROM d)
SELECT event_type, day::VARCHAR AS day, old AS old_score, n AS new_score, n - old AS difference, CASE WHEN n > old THEN 'Improved' WHEN n < old THEN 'Declined' ELSE 'Unchanged' END AS status FROM h""")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return reviews.history(rows, ["event_type"], "day", "n").withColumn("day", F.col("day").cast("string"))


@query(r"""WITH r AS (SELECT conv_id, turn, 'Severity: ' || CASE role WHEN 'user' THEN 'High' WHEN 'assistant' THEN 'critical' ELSE 'Low' END || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Score: ' || length(text) || ' /100' ELSE text END AS review FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(review, '(\d+)\s*/\s*100', 1), '')::INTEGER, -1) AS score, len(regexp_extract_all(review, '(?i)Severity:\s*Critical'))::INTEGER AS critical, len(regexp_extract_all(review, '(?i)Severity:\s*High'))::INTEGER AS high,
 len(regexp_extract_all(review, '(?i)Severity:\s*Medium'))::INTEGER AS medium, len(regexp_extract_all(review, '(?i)Severity:\s*Low'))::INTEGER AS low FROM r""")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL")
    head = F.when(F.col("role") == "user", "High").when(F.col("role") == "assistant", "critical").otherwise("Low")
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Score: "), F.length("text").cast("string"), F.lit(" /100"))).otherwise(F.col("text"))
    rows = c.select("conv_id", "turn", F.concat(F.lit("Severity: "), head, F.lit("\n"), body).alias("review"))
    return reviews.parsed(rows).select("conv_id", "turn", F.coalesce("score", F.lit(-1)).alias("score"), "critical", "high", "medium", "low")


#: A review's parts, as a reviewer may order them; the second turn's lacks some.
_PARTS = ("'Security Vulnerabilities: turn ' || turn", "'Performance Issues of ' || conv_id || chr(10) || 'more'", "'Code Smell here, ' || role")


@query(f"""WITH c AS (SELECT * FROM conversations WHERE role IS NOT NULL)
SELECT conv_id, turn, {_PARTS[0]} AS security, CASE WHEN turn % 2 = 0 THEN {_PARTS[1]} ELSE 'No performance issues detected.' END AS performance,
  CASE WHEN turn % 3 = 0 THEN {_PARTS[2]} ELSE 'No code smells detected.' END AS smells FROM c""")
def review_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role IS NOT NULL")
    security, performance, smells = (F.expr(p.replace("chr(10)", "'\\n'")) for p in _PARTS)
    end = F.concat(F.lit("\n\n#### "), F.col("turn").cast("string"), F.lit(". next\n"))
    review = F.concat(F.lit("Intro\n"), security, end, F.when(F.col("turn") % 2 == 0, F.concat(performance, end)).otherwise(""), F.when(F.col("turn") % 3 == 0, F.concat(smells, F.lit("  \n### Overall Code Quality Score\n"))).otherwise(""))
    return reviews.parsed(c.select("conv_id", "turn", review.alias("review"))).select("conv_id", "turn", "security", "performance", "smells")


@query(f"""WITH {_SECRETS} SELECT repo_id, file, string_agg('Type: ' || type || chr(10) || 'Severity: ' || severity || chr(10) || 'Message: ' || message || chr(10) || 'Count: ' || count || chr(10), chr(10) ORDER BY seq) AS report FROM f GROUP BY ALL""")
def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.findings_text(secret_findings(spark, sf_dir))


#: Our own snippets for what the documents cannot show, and what must come out of them.
SNIPPETS = {
    "params.py": "def many(a, b, c, d, e, f, g):\n    return a\n\ndef few(a, b, /, c, *d, e=1, **f):\n    return a\n",
    "names.py": "import os\nimport json.decoder\nfrom math import sqrt as root, pi\n\nx = 1\ny = x\nz: int = 2\n\ndef helper():\n    pass\n\ndef main():\n    print(pi)\n",
    "twins.py": "def one(a):\n    return a + 1\n\nclass C:\n    def two(self):\n        return a + 1\n\ndef three(b):\n    return b + 1\n",
    "deep.py": "def d(x):\n    if x:\n        for i in x:\n            if i:\n                g(h(1))\n\ndef flat():\n    pass\n",
    "broken.py": "def (:\n",
    "long.py": "def l():\n" + "    pass\n" * 50 + "\ndef ok():\n" + "    pass\n" * 49,
}


def _snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("repo", p, ".py", t) for p, t in SNIPPETS.items()], SCHEMA)


_AST_ROWS = (
    ("broken.py", "Parse Error", "High", "Unable to parse source code."),
    ("params.py", "Too Many Parameters", "Medium", "many has 7 parameters."),
    ("deep.py", "Deep Nesting", "Medium", "d nesting depth = 8"),
    ("long.py", "Long Function", "Medium", "l has 51 lines."),
    ("names.py", "Unused Import", "Low", "os imported but never used."),
    ("names.py", "Unused Import", "Low", "json.decoder imported but never used."),
    ("names.py", "Unused Import", "Low", "root imported but never used."),
    ("names.py", "Unused Variable", "Low", "y assigned but never used."),
    ("twins.py", "Duplicate Function", "Medium", "two duplicates one"),
    ("params.py", "Duplicate Function", "Medium", "few duplicates many"),
)


@query("SELECT * FROM (VALUES " + ", ".join(str(r) for r in _AST_ROWS) + ") t(file, type, severity, message)")
def ast_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.static_findings(_snippets(spark)).select("file", "type", "severity", "message")


@query("SELECT * FROM (VALUES ('names.py', 'helper'), ('names.py', 'main'), ('params.py', 'many'), ('params.py', 'few'), ('twins.py', 'one'), ('twins.py', 'two'), ('twins.py', 'three'), ('deep.py', 'd'), ('deep.py', 'flat'), ('long.py', 'l'), ('long.py', 'ok')) t(file, name) WHERE name <> 'main'")
def ast_dead_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.dead_functions(ast_facts(_snippets(spark))).select("file", F.split("message", " ")[0].alias("name"))


_PACKAGE = {
    "pkg/__init__.py": "from .a import x\nimport os\n",
    "pkg/a.py": "import pkg.b.thing\nfrom . import b\nimport pkg.a\n",
    "pkg/b.py": "from pkg import a, b\nfrom ..other import y\nimport os.path\n",
    "other.py": "from pkg.sub.deep import q\nimport pkg.a as z\n",
    "pkg/sub/__init__.py": "",
    "__init__.py": "",
    "top.py": "from . import other\n",
}
_PACKAGE_EDGES = (
    ("pkg", "a", False), ("pkg", "os", False), ("pkg.a", "pkg.b", True), ("pkg.a", "pkg", True), ("pkg.a", "pkg.a", True), ("pkg.b", "pkg", True), ("pkg.b", "other", True), ("pkg.b", "os.path", False), ("other", "pkg.sub", True), ("other", "pkg.a", True), ("top", "other", True),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in _PACKAGE_EDGES) + ") t(src, dst, internal)")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("repo", p, ".py", t) for p, t in _PACKAGE.items()], SCHEMA)
    return graph.edges(rows, ast_facts(rows)).select("src", "dst", "internal")


_DIFFS = [("plain", "+++ b/x.py\n+import os\n+import sys\n+sys.exit()\n-import re\n context\n"), ("blank", "+++ b/y.py\n+ import os\n+ password = 'hunter22'\n"), ("plus", "+++x\n++y\n")]


@query("SELECT * FROM (VALUES ('plain', 'Unused Import', 'os imported but never used.'), ('blank', 'Hardcoded Password', 'Matches of the rule: 1')) t(diff, type, message)")
def pr_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = spark.createDataFrame(_DIFFS, "id string, diff string")
    return findings.review_diffs(diffs).select(F.col("repo_id").alias("diff"), "type", "message")


@query("SELECT * FROM (VALUES ('plain', 'Unused Import', 'os imported but never used.'), ('blank', 'Hardcoded Password', 'Matches of the rule: 1'), ('blank', 'Unused Import', 'os imported but never used.')) t(diff, type, message)")
def pr_review_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = spark.createDataFrame(_DIFFS, "id string, diff string")
    return findings.review_diffs(diffs, fixed=True).select(F.col("repo_id").alias("diff"), "type", "message")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
