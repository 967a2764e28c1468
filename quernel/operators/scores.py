"""Scores, bands and counts over findings and metrics.

The three point tables differ on critical, unknown and missing severities; they are kept apart.
Each function groups by the columns it is given; without rows a group doesn't exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.findings import is_security

SEVERITIES = ("Critical", "High", "Medium", "Low")
#: Points of known severities, of other ones, and of none.
STATIC = ({"Critical": 20, "High": 10, "Medium": 5, "Low": 2}, 0, 2)
SECURITY = ({"Critical": 15, "High": 10, "Medium": 5, "Low": 2}, 2, 2)
FILE_RISK = ({"Critical": 20, "High": 10, "Medium": 5, "Low": 2}, 2, 2)
#: Points of architecture findings.
ARCHITECTURE = {"God Module": 15, "Large Module": 5, "Large Repository": 3}
#: Findings with a known fix.
FIXES = {
    "Unused Import": "Remove the unused import statement.",
    "Unused Variable": "Remove the variable or use it where intended.",
    "Too Many Parameters": "Group parameters into a class, object, or configuration structure.",
    "Duplicate Function": "Keep one implementation and remove duplicates.",
    "Dead Function": "Remove the function if it is no longer required.",
    "Long Function": "Split the function into smaller focused functions.",
    "Deep Nesting": "Use guard clauses and helper functions to reduce nesting.",
    "Hardcoded Password": "Move credentials to environment variables or a secrets manager.",
}


def points(severity: Column, table: tuple[dict[str, int], int, int]) -> Column:
    known, other, missing = table
    out = F.when(severity.isNull(), missing)
    for s, p in known.items():
        out = out.when(severity == s, p)
    return out.otherwise(other)


def points_sql(severity: str, table: tuple[dict[str, int], int, int]) -> str:
    known, other, missing = table
    return f"CASE WHEN {severity} IS NULL THEN {missing} " + " ".join(f"WHEN {severity} = '{s}' THEN {p}" for s, p in known.items()) + f" ELSE {other} END"


def static_score(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(F.greatest(F.lit(0), 100 - F.sum(points(F.col("severity"), STATIC))).cast("int").alias("static_score"))


def security_score(found: DataFrame, by: list[str]) -> DataFrame:
    """Over all findings, not only those of security; a missing severity counts as an unknown one."""
    return found.groupBy(*by).agg(F.greatest(F.lit(0), 100 - F.sum(points(F.col("severity"), SECURITY))).cast("int").alias("security_score"))


def file_risk(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(F.sum(points(F.col("severity"), FILE_RISK)).cast("int").alias("risk_score"), F.count(F.lit(1)).cast("int").alias("issues"))


def architecture_score(found: DataFrame, by: list[str]) -> DataFrame:
    p = F.lit(0)
    for kind, n in ARCHITECTURE.items():
        p = p + F.when(F.col("type") == kind, n).otherwise(0)
    return found.groupBy(*by).agg(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.sum(p))).cast("int").alias("architecture_score"))


def severity_distribution(found: DataFrame, by: list[str]) -> DataFrame:
    """Known severities only."""
    return found.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).cast("int").alias(s.lower()) for s in SEVERITIES))


def severity_counts(found: DataFrame, by: list[str]) -> DataFrame:
    """What is not critical, high or medium is low, missing ones too."""
    known = [F.count_if(F.col("severity") == s).cast("int").alias(s.lower()) for s in SEVERITIES[:3]]
    low = F.count_if(F.coalesce(~F.col("severity").isin(*SEVERITIES[:3]), F.lit(True))).cast("int").alias("low")
    return found.groupBy(*by).agg(*known, low)


def security_summary(found: DataFrame, by: list[str]) -> DataFrame:
    rows = found.where(is_security(F.col("type")))
    types = rows.groupBy(*by).agg(F.sort_array(F.collect_set("type")).alias("types"))
    return severity_counts(rows, by).join(types, by) if by else severity_counts(rows, by).crossJoin(types)


def root_causes(found: DataFrame, key: str | None = None, order: str = "seq") -> DataFrame:
    """Findings by cause, the most frequent first, ties by first appearance. Findings carry no issue, so
    all are Unknown; key names a column to go by instead."""
    cause = F.lit("Unknown") if key is None else F.coalesce(F.col(key), F.lit("Unknown"))
    rows = found.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return rows.orderBy(F.desc("n"), "_first", "cause").drop("_first")


def fix_suggestions(found: DataFrame) -> DataFrame:
    """Findings of a type with a known fix; the table's eight rows are broadcast."""
    fixes = found.sparkSession.createDataFrame(list(FIXES.items()), "type string, fix string")
    return found.join(F.broadcast(fixes), "type").withColumn("severity", F.coalesce("severity", F.lit("Unknown"))).withColumnRenamed("type", "issue")


def round2(x: Column) -> Column:
    """To two places by floor, the same in any engine."""
    return F.floor(x * 100 + 0.5) / 100


def repository_metrics(metrics: DataFrame) -> DataFrame:
    """Sums of metrics for each repository."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("lines", "functions", "classes", "imports")]
    rows = metrics.groupBy("repo_id").agg(F.count(F.lit(1)).cast("long").alias("files"), *sums, F.sum("complexity_score").cast("long").alias("_c"))
    return rows.withColumn("avg_complexity", round2(F.col("_c") / F.col("files"))).drop("_c")


def health(stats: DataFrame) -> DataFrame:
    """stats with health_score and health."""
    f, c, i = (F.col(x) for x in ("functions", "classes", "imports"))
    lost = F.least(0.5 * F.col("avg_complexity"), F.lit(40.0))
    lost = lost + F.when(f > 500, 10).when(f > 200, 5).otherwise(0) + F.when(c > 100, 10).when(c > 50, 5).otherwise(0) + F.when(i > 300, 5).when(i > 100, 2).otherwise(0)
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - lost)), 0).cast("int")
    return stats.withColumn("health_score", score).withColumn("health", F.when(F.col("health_score") >= 80, "Excellent").when(F.col("health_score") >= 60, "Good").when(F.col("health_score") >= 40, "Fair").otherwise("Poor"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def debt(metrics: DataFrame, found: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """(repo_id, file, score, grade, issues, complexity, loc) of each file, the least score first, ties by
    name. Issues are counted in found, or stand in metrics already. Without ordered, in no order."""
    rows = metrics
    if found is not None:
        n = found.groupBy("repo_id", F.col("file").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("issues"))
        rows = metrics.join(n, ["repo_id", "path"], "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    lost = 5 * F.col("issues") + 2 * F.col("complexity_score") + F.when(F.col("lines") > 500, 10).otherwise(0)
    rows = rows.withColumn("score", F.greatest(F.lit(0), 100 - lost).cast("int"))
    size = [F.col("complexity_score").alias("complexity"), F.col("lines").alias("loc")]
    rows = rows.select("repo_id", F.col("path").alias("file"), "score", grade(F.col("score")).alias("grade"), "issues", *size)
    return rows.orderBy("score", "repo_id", "file") if ordered else rows


def repository_debt(debts: DataFrame) -> DataFrame:
    return debts.groupBy("repo_id").agg(round2(F.avg("score")).alias("debt_score"), F.count(F.lit(1)).alias("files"))


def overview(stats: DataFrame) -> DataFrame:
    """(repo_id, metric, value) for charts."""
    named = [F.struct(F.lit(a).alias("metric"), F.col(b).alias("value")) for a, b in (("Files", "files"), ("Functions", "functions"), ("Classes", "classes"), ("Imports", "imports"))]
    return stats.select("repo_id", F.inline(F.array(*named)))
