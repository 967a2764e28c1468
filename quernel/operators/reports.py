"""Texts made of findings and scores; sinks write them. Their wording and layout are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _of(label: str, c: Column) -> Column:
    return F.concat(F.lit(label), c.cast("string"))


def _first(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """(repo_id, x): the first n rows of each repository. The others are dropped before rows meet."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
    rows = rows.withColumn("_place", place).where(F.col("_place") <= n)
    return rows.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("_place", *(c for c in rows.columns if c not in ("repo_id", "_place"))))).alias("x"))


def findings_text(found: DataFrame, strict: bool = False) -> DataFrame:
    """(repo_id, file, report) with a block for each finding, in order. Missing types and severities
    are Unknown; strict raises on them and ends with two line ends."""
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a finding has no {c}"))).otherwise(F.col(c)) if strict else F.coalesce(F.col(c), F.lit("Unknown"))
    block = _lines(_of("Type: ", need("type")), _of("Severity: ", need("severity")), _of("Message: ", F.col("message")), _of("Count: ", F.col("count")), "")
    rows = found.groupBy("repo_id", "file").agg(F.sort_array(F.collect_list(F.struct("ord", "seq", block.alias("b")))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["b"]), "\n")
    return rows.select("repo_id", "file", (F.concat(text, F.lit("\n")) if strict else text).alias("report"))


def executive_summary(scores: DataFrame, found: DataFrame) -> DataFrame:
    """scores (repo_id, score, static_score, security_score, critical, high, medium, low) and the first five finding types."""
    first = _first(found.select("repo_id", "file", "ord", "seq", "type"), ["file", "ord", "seq"])
    rows = scores.join(first, "repo_id", "left")
    top = F.array_join(F.transform("x", lambda x: F.concat(F.lit("- "), x["type"])), "\n")
    text = _lines(
        F.concat(_of("Code Quality Score: ", F.col("score")), F.lit("/100")), F.concat(_of("Static Analysis Score: ", F.col("static_score")), F.lit("/100")), F.concat(_of("Security Score: ", F.col("security_score")), F.lit("/100")), "",
        _of("Critical Issues: ", F.col("critical")), _of("High Issues: ", F.col("high")), _of("Medium Issues: ", F.col("medium")), _of("Low Issues: ", F.col("low")), "", "Top Findings:", F.when(F.size("x") > 0, top),
    )
    return rows.select("repo_id", text.alias("summary"))


def repository_executive_summary(counts: DataFrame, risks: DataFrame) -> DataFrame:
    """counts (repo_id, files, critical, high, medium, low, health_score) and the five riskiest files."""
    top = _first(risks.select("repo_id", (-F.col("risk_score")).alias("r"), "file"), ["r", "file"])
    files = F.array_join(F.transform("x", lambda x: F.concat(F.lit("- "), x["file"], F.lit(" ("), (-x["r"]).cast("string"), F.lit(")"))), "\n")
    text = _lines(
        _of("Files Analyzed: ", F.col("files")), "", _of("Critical Findings: ", F.col("critical")), _of("High Findings: ", F.col("high")), _of("Medium Findings: ", F.col("medium")), _of("Low Findings: ", F.col("low")), "",
        F.concat(_of("Repository Health Score: ", F.col("health_score")), F.lit("/100")), "", "Top Risk Files:", F.when(F.size("x") > 0, files),
    )
    return counts.join(top, "repo_id", "left").select("repo_id", text.alias("summary"))


def repository_summary(stats: DataFrame) -> DataFrame:
    """Prose with three threshold rules over repository metrics."""
    head = _lines("", "Repository Summary", "", F.concat(_of("This repository contains ", F.col("files")), F.lit(" source files.")), "", "Statistics:", _of("- Total Files: ", F.col("files")), _of("- Total Lines: ", F.col("lines")), _of("- Total Functions: ", F.col("functions")), _of("- Total Classes: ", F.col("classes")), _of("- Total Imports: ", F.col("imports")), "", "Assessment:", "", "")
    rules = F.concat(
        F.when(F.col("avg_complexity") > 15, "- High complexity detected. Consider refactoring large functions.\n").otherwise("- Complexity appears manageable.\n"),
        F.when(F.col("functions") > 50, "- Large codebase with many functions.\n").otherwise(""),
        F.when(F.col("classes") > 20, "- Object-oriented structure detected.\n").otherwise(""),
    )
    return stats.select("repo_id", F.concat(head, rules, F.lit("\nOverall repository health appears reasonable. Further AI analysis is recommended.")).alias("summary"))


def review_summary(reviews: DataFrame) -> DataFrame:
    """(repo_id, summary): all reviews of a repository, by file."""
    rows = reviews.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("file", "review"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: F.concat(F.lit("\n\nFile: "), x["file"], F.lit("\n"), x["review"], F.lit("\n"))), "")
    return rows.select("repo_id", F.concat(F.lit("\nRepository AI Summary\n\nFiles Reviewed: "), F.size("x").cast("string"), F.lit("\n\n"), body).alias("summary"))


def markdown(parts: DataFrame) -> DataFrame:
    """(repo_id, value): a report of parts (repo_id, pos, title, body) as Markdown, to be written as text."""
    rows = parts.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "body"))).alias("x"))
    return rows.select("repo_id", F.array_join(F.transform("x", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["body"])), "\n\n").alias("value"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
