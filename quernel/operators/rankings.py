"""Rankings: scores joined to files and modules, the worst first; ties by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators import graph, scores


def heatmap(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.col("path").alias("file"), F.col("complexity_score").alias("complexity"), F.col("lines").alias("loc")).orderBy(F.desc("complexity"), "file")


def complexity_risk(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.col("path").alias("file"), "lines", F.col("complexity_score").alias("complexity"), "risk").orderBy(F.desc("complexity"), "file")


def file_risk(files: DataFrame, found: DataFrame, ordered: bool = True) -> DataFrame:
    """Files without findings stay, with risk 0. Callers that put the rows in no order or another go without this one."""
    risk = scores.file_risk(found, ["repo_id", "file"])
    rows = files.where(F.col("path").endswith(".py")).select("repo_id", F.col("path").alias("file")).join(risk, ["repo_id", "file"], "left")
    rows = rows.select("repo_id", "file", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("risk_score", "issues")))
    return rows.orderBy(F.desc("risk_score"), "file") if ordered else rows


def debt_by_module(debts: DataFrame, fixed: bool = False) -> DataFrame:
    """(repo_id, module, technical_debt): what a file's score lacks of 100. Plain names keep
    __init__, so packages miss their modules; of files with one name the greatest path counts."""
    bare = F.replace(F.regexp_replace("file", r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    name = graph.module_name(F.col("file")) if fixed else bare
    return debts.groupBy("repo_id", name.alias("module")).agg(F.max_by(100 - F.col("score"), "file").alias("technical_debt"))


def module_risk(deg: DataFrame, by_module: DataFrame) -> DataFrame:
    rows = deg.join(by_module, ["repo_id", "module"], "left").withColumn("technical_debt", F.coalesce("technical_debt", F.lit(0)))
    score = 2 * F.col("imports") + 3 * F.col("imported_by") + F.col("external_imports") + F.col("technical_debt")
    return rows.select("repo_id", "module", score.cast("int").alias("risk_score"), F.col("technical_debt").cast("int").alias("technical_debt"), "imports", "imported_by", "external_imports").orderBy(F.desc("risk_score"), "module")


def refactoring(risks: DataFrame, metrics: DataFrame, debts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """risk + complexity + what the debt score lacks of 100. Plain, modules are looked up among file
    paths and mostly miss; with known (repo_id, module, path) they are looked up by their path."""
    rows = risks.withColumn("file", F.col("module")) if known is None else risks.join(known.select("repo_id", "module", F.col("path").alias("file")), ["repo_id", "module"], "left")
    rows = rows.drop("technical_debt").join(metrics.select("repo_id", F.col("path").alias("file"), F.col("complexity_score").alias("_c")), ["repo_id", "file"], "left")
    rows = rows.join(debts.select("repo_id", "file", F.col("score").alias("_d")), ["repo_id", "file"], "left")
    rows = rows.withColumn("complexity", F.coalesce("_c", F.lit(0))).withColumn("technical_debt", F.coalesce("_d", F.lit(100)))
    score = F.col("risk_score") + F.col("complexity") + 100 - F.col("technical_debt")
    return rows.select("repo_id", "module", score.alias("priority_score"), "risk_score", "complexity", "technical_debt").orderBy(F.desc("priority_score"), "module")
