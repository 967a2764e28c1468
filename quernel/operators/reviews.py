"""Review texts: what they say, how they are made, and how scores change.

A reviewer is any function from prompt to review; the one here is deterministic and needs no network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.findings import PERFORMANCE_TYPES, SMELL_TYPES, is_security
from quernel.plans.shared import ship, stored
from quernel.sources.files import belongs

#: Headings that end a section, and what stands for a missing one.
_END = r"(?=####\s*\d+\.|### Repository Readiness Assessment|### Overall Code Quality Score)"
SECTIONS = {
    "security": (rf"(?is)Security Vulnerabilities.*?{_END}", "No security issues detected."),
    "performance": (rf"(?is)Performance Issues.*?{_END}", "No performance issues detected."),
    "smells": (rf"(?is)Code Smells?.*?{_END}", "No code smells detected."),
}
PREVIOUS_SCORE = 65


def score(review: Column) -> Column:
    """The first n/100, null without one."""
    return F.try_to_number(F.nullif(F.regexp_extract(review, r"(\d+)\s*/\s*100", 1), F.lit("")), F.lit("999999999")).cast("int")


def section(review: Column, name: str) -> Column:
    pattern, missing = SECTIONS[name]
    found = F.regexp_extract(review, pattern, 0)
    return F.when(found == "", missing).otherwise(F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")))


def severity_mentions(review: Column) -> dict[str, Column]:
    return {s.lower(): F.regexp_count(review, F.lit(rf"(?i)Severity:\s*{s}")) for s in ("Critical", "High", "Medium", "Low")}


def parsed(reviews: DataFrame, text: str = "review") -> DataFrame:
    t = F.col(text)
    return reviews.withColumns({"score": score(t)} | {n: section(t, n) for n in SECTIONS} | severity_mentions(t))


def by_theme(found: DataFrame) -> DataFrame:
    """Findings with the report's part that they go to."""
    t = F.col("type")
    return found.withColumn("theme", F.when(is_security(t), "security").when(t.isin(*PERFORMANCE_TYPES), "performance").when(t.isin(*SMELL_TYPES), "smells").otherwise("other"))


def comparison(old: Column, new: Column) -> list[Column]:
    d = new - old
    return [old.alias("old_score"), new.alias("new_score"), d.alias("difference"), F.when(d > 0, "Improved").when(d < 0, "Declined").otherwise("Unchanged").alias("status")]


def history(rows: DataFrame, by: list[str], order: str, value: str, first: int = PREVIOUS_SCORE) -> DataFrame:
    """Each row compared with the one before; the first with a constant."""
    before = F.lag(value, 1).over(Window.partitionBy(*by).orderBy(order))
    return rows.select(*by, order, *comparison(F.coalesce(before, F.lit(first)), F.col(value)))


def stub_reviewer(prompt: str) -> str:
    """A review that depends on the prompt's length alone."""
    return f"### Overall Code Quality Score\n\n{max(0, 100 - len(prompt) // 100)}/100\n\nSeverity: Low\n"


#: What a reviewer is asked: before the source code, before the findings, and after them.
REVIEW = (
    "You review source code. Take the static findings below as proven and explain them.\n"
    "Cover bugs, security vulnerabilities, code smells, performance, complexity and refactorings.\n"
    "For each give its category, its severity (Critical, High, Medium, Low), why it matters and what to do, the gravest first.\n"
    "End with how ready the code is for use, a score as n/100, the number of issues of each severity and a verdict.\n\n"
    "Source code:\n\n"
)
FINDINGS = "\n\nStatic findings:\n\n"
QUESTIONS = "\n\nExplain:\n1. Why these findings matter\n2. What they mean for security\n3. What they cost in speed\n4. What they cost in upkeep\n5. How to mend them\n"
FIX = "You mend source code.\n\nSource code:\n\n"
FIXES = "\n\nGive, as Markdown:\n1. A fix for each finding\n2. The code as it should be\n3. Gains in security\n4. Gains in speed\n5. Refactorings\n"
NO_FINDINGS = "No static analysis findings."


def prompts(files: DataFrame, findings_text: DataFrame, before: str = REVIEW, after: str = QUESTIONS) -> DataFrame:
    """(repo_id, path, prompt): what a reviewer gets to see of each file."""
    return _prompts(files, findings_text, prompt=(before, after))


def _prompts(files: DataFrame, findings_text: DataFrame, **named: tuple[str, str]) -> DataFrame:
    report = findings_text.select("repo_id", F.col("file").alias("path"), "report")
    rows = files.select("repo_id", "path", "text").join(report, ["repo_id", "path"], "left")
    body = [F.col("text"), F.lit(FINDINGS), F.coalesce("report", F.lit(NO_FINDINGS))]
    return rows.select("repo_id", "path", *(F.concat(F.lit(before), *body, F.lit(after)).alias(n) for n, (before, after) in named.items()))


def both_prompts(files: DataFrame, findings_text: DataFrame) -> DataFrame:
    """(repo_id, path, review, fixes): what is asked of each file, for which texts meet reports once."""
    return _prompts(files, findings_text, review=(REVIEW, QUESTIONS), fixes=(FIX, FIXES))


def fix_prompts(files: DataFrame, findings_text: DataFrame) -> DataFrame:
    """The same, asking for fixes."""
    return prompts(files, findings_text, FIX, FIXES)


def _asked(rows: DataFrame, reviewer: Callable[[str], str]) -> DataFrame:
    """(repo_id, path, review) of rows (repo_id, path, prompt); a review that fails is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for prompt in batch.column(2).to_pylist():
                try:
                    got.append(reviewer(prompt))
                except Exception:  # noqa: BLE001  whatever a reviewer may raise
                    got.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], ["repo_id", "path", "review"])

    return rows.select("repo_id", "path", "prompt").mapInArrow(run, "repo_id string, path string, review string")


def review(asked: DataFrame, reviewer: Callable[[str], str] = stub_reviewer, most: int | None = 3, ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(repo_id, file, review): reviews of the first `most` files of each repository, by path, that can
    be reviewed; a review that fails doesn't count, so the next file takes its place.

    The first files of all repositories are reviewed at once, then twice as many of those that lack
    some, and so on; so prompts stay where they are and only names are ranked. With ask, asked are files
    without prompts (repo_id, path, ext, text), and ask makes those of the files whose turn it is.
    """
    ship(asked.sparkSession)
    rows = asked.where(belongs(F.col("path"), "reviewer"))
    if ask is None:
        rows = rows.select("repo_id", "path", "prompt")
        ask = lambda files: files
    if most is None:
        return _asked(ask(rows), reviewer).where("review IS NOT NULL").withColumnRenamed("path", "file")
    by = Window.partitionBy("repo_id").orderBy("path")
    names = stored(rows.select("repo_id", "path").withColumn("place", F.row_number().over(by)))
    done, open_, seen, step = None, names.select("repo_id").distinct(), 0, most
    while True:
        part = names.where((F.col("place") > seen) & (F.col("place") <= seen + step)).join(open_, "repo_id", "left_semi")
        if done is not None and part.isEmpty():
            break
        got = stored(_asked(ask(rows.join(part, ["repo_id", "path"], "left_semi")), reviewer).where("review IS NOT NULL"))
        done = got if done is None else done.unionByName(got)
        enough = done.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
        open_ = names.select("repo_id").distinct().join(enough, "repo_id", "left_anti")
        seen, step = seen + step, 2 * step
    rows = done.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)
    return rows.select("repo_id", F.col("path").alias("file"), "review")
