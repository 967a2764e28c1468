"""Analyses of single files and of diffs: the same panels over other findings.

A file gives the static pipeline, a diff the secrets and unused imports of its added lines. Scores,
themes, fixes and the comparison with the last score follow from the findings in both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import lexical
from quernel.functions.astfacts import ast_facts
from quernel.operators import findings, reports, reviews, scores
from quernel.plans.shared import stored


@dataclass(eq=False)
class Single:
    """files: (repo_id, path, ext, text), each repo_id one file."""

    files: DataFrame
    reviewer: object = staticmethod(reviews.stub_reviewer)

    @cached_property
    def facts(self) -> DataFrame:
        return stored(ast_facts(self.files))

    @property
    def metrics(self) -> DataFrame:
        tree = self.facts.where("kind = 'module'").select("repo_id", "path", F.col("a").alias("ast_complexity"))
        return lexical.metrics(self.files, tree)

    @cached_property
    def findings(self) -> DataFrame:
        return stored(findings.static_findings(self.files, self.facts))

    @property
    def report(self) -> DataFrame:
        return reports.findings_text(self.findings)

    @property
    def review(self) -> DataFrame:
        return reviews.review(reviews.prompts(self.files, self.report), self.reviewer)

    @property
    def scores(self) -> DataFrame:
        """(repo_id, static_score, security_score, critical, high, medium, low); files without findings have full scores."""
        rows = self.files.select("repo_id").distinct().join(scores.static_score(self.findings, ["repo_id"]), "repo_id", "left")
        rows = rows.join(scores.security_score(self.findings, ["repo_id"]), "repo_id", "left").join(scores.severity_distribution(self.findings, ["repo_id"]), "repo_id", "left")
        return rows.fillna(100, ["static_score", "security_score"]).fillna(0, ["critical", "high", "medium", "low"])

    @property
    def comparison(self) -> DataFrame:
        """The review's score against the last one; a review without a score counts as 0."""
        rows = reviews.parsed(self.review).select("repo_id", F.coalesce("score", F.lit(0)).alias("score"))
        return rows.select("repo_id", *reviews.comparison(F.lit(reviews.PREVIOUS_SCORE), F.col("score")))

    @property
    def themes(self) -> DataFrame:
        return reviews.by_theme(self.findings)

    @property
    def security_summary(self) -> DataFrame:
        return scores.security_summary(self.findings, ["repo_id"])

    @property
    def fixes(self) -> DataFrame:
        return scores.fix_suggestions(self.findings)

    @property
    def suggested_fixes(self) -> DataFrame:
        """A reviewer's word on the findings."""
        return reviews.review(reviews.fix_prompts(self.files, self.report), self.reviewer)

    @property
    def summary(self) -> DataFrame:
        rated = reviews.parsed(self.review).select("repo_id", F.coalesce("score", F.lit(0)).alias("score"))
        return reports.executive_summary(self.scores.join(rated, "repo_id", "left").fillna(0, ["score"]), self.findings)


class Diff(Single):
    """diffs: (id, diff). fixed drops a blank after the marks of added lines."""

    def __init__(self, diffs: DataFrame, fixed: bool = False):
        super().__init__(findings.added_lines(diffs, fixed))

    @cached_property
    def findings(self) -> DataFrame:
        return stored(findings.secrets(self.files).unionByName(findings.unused_imports(self.facts)))

    @property
    def review(self) -> DataFrame:
        """The findings themselves, as text."""
        return reports.findings_text(self.findings, strict=True).withColumnRenamed("report", "review")
