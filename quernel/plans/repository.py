"""The whole analysis of repositories: one scan, one parse, and everything else derived.

Facts and findings are stored once in the shared folder; each panel is a lazy table over them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import lexical
from quernel.functions.astfacts import ast_facts
from quernel.operators import findings, graph, rankings, reports, reviews, scores
from quernel.plans.shared import stored
from quernel.sources.files import belongs

#: Parts of an analysis that need syntax trees, and the facts that each goes by.
PARSED = {"metrics": ("module",), "sizes": ("size",), "findings": findings.FACTS, "graph": ("import", "from")}


@dataclass(eq=False)
class Repository:
    """files: (repo_id, path, ext, text). fixed takes the repaired variants of the joins and the graph.
    parts: those of PARSED that a caller will ask for; only their facts are made, and others raise."""

    files: DataFrame
    fixed: bool = False
    parts: tuple[str, ...] = tuple(PARSED)

    def of(self, policy: str) -> DataFrame:
        return self.files.where(belongs(F.col("path"), policy))

    @cached_property
    def facts(self) -> DataFrame:
        """Every file that some panel parses, once; what isn't Python has a parse error."""
        path = F.col("path")
        kinds = {k for p in self.parts for k in PARSED[p]}
        return stored(ast_facts(self.files.where(belongs(path, "wide") | belongs(path, "explorer")), kinds))

    def _facts(self, part: str) -> DataFrame:
        if part not in self.parts:
            raise ValueError(f"this analysis is made without {part}: its parts are {', '.join(self.parts)}")
        return self.facts

    @cached_property
    def complexity(self) -> DataFrame:
        return self._facts("metrics").where("kind = 'module'").select("repo_id", "path", F.col("a").alias("ast_complexity"))

    @property
    def _sizes(self) -> DataFrame:
        return self._facts("sizes").where("kind = 'size'").select("repo_id", "path", F.col("a").alias("lines"), F.col("b").alias("complexity_score"))

    @property
    def sizes(self) -> DataFrame:
        """(repo_id, path, lines, complexity_score, risk) of wide_metrics, without a pass over the texts."""
        return self._sizes.where(belongs(F.col("path"), "wide")).withColumn("risk", lexical.risk_band(F.col("complexity_score")))

    def _metrics(self, policy: str) -> DataFrame:
        return lexical.metrics(self.of(policy), self.complexity)

    @cached_property
    def metrics(self) -> DataFrame:
        return self._metrics("metrics")

    @cached_property
    def wide_metrics(self) -> DataFrame:
        return self._metrics("wide")

    @cached_property
    def all_findings(self) -> DataFrame:
        """Of all files of the wide policy, for debt and security. Facts are stored, and findings stand in them."""
        wide = self._facts("findings").where(belongs(F.col("path"), "wide"))
        return findings.static_findings(None, wide)

    @property
    def findings(self) -> DataFrame:
        """Of Python files, for everything else."""
        return self.all_findings.where(F.col("file").endswith(".py"))

    @property
    def stats(self) -> DataFrame:
        trees = self._sizes.select("repo_id", "path", F.col("complexity_score").alias("ast_complexity"))
        return scores.repository_metrics(lexical.metrics(self.of("metrics"), trees, every=True))

    @property
    def health(self) -> DataFrame:
        return scores.health(self.stats)

    @property
    def architecture(self) -> DataFrame:
        return findings.architecture(self.of("explorer"), self._facts("sizes").where(belongs(F.col("path"), "explorer")))

    @property
    def debt(self) -> DataFrame:
        return scores.debt(self.sizes, self.all_findings)

    @property
    def debts(self) -> DataFrame:
        """The same rows in no order."""
        return scores.debt(self.sizes, self.all_findings, ordered=False)

    @cached_property
    def modules(self) -> DataFrame:
        """Stored, as the graph meets them several times."""
        return stored(graph.modules(self.of("python")))

    @cached_property
    def edges(self) -> DataFrame:
        return stored(graph.edges(self.of("python"), self._facts("graph"), self.fixed, self.modules))

    @property
    def degrees(self) -> DataFrame:
        return graph.degrees(self.modules, self.edges)

    @property
    def module_risk(self) -> DataFrame:
        return rankings.module_risk(self.degrees, rankings.debt_by_module(self.debts, self.fixed))

    @property
    def refactoring(self) -> DataFrame:
        return rankings.refactoring(self.module_risk, self.sizes, self.debts, self.modules if self.fixed else None)

    @property
    def heatmap(self) -> DataFrame:
        return rankings.heatmap(self.wide_metrics)

    @property
    def file_risk(self) -> DataFrame:
        return rankings.file_risk(self.of("explorer"), self.findings)

    @property
    def file_risks(self) -> DataFrame:
        """The same rows in no order."""
        return rankings.file_risk(self.of("explorer"), self.findings, ordered=False)

    @property
    def security(self) -> DataFrame:
        return findings.repository_security(self.of("wide"), self.all_findings, self.fixed)

    @property
    def root_causes(self) -> DataFrame:
        return scores.root_causes(self.findings, "type" if self.fixed else None)

    @property
    def dependency_counts(self) -> DataFrame:
        return graph.dependency_counts(self.edges)

    @property
    def node_link(self) -> DataFrame:
        return graph.node_link(self.modules, self.edges)

    @property
    def dependencies(self) -> dict[str, DataFrame]:
        """The graph's panels in one. cycles lists those of at most four modules; on_cycles has the
        modules of all, whatever their length."""
        inner = self.edges.where("internal")
        return {
            "modules": self.modules,
            "edges": self.edges,
            "degrees": self.degrees,
            "counts": self.dependency_counts,
            "cycles": graph.cycles(inner),
            "on_cycles": graph.on_cycles(inner),
            "most_depended": graph.top(self.degrees, "imported_by"),
            "most_dependent": graph.top(self.degrees, "imports"),
            "json": self.node_link,
        }

    @property
    def reviews(self) -> DataFrame:
        return reviews.review(self.of("explorer"), ask=lambda files: reviews.prompts(files, reports.findings_text(self.findings)))

    @property
    def summary(self) -> DataFrame:
        counts = scores.severity_counts(self.findings, ["repo_id"])
        rows = self.health.join(counts, "repo_id", "left").fillna(0, ["critical", "high", "medium", "low"])
        return reports.repository_executive_summary(rows, self.file_risks)
