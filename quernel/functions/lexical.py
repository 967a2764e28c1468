"""Metrics of a text by patterns, and the bands over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that end a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
OTHER_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]"
FUNCTION = rf"(?:async\s+def|def)\s+{WORD}+\("
CLASS = rf"class\s+{WORD}+"
IMPORT = r"(?m)^\s*(?:import|from)\s+"
LOOPS, CONDITIONALS = ("for", "while"), ("if", "elif", "else")


def n_lines(text: Column) -> Column:
    """Where \\n alone ends lines, as in most files, bytes are counted; patterns are for the others."""
    plain = ~text.rlike(OTHER_LINE_END)
    ended = F.when(plain, F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).otherwise(F.regexp_count(text, F.lit(LINE_END)))
    ends = F.when(plain, text.endswith("\n")).otherwise(text.rlike(rf"(?:{LINE_END})\z"))
    return ended + F.when((F.length(text) > 0) & ~ends, 1).otherwise(0)


def _count(text: Column, pattern: str, words: tuple[str, ...]) -> Column:
    """Matches of a pattern, each of which holds one of the words; texts without them aren't searched."""
    has = F.lit(False)
    for w in words:
        has = has | text.contains(w)
    return F.when(has, F.regexp_count(text, F.lit(pattern))).when(text.isNotNull(), 0)


def n_words(text: Column, words: tuple[str, ...]) -> Column:
    # A look at the first letter comes before the look behind it, which is slow.
    first = "".join(sorted({w[0] for w in words}))
    return _count(text, rf"(?=[{first}])(?<!{WORD})(?:{'|'.join(words)})(?!{WORD})", words)


def risk_band(complexity: Column) -> Column:
    return F.when(complexity < 10, "Low").when(complexity < 20, "Medium").otherwise("High")


def metrics(files: DataFrame, trees: DataFrame | None = None, keep: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """Each file's counts; complexity is that of its syntax tree where trees (repo_id, path, ast_complexity)
    has it, else by keywords. Counts meet trees, texts don't. keep: further columns to carry.
    every: trees have each file's, so that keywords aren't counted unless they are asked for."""
    t = F.col("text")
    rows = files.withColumns({
        "lines": n_lines(t).cast("int"), "functions": _count(t, FUNCTION, ("def",)).cast("int"), "classes": _count(t, CLASS, ("class",)).cast("int"),
        "imports": _count(t, IMPORT, ("import", "from")).cast("int"), "loops": n_words(t, LOOPS).cast("int"), "conditionals": n_words(t, CONDITIONALS).cast("int"),
    })
    counts = ("lines", "functions", "classes", "imports", "loops", "conditionals")
    rows = rows.select("repo_id", "path", *counts, *keep)
    score = F.col("loops") + F.col("conditionals") + 1
    if trees is not None:
        rows = rows.join(trees, ["repo_id", "path"], "left")
        score = F.col("ast_complexity") if every else F.coalesce("ast_complexity", score)
    rows = rows.withColumn("complexity_score", score.cast("int")).withColumn("risk", risk_band(F.col("complexity_score")))
    return rows.select("repo_id", "path", *counts, "complexity_score", "risk", *keep)


def metrics_sql() -> str:
    """The same for documents as files, in DuckDB's SQL."""
    count = lambda p: f"len(regexp_extract_all(text, '{p}'))::INTEGER"
    words = lambda ws: f"len(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ({', '.join(repr(w) for w in ws)})))::INTEGER"
    return rf"""
m0 AS (SELECT source AS repo_id, doc_id || '.py' AS path, {count(LINE_END)} + CASE WHEN length(text) > 0 AND NOT regexp_matches(text, '(?:{LINE_END})$') THEN 1 ELSE 0 END AS lines,
  {count(FUNCTION)} AS functions, {count(CLASS)} AS classes, {count(IMPORT)} AS imports, {words(LOOPS)} AS loops, {words(CONDITIONALS)} AS conditionals FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, loops + conditionals + 1 AS complexity_score, CASE WHEN loops + conditionals + 1 < 10 THEN 'Low' WHEN loops + conditionals + 1 < 20 THEN 'Medium' ELSE 'High' END AS risk FROM m0)"""
