"""Findings as rows (repo_id, file, ord, seq, type, severity, message, count).

ord tells the detector's place in the static pipeline, seq the finding's place within it. A null
severity stays null here; each score says how it takes it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.astfacts import LIMITS, ast_facts
from quernel.functions.lexical import n_lines
from quernel.functions.secrets import SECRET_RULES, SIGNS

COLUMNS = ("repo_id", "file", "ord", "seq", "type", "severity", "message", "count")

# Types, severities and messages of findings are fixed values that reports depend on.

#: Kinds of facts that the static pipeline goes by: no more than what leads to a finding.
FACTS = ("parse_error", "notable", "unused", "secret")
#: Words that mark security types, and those that mark security issues.
SECURITY_TYPES = ("Password", "Token", "Key", "URL", "Private")
SECURITY_WORDS = ("security", "secret", "password", "token", "credential", "sql injection", "xss", "command injection")
PERFORMANCE_TYPES = ("Long Function", "Deep Nesting")
SMELL_TYPES = ("Unused Variable", "Unused Import", "Duplicate Function", "Too Many Parameters", "Dead Function")


def _finding(rows: DataFrame, ord_: int, kind: str | Column, severity: str | Column, message: Column, count: Column | None = None) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("repo_id", F.col("path").alias("file"), F.lit(ord_).alias("ord"), F.col("seq").cast("int").alias("seq"), as_col(kind).alias("type"), as_col(severity).alias("severity"), message.alias("message"), (F.lit(None) if count is None else count).cast("int").alias("count"))


def rule_findings(facts: DataFrame) -> DataFrame:
    """Parse errors, long functions, many parameters, complexity and nesting, in that order for each function."""
    f = facts.where(F.col("kind").isin("parse_error", "function"))
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    name, case = F.col("name"), lambda test, kind, severity, message: F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message")))
    is_f = F.col("kind") == "function"
    found = F.array_compact(F.array(
        case(~is_f, "Parse Error", "High", F.lit("Unable to parse source code.")),
        case(is_f & (F.col("a") > LIMITS[0]), "Long Function", "Medium", say(name, " has ", F.col("a"), " lines.")),
        case(is_f & (F.col("b") > LIMITS[1]), "Too Many Parameters", "Medium", say(name, " has ", F.col("b"), " parameters.")),
        case(is_f & (F.col("c") > LIMITS[2]), "High Complexity", "High", say(name, " complexity = ", F.col("c"))),
        case(is_f & (F.col("d") > LIMITS[3]), "Deep Nesting", "Medium", say(name, " nesting depth = ", F.col("d"))),
    ))
    rows = f.select("repo_id", "path", "seq", F.posexplode(found).alias("k", "x")).withColumn("seq", F.col("seq") * 5 + F.col("k"))
    return _finding(rows, 0, F.col("x.type"), F.col("x.severity"), F.col("x.message"))


def _names_without(facts: DataFrame, kind: str, other: str) -> DataFrame:
    own = facts.where(F.col("kind") == kind).groupBy("repo_id", "path", "name").agg(F.min("seq").alias("seq"))
    return own.join(facts.where(F.col("kind") == other).select("repo_id", "path", "name"), ["repo_id", "path", "name"], "left_anti")


def unused_variables(facts: DataFrame) -> DataFrame:
    return _finding(_names_without(facts, "assigned", "loaded"), 1, "Unused Variable", "Low", F.concat("name", F.lit(" assigned but never used.")))


def unused_imports(facts: DataFrame) -> DataFrame:
    return _finding(_names_without(facts, "imported", "used"), 4, "Unused Import", "Low", F.concat("name", F.lit(" imported but never used.")))


def dead_functions(facts: DataFrame) -> DataFrame:
    """Not part of the static pipeline."""
    rows = _names_without(facts, "function", "called").where("name <> 'main'")
    return _finding(rows, 5, "Dead Function", "Medium", F.concat("name", F.lit(" defined but never called.")))


def duplicate_functions(facts: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo_id", "path", "key").orderBy("seq")
    rows = facts.where("kind = 'function' AND key IS NOT NULL").withColumn("k", F.row_number().over(w)).withColumn("first", F.first("name").over(w)).where("k > 1")
    return _finding(rows, 3, "Duplicate Function", "Medium", F.concat("name", F.lit(" duplicates "), "first"))


def n_secret_rules(text: Column) -> Column:
    """How many rules a text matches, in the projection that reads it: as many findings as secrets gives."""
    out = F.lit(0)
    for _, _, pattern in SECRET_RULES:
        out = out + text.rlike(pattern).cast("int")
    return out


def secrets(files: DataFrame) -> DataFrame:
    """A finding for each rule that a file matches, with the number of matches. Patterns search only
    texts that hold a word of theirs."""
    rows = files.select("repo_id", "path", "text", F.lower("text").alias("_low"))
    n = [F.when(contains_any(F.col("_low"), SIGNS[t]), F.regexp_count("text", F.lit(p))).otherwise(0) for t, _, p in SECRET_RULES]
    found = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(t).alias("type"), F.lit(s).alias("severity"), n[k].alias("n")) for k, (t, s, _) in enumerate(SECRET_RULES)))
    rows = rows.select("repo_id", "path", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select("repo_id", "path", "x.*")
    return _secret(rows)


def _secret(rows: DataFrame) -> DataFrame:
    return _finding(rows, 2, F.col("type"), F.col("severity"), F.concat(F.lit("Matches of the rule: "), F.col("n")), F.col("n"))


def told_secrets(facts: DataFrame) -> DataFrame:
    """The same from facts, for which texts have been read already."""
    severity = F.create_map(*(F.lit(x) for t, s, _ in SECRET_RULES for x in (t, s)))
    return _secret(facts.where("kind = 'secret'").select("repo_id", "path", "seq", F.col("name").alias("type"), severity[F.col("name")].alias("severity"), F.col("a").alias("n")))


def _told_names(facts: DataFrame, kind: str, ord_: int, type_: str) -> DataFrame:
    """Of facts that have unused names alone, each once a file."""
    return _finding(facts.where(F.col("kind") == kind), ord_, type_, "Low", F.concat("name", F.lit(f" {kind} but never used.")))


def told_findings(facts: DataFrame) -> DataFrame:
    """What the static pipeline finds, from facts of the kinds in FACTS alone: rows are findings where they
    are, and only functions whose bodies agree with others of the file are sent."""
    names = (_told_names(facts, "assigned", 1, "Unused Variable"), _told_names(facts, "imported", 4, "Unused Import"))
    return _union(rule_findings(facts), names[0], told_secrets(facts), duplicate_functions(facts), names[1])


def _union(first: DataFrame, *others: DataFrame) -> DataFrame:
    for x in others:
        first = first.unionByName(x)
    return first


def static_findings(files: DataFrame | None, facts: DataFrame | None = None) -> DataFrame:
    """The static pipeline over files: rules, unused variables, secrets, duplicates, unused imports.
    What is not Python is parsed all the same where the caller passes it, and yields a parse error.
    Without files, facts of the kinds in FACTS tell all."""
    if files is None:
        return told_findings(facts)
    facts = ast_facts(files) if facts is None else facts
    return _union(rule_findings(facts), unused_variables(facts), secrets(files), duplicate_functions(facts), unused_imports(facts))


@dataclass(frozen=True)
class Limits:
    """What a repository and its modules may hold. Fixed values, unless a caller has its own."""

    files: int = 100
    lines: int = 300
    god_lines: int = 500
    god_functions: int = 20
    god_classes: int = 10


def architecture(files: DataFrame, facts: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """Large repositories and modules, and modules that hold too much; the last need a tree. facts: each
    file's size, by which its text isn't read."""
    say = lambda *x: F.concat(*(F.lit(y) if y[:1] == " " else F.col(y) for y in x))
    if facts is None:
        lines = files.select("repo_id", "path", n_lines(F.col("text")).cast("int").alias("lines"))
    else:
        lines = facts.where("kind = 'size'").select("repo_id", "path", "seq", F.col("a").alias("lines"), F.col("c").alias("nf"), F.col("d").alias("nc"))
    size = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limits.files)
    size = size.select("repo_id", F.lit(None).cast("string").alias("path"), F.lit(0).alias("seq"), "n")
    out = _finding(size, 0, "Large Repository", "Medium", F.concat(F.lit("Repository contains "), "n", F.lit(" files.")))
    large = lines.where(F.col("lines") > limits.lines).withColumn("seq", F.lit(0))
    out = out.unionByName(_finding(large, 1, "Large Module", "Medium", say("path", " has ", "lines", " lines.")))
    if facts is None:
        return out
    rows = lines.where("nf IS NOT NULL").where((F.col("lines") > limits.god_lines) | (F.col("nf") > limits.god_functions) | (F.col("nc") > limits.god_classes))
    message = say("path", " has ", "lines", " lines, ", "nf", " functions, ", "nc", " classes.")
    return out.unionByName(_finding(rows, 2, "God Module", "High", message))


def added_lines(diffs: DataFrame, fixed: bool = False) -> DataFrame:
    """(repo_id, path, ext, text): the lines that diffs (id, diff) add, without the mark. fixed drops
    a blank after the mark where all added lines have one."""
    lines = F.filter(F.split("diff", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    rows = diffs.withColumn("_l", F.transform(lines, lambda x: F.substr(x, F.lit(2))))
    if fixed:
        rows = rows.withColumn("_l", F.when(F.forall("_l", lambda x: x.startswith(" ") | (x == "")), F.transform("_l", lambda x: F.when(x == "", x).otherwise(F.substr(x, F.lit(2))))).otherwise(F.col("_l")))
    return rows.select(F.col("id").cast("string").alias("repo_id"), F.lit("diff.py").alias("path"), F.lit(".py").alias("ext"), F.array_join("_l", "\n").alias("text"))


def review_diffs(diffs: DataFrame, fixed: bool = False) -> DataFrame:
    """Secrets and unused imports among the added lines."""
    files = added_lines(diffs, fixed)
    return secrets(files).unionByName(unused_imports(ast_facts(files)))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def is_security(kind: Column) -> Column:
    return contains_any(kind, SECURITY_TYPES)


def repository_security(files: DataFrame, found: DataFrame, fixed: bool = False) -> DataFrame:
    """(repo_id, file, secrets, issues): for each file its secrets, and the findings whose issue names
    security. As findings carry no issue, issues is empty; fixed looks at type and message."""
    is_secret = F.col("ord") == 2
    words = contains_any(F.lower(F.concat_ws(" ", "type", "message")), SECURITY_WORDS) if fixed else F.lit(False)
    item = F.struct("ord", "seq", "type", "severity", "message")
    by = found.groupBy("repo_id", F.col("file").alias("path")).agg(F.sort_array(F.collect_list(F.when(is_secret, item))).alias("secrets"), F.sort_array(F.collect_list(F.when(words, item))).alias("issues"))
    empty = F.array().cast("array<struct<ord:int,seq:int,type:string,severity:string,message:string>>")
    return files.select("repo_id", "path").join(by, ["repo_id", "path"], "left").select("repo_id", F.col("path").alias("file"), F.coalesce("secrets", empty).alias("secrets"), F.coalesce("issues", empty).alias("issues"))
