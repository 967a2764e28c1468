"""Module graphs: vertices (repo_id, module, path) and edges (repo_id, src, dst, internal).

Names follow a file's path; an import goes to the longest prefix of its dotted name that is a module
of the repository. fixed variants repair what the plain ones keep for parity: a package's relative
imports count from the package, and from p import s may go to p.s.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.plans.shared import stored


def module_name(path: Column) -> Column:
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.regexp_replace(F.replace(bare, F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")


def modules(files: DataFrame) -> DataFrame:
    """One row for each name; of two paths with a name the greater stands."""
    py = files.where(F.col("path").endswith(".py"))
    return py.groupBy("repo_id", module_name(F.col("path")).alias("module")).agg(F.max("path").alias("path"))


def resolve(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (repo_id, name) with resolved: the longest dotted prefix that known (repo_id, module) has.
    A root package has no name, so no import resolves to it."""
    names = wanted.select("repo_id", "name").distinct()
    parts = F.split("name", r"\.")
    prefixes = names.select("repo_id", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("module"))
    best = prefixes.where("module <> ''").join(known.select("repo_id", "module"), ["repo_id", "module"]).groupBy("repo_id", "name").agg(F.max_by("module", F.length("module")).alias("resolved"))
    return wanted.join(best, ["repo_id", "name"], "left")


def edges(files: DataFrame, facts: DataFrame, fixed: bool = False, known: DataFrame | None = None) -> DataFrame:
    """known: the files' modules, where a caller has them."""
    known = modules(files) if known is None else known
    here = facts.where(F.col("kind").isin("import", "from")).join(known, ["repo_id", "path"])
    plain = here.where("kind = 'import'").select("repo_id", "module", "name")
    plain = resolve(plain, known).select("repo_id", F.col("module").alias("src"), F.coalesce("resolved", "name").alias("dst"), F.col("resolved").isNotNull().alias("internal"))
    f = here.where("kind = 'from'").select("repo_id", "module", "path", F.col("name").alias("target"), "a", F.col("b").alias("level"), F.col("c").alias("pos"), "key")
    parts = F.filter(F.split("module", r"\."), lambda x: x != "")
    drop = F.col("level") - F.col("path").endswith("__init__.py").cast("int") if fixed else F.col("level")
    left = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - drop, F.lit(0)))
    joined = F.array_join(F.concat(left, F.when(F.col("target") != "", F.array("target")).otherwise(F.array().cast("array<string>"))), ".")
    f = f.withColumn("imported", F.when(F.col("level") == 0, F.col("target")).when(drop > F.size(parts), F.col("target")).otherwise(joined))
    f = f.withColumn("symbol", F.when(F.col("imported") == "", F.col("key")).otherwise(F.concat("imported", F.lit("."), "key")))
    of_package = resolve(f.withColumnRenamed("imported", "name"), known).withColumnRenamed("name", "imported").withColumnRenamed("resolved", "package")
    both = resolve(of_package.withColumnRenamed("symbol", "name"), known).withColumnRenamed("name", "symbol").withColumnRenamed("resolved", "inner")
    if fixed:
        rows = both.select("repo_id", F.col("module").alias("src"), F.coalesce("inner", "package").alias("to"), "imported")
    else:
        rows = both.groupBy("repo_id", "module", "path", "a", "imported").agg(F.first("package").alias("package"), F.min_by("inner", F.when(F.col("inner").isNotNull(), F.col("pos"))).alias("inner"))
        rows = rows.select("repo_id", F.col("module").alias("src"), F.coalesce("package", "inner").alias("to"), "imported")
    rows = rows.where("to IS NOT NULL OR imported <> ''").select("repo_id", "src", F.coalesce("to", "imported").alias("dst"), F.col("to").isNotNull().alias("internal"))
    return plain.unionByName(rows).distinct()


def degrees(known: DataFrame, e: DataFrame) -> DataFrame:
    """(repo_id, module, imports, imported_by, external_imports) of every module."""
    out = e.groupBy("repo_id", F.col("src").alias("module")).agg(F.count_if("internal").cast("int").alias("imports"), F.count_if(~F.col("internal")).cast("int").alias("external_imports"))
    into = e.where("internal").groupBy("repo_id", F.col("dst").alias("module")).agg(F.count(F.lit(1)).cast("int").alias("imported_by"))
    rows = known.select("repo_id", "module").join(out, ["repo_id", "module"], "left").join(into, ["repo_id", "module"], "left")
    return rows.select("repo_id", "module", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("imports", "imported_by", "external_imports")))


def dependency_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("repo_id").agg(F.count_if("internal").alias("internal"), F.count_if(~F.col("internal")).alias("external"))


def top(deg: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The n modules of each repository with most imported_by or imports, in order; ties by name."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc(by), "module"))
    return deg.withColumn("_place", place).where(F.col("_place") <= n).orderBy("repo_id", "_place").drop("_place")


def _whole(e: DataFrame) -> DataFrame:
    """Edges between nodes that carry their repository, so that none of two repositories meet."""
    node = lambda c: F.struct(F.col("repo_id").alias("repo"), F.col(c).alias("name")).alias(c)
    return e.select(node("src"), node("dst"))


def cycles(e: DataFrame, longest: int = 4) -> DataFrame:
    """(repo_id, path): simple cycles of at most longest nodes over edges (repo_id, src, dst), each from
    its least node on and back to it. Longer cycles are not listed; on_cycles has their nodes.

    Only edges inside strongly connected components are walked, and paths only grow through nodes
    above the first, so none is found twice.
    """
    e = e.select("repo_id", "src", "dst").distinct()
    of = on_cycles(e)
    ends = [of.select("repo_id", F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("src", "dst")]
    e = e.join(ends[0], ["repo_id", "src"]).join(ends[1], ["repo_id", "dst"]).where("_src = _dst").select("repo_id", "src", "dst")
    paths = e.where("src <= dst").select("repo_id", F.array("src", "dst").alias("path"))
    found = paths.where("path[0] = path[1]")
    for _ in range(longest - 1):
        open_ = paths.where("path[0] <> element_at(path, -1)")
        step = open_.withColumn("src", F.element_at("path", -1)).join(e, ["repo_id", "src"])
        longer = F.array_append("path", F.col("dst")).alias("path")
        found = found.unionByName(step.where("dst = path[0]").select("repo_id", longer))
        paths = step.where("dst > path[0] AND NOT array_contains(path, dst)").select("repo_id", longer)
    return found.distinct()


def on_cycles(e: DataFrame) -> DataFrame:
    """(repo_id, node, component): strongly connected components that hold a cycle, named by their least
    node."""
    rows = _components(_whole(e))
    return rows.select("node.repo", "node.name", F.col("component.name").alias("component")).toDF("repo_id", "node", "component")


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges without those at nodes that have no way in or no way out."""
    out, into = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
    return e.join(out, "src", "left_semi").join(into, "dst", "left_semi").select("src", "dst")


def _components(e: DataFrame) -> DataFrame:
    """(node, component) by colouring.

    Nodes without a way in or out are cut off; each node takes the least name that reaches it, and
    what the bearer of that name is reached from within its colour is a component. Repeats on the
    rest until none is left. Each round's tables go to the shared folder.
    """
    own = e.where("src = dst").select(F.col("src").alias("node")).distinct()
    e = stored(e.where("src <> dst").select("src", "dst").distinct())
    n, done = e.count(), None
    while n:
        while True:
            before, e = n, stored(_trimmed(e))
            n = e.count()
            if n == before:
                break
        if not n:
            break
        color = stored(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("color", F.col("node")))
        while True:
            sent = e.join(color, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "color")
            new = stored(color.unionByName(sent).groupBy("node").agg(F.min("color").alias("color")))
            changed = new.join(color.withColumnRenamed("color", "_c"), "node").where("color <> _c")
            still = changed.isEmpty()
            color = new
            if still:
                break
        inside = e.join(color.toDF("src", "_a"), "src").join(color.toDF("dst", "_b"), "dst").where("_a = _b")
        inside = stored(inside.select("src", "dst", F.col("_a").alias("color")))
        reach = stored(color.where("node = color"))
        while True:
            back = inside.join(reach.select(F.col("node").alias("dst"), "color"), ["dst", "color"])
            more = stored(back.select(F.col("src").alias("node"), "color").distinct().join(reach, ["node", "color"], "left_anti"))
            if more.isEmpty():
                break
            reach = stored(reach.unionByName(more))
        several = reach.groupBy("color").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = several.join(reach, "color").select("node", F.col("color").alias("component"))
        done = found if done is None else done.unionByName(found)
        gone = reach.select(F.col("node").alias("src"))
        e = stored(e.join(gone, "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"))
        n = e.count()
    alone = own.withColumn("component", F.col("node"))
    return alone if done is None else done.unionByName(alone.join(done.select("node"), "node", "left_anti"))


def neighbourhood(e: DataFrame, center: DataFrame, hops: int = 2) -> DataFrame:
    """(repo_id, center, node) within some hops of each of center (repo_id, node), whichever way the edges go."""
    both = e.select("repo_id", "src", "dst").union(e.select("repo_id", "dst", "src")).toDF("repo_id", "node", "next").distinct()
    seen = center.select("repo_id", F.col("node").alias("center"), "node")
    for _ in range(hops):
        further = seen.join(both, ["repo_id", "node"]).select("repo_id", "center", F.col("next").alias("node"))
        seen = seen.unionByName(further).distinct()
    return seen


def filter_edges(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (repo_id, node)."""
    ends = [nodes.select("repo_id", F.col("node").alias(c)) for c in ("src", "dst")]
    return e.join(ends[0], ["repo_id", "src"], "left_semi").join(ends[1], ["repo_id", "dst"], "left_semi")


def nodes_where(nodes: DataFrame, prop: str, values: list) -> DataFrame:
    """(repo_id, node) whose property, as text, is among the values; a node without it is left out."""
    return nodes.where(F.col(prop).cast("string").isin([str(v) for v in values])).select("repo_id", "node")


def ends_where(e: DataFrame, prop: str, values: list) -> DataFrame:
    """(repo_id, node): the ends of edges whose property is among the values."""
    kept = e.where(F.col(prop).cast("string").isin([str(v) for v in values]))
    return kept.select("repo_id", F.col("src").alias("node")).union(kept.select("repo_id", "dst")).distinct()


#: How graph viewers lay a graph out.
VIEW = {
    "physics": {"enabled": True, "barnesHut": {"gravitationalConstant": -2500, "centralGravity": 0.2, "springLength": 150, "springConstant": 0.05}, "minVelocity": 0.75},
    "interaction": {"hover": True, "navigationButtons": True, "keyboard": True},
    "nodes": {"font": {"size": 16}},
    "edges": {"arrows": {"to": {"enabled": True}}, "smooth": True},
}


def node_link(known: DataFrame, e: DataFrame) -> DataFrame:
    """(repo_id, json, options): nodes as boxes and directed internal edges, for graph viewers, and the
    viewer's options. A row holds one repository's graph."""
    module = F.col("module")
    box = F.struct(module.alias("id"), module.alias("label"), module.alias("title"), F.lit("box").alias("shape"))
    nodes = known.groupBy("repo_id").agg(F.sort_array(F.collect_list(box)).alias("nodes"))
    arrow = F.struct(F.col("src").alias("from"), F.col("dst").alias("to"))
    links = e.where("internal").groupBy("repo_id").agg(F.sort_array(F.collect_list(arrow)).alias("edges"))
    rows = nodes.join(links, "repo_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<from:string,to:string>>")))
    return rows.select("repo_id", F.to_json(F.struct("nodes", "edges")).alias("json"), F.lit(json.dumps(VIEW)).alias("options"))
