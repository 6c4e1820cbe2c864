"""The import graph: edges, neighbours, key files and diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.functions import text as T
from corpusloom.operators.modules import resolved_imports
from corpusloom.runtime import top_per_group

def imports(files: DataFrame) -> DataFrame:
    """Import edges (repo, src, dst, is_internal); imports that mean a file of the repo end in it."""
    return resolved_imports(files, import_candidate(F.col("content")))


def import_candidate(text: Column) -> Column:
    rule = None
    for family, needles in C.IMPORT_NEEDLES.items():
        hit = (F.col("family") == family) & T.holds_any(text, needles)
        rule = hit if rule is None else rule | hit
    return rule


def module_graph(edges: DataFrame) -> DataFrame:
    """Nodes with the number of modules they import and are imported by. The lists themselves stay edge rows."""
    out = edges.select("repo", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select("repo", F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("repo", "node").agg(F.sum("o").alias("imports"), F.sum("i").alias("imported_by"))


def _inside(column: str, target: str) -> Column:
    root = target.rstrip("/")
    return (F.col(column) == root) | F.col(column).startswith(root + "/")


def neighbors(edges: DataFrame, target: str) -> DataFrame:
    """What a file or directory imports and what imports it; both directions are filters of one edge table."""
    out = edges.filter(_inside("src", target)).select(
        "repo", F.lit("imports").alias("direction"), F.col("src").alias("member"), F.col("dst").alias("other"))
    into = edges.filter(_inside("dst", target)).select(
        "repo", F.lit("imported_by").alias("direction"), F.col("dst").alias("member"), F.col("src").alias("other"))
    return out.unionByName(into)


def edges_by_path(edges: DataFrame) -> DataFrame:
    """(repo, ref, direction, member, other): every edge under its two ends and under all directories above them."""
    ends = F.array(
        F.struct(F.lit("imports").alias("direction"), F.col("src").alias("member"), F.col("dst").alias("other")),
        F.struct(F.lit("imported_by").alias("direction"), F.col("dst").alias("member"), F.col("src").alias("other")),
    )
    each = edges.select("repo", F.explode(ends).alias("e")).select("repo", "e.*")
    return each.select("repo", F.explode(F.concat(F.array("member"), T.ancestors(F.col("member")))).alias("ref"), "direction", "member", "other")


def related_files(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Tests and directory neighbours of each target file, by equality of directory and stem."""
    keyed = lambda df, name: df.select(
        "repo", F.col("path").alias(name), T.dirname(F.col("path")).alias("dir"), T.file_stem(F.col("path")).alias(f"{name}_stem")
    )
    left = keyed(targets, "target")
    right = keyed(files, "path")
    near = left.join(right, ["repo", "dir"]).filter("target <> path").select(
        "repo", "target", "path", F.lit("same_directory").alias("relation"))
    tests = (
        left.withColumnRenamed("target_stem", "stem").drop("dir")
        .join(right.withColumnRenamed("path_stem", "stem").drop("dir"), ["repo", "stem"])
        .filter((F.col("target") != F.col("path")) & F.col("path").rlike(r"\.(test|spec)\.[^/]*$"))
        .select("repo", "target", "path", F.lit("test").alias("relation"))
    )
    return near.unionByName(tests)


def related_groups(files: DataFrame) -> DataFrame:
    """(repo, relation, name, path, is_test, n): the related files of every file as groups of ``n`` members, by directory and
    by stem where one of them is a test. A group of any size has one row per member, never its pairs."""
    test = F.col("path").rlike(r"\.(test|spec)\.[^/]*$")
    keys = F.array(
        F.struct(F.lit("same_directory").alias("relation"), T.dirname(F.col("path")).alias("name")),
        F.struct(F.lit("test").alias("relation"), T.file_stem(F.col("path")).alias("name")),
    )
    members = files.select("repo", "path", test.alias("is_test"), F.explode(keys).alias("k")).select("repo", "k.relation", "k.name", "path", "is_test")
    groups = members.groupBy("repo", "relation", "name").agg(F.count("*").alias("n"), F.bool_or("is_test").alias("tested"))
    kept = groups.filter((F.col("n") > 1) & ((F.col("relation") == "same_directory") | F.col("tested"))).drop("tested")
    return members.join(kept, ["repo", "relation", "name"])


def key_files(files: DataFrame, entry_points: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k files to read first per repo: entry points, then most imported, then largest."""
    marks = entry_points.select("repo", "path", F.lit(1).alias("is_entry")).distinct()
    popularity = edges.groupBy("repo", F.col("dst").alias("path")).agg(F.count("*").alias("imported_by"))
    scored = (
        files.select("repo", "path", "n_lines").join(marks, ["repo", "path"], "left").join(popularity, ["repo", "path"], "left")
        .fillna({"is_entry": 0, "imported_by": 0})
    )
    order = [F.desc("is_entry"), F.desc("imported_by"), F.desc("n_lines"), F.col("path")]
    return top_per_group(scored, ["repo"], order, k, "rank")


def export_mermaid(edges: DataFrame, max_nodes: int = 20) -> DataFrame:
    """One ``graph TD`` text per repo over its best connected nodes (the diagram has a fixed node limit)."""
    plain = edges.select("repo", "src", "dst").filter("src <> dst").distinct()
    ends = plain.select("repo", F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("repo", "node").agg(F.count("*").alias("degree"))
    top = top_per_group(degree, ["repo"], [F.desc("degree"), F.col("node")], max_nodes, "rank").select("repo", "node", "rank")
    named = plain.join(top.select("repo", F.col("node").alias("src"), F.col("rank").alias("a")), ["repo", "src"]).join(
        top.select("repo", F.col("node").alias("dst"), F.col("rank").alias("b")), ["repo", "dst"])
    label = lambda n, text: F.format_string('n%d["%s"]', F.col(n), F.replace(F.col(text), F.lit('"'), F.lit("'")))
    line = F.concat(F.lit("    "), label("a", "src"), F.lit(" --> "), label("b", "dst"))
    return named.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("a", "b", line.alias("t")))).alias("l")).select(
        "repo", F.concat(F.lit("graph TD\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("diagram"))
