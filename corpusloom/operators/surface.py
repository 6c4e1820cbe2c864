"""The public surface of the code: endpoints, exports, and how much of it is documented."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import claims as CL
from corpusloom.functions import code as C
from corpusloom.functions import text as T
from corpusloom.operators import filters as P
from corpusloom.operators.paths import known_paths


def union_detections(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _family_counts(files: DataFrame, patterns: dict[str, str], needles: dict[str, list[str]], scope, out: str) -> DataFrame:
    """Matching lines per repo and language family, counted inside each row and summed map-side."""
    sums = [
        F.coalesce(F.sum(F.when(scope(F.col("path"), f), T.matching_lines(F.col("content"), p, needles[f]))), F.lit(0)).cast("bigint").alias(f)
        for f, p in patterns.items()
    ]
    wide = files.groupBy("repo").agg(*sums)
    return wide.unpivot("repo", list(patterns), "family", out)


def endpoint_counts(files: DataFrame, variant: str = "coverage") -> DataFrame:
    scope = lambda p, f: C.endpoint_scope(p, f, variant)
    return _family_counts(files, fv.ENDPOINT_PATTERNS[variant], fv.ENDPOINT_NEEDLES, scope, "endpoints")


def export_counts(files: DataFrame) -> DataFrame:
    return _family_counts(files, fv.EXPORT_PATTERNS, fv.EXPORT_NEEDLES, C.export_scope, "exports")


def family_total(counts: DataFrame, value: str) -> DataFrame:
    return counts.groupBy("repo").agg(F.sum(value).alias(value))


# A router-wide guard, such as ``router.use(authenticate)``.
GUARDED_ROUTER = r"\.use\([^\n]*" + C.AUTH_HINT.removeprefix("(?i)")


def _matching_lines(files: DataFrame, patterns: dict[str, str], needles: dict[str, list[str]], scope, *extra: Column) -> DataFrame:
    """(repo, path, pos, text, family) of lines that match a pattern of their file's language family.

    Which families a file can match is settled once per file, by its path and a search for the needles of the
    pattern; other files are dropped before any text is split, and regexes only run on lines with a needle. ``extra`` columns are facts of the file carried to its lines.
    """
    path, content = F.col("path"), F.col("content")
    able = [(scope(path, f) & T.holds_any(content, needles[f])).alias(f"in_{f}") for f in patterns]
    marked = files.select("repo", "path", "content", *able, *extra)
    some = reduce(lambda a, b: a | b, [F.col(f"in_{f}") for f in patterns])
    kept = [c for c in marked.columns if c != "content"]
    lines = marked.filter(some).select(*kept, F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    family = None
    for f, p in patterns.items():
        hit = F.col(f"in_{f}") & T.line_matches(F.col("text"), p, needles[f])
        family = F.when(hit, f) if family is None else family.when(hit, f)
    return lines.withColumn("family", family).filter("family is not null").drop(*[f"in_{f}" for f in patterns])


def endpoints(files: DataFrame, variant: str = "coverage") -> DataFrame:
    """One row per route registration with method, route, resource and a hint on authentication."""
    guarded = (F.col("content").contains(".use(") & F.col("content").rlike("(?i)" + GUARDED_ROUTER)).alias("guarded")
    scope = lambda p, f: C.endpoint_scope(p, f, variant)
    rows = _matching_lines(files, fv.ENDPOINT_PATTERNS[variant], fv.ENDPOINT_NEEDLES, scope, guarded)
    route = C.route_path(F.col("text"))
    return rows.select(
        "repo", "path", (F.col("pos") + 1).alias("line"), F.col("family").alias("framework"),
        C.route_method(F.col("text")).alias("method"), route.alias("route"),
        C.resource_of(route, F.col("path")).alias("resource"),
        F.coalesce(C.auth_hint(F.col("text")), F.when(F.col("guarded"), F.lit(True))).alias("auth"),
    )


def exports(files: DataFrame) -> DataFrame:
    """One row per exported declaration."""
    return _matching_lines(files, fv.EXPORT_PATTERNS, fv.EXPORT_NEEDLES, C.export_scope).select(
        "repo", "path", (F.col("pos") + 1).alias("line"), F.col("family").alias("language"),
        C.export_kind(F.col("text")).alias("kind"), C.export_name(F.col("text")).alias("name"),
    )


def route_methods(found: DataFrame) -> DataFrame:
    """Endpoints per HTTP method with a TOTAL row per repo (grouping sets)."""
    return found.groupingSets([[F.col("repo"), F.col("method")], [F.col("repo")]], "repo", "method").agg(
        F.count("*").alias("endpoints")
    ).select("repo", F.coalesce("method", F.lit("TOTAL")).alias("method"), "endpoints")


def resource_groups(found: DataFrame) -> DataFrame:
    """Endpoints per resource; the members stay rows of ``endpoints``, only the few distinct verbs are listed."""
    return found.groupBy("repo", "resource").agg(
        F.count("*").alias("endpoints"), F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"),
        F.min("route").alias("base_path"), F.count_if(F.col("auth")).alias("with_auth"),
    )


def doc_endpoint_mentions(docs: DataFrame) -> DataFrame:
    return docs.select("repo", "doc", CL.doc_endpoint_mentions(F.col("content")).cast("bigint").alias("mentions"))


def referenced_existing(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct referenced paths that exist as a file or directory."""
    return refs.select("repo", "path").distinct().join(known_paths(files), ["repo", "path"], "left_semi")


def entity_inventory(files: DataFrame, docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Per repo: source files, endpoints, exports, entities, documents, and what of it is documented.

    Every source contributes partial counts under one schema, so all of them meet in a single shuffle on repo.
    """
    names = ["files", "endpoints", "exports", "doc_files", "documented_files", "documented_endpoints"]
    part = lambda df, **cols: df.select("repo", *[cols.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])
    path, content = F.col("path"), F.col("content")
    count_lines = lambda patterns, needles, scope: reduce(
        lambda a, b: a + b,
        [F.when(scope(path, f), T.matching_lines(content, p, needles[f])).otherwise(F.lit(0)) for f, p in patterns.items()],
    )
    is_source = C.top_dir(path).isin(fv.ALL_SOURCE_ROOTS) & ~path.rlike(C.TEST_PATH + "|__pycache__|node_modules")
    code = part(
        files, files=F.when(is_source, F.lit(1)).otherwise(F.lit(0)),
        endpoints=count_lines(fv.ENDPOINT_PATTERNS["coverage"], fv.ENDPOINT_NEEDLES, lambda p, f: C.endpoint_scope(p, f, "coverage")),
        exports=count_lines(fv.EXPORT_PATTERNS, fv.EXPORT_NEEDLES, C.export_scope),
    )
    prose = part(docs, doc_files=F.lit(1), documented_endpoints=CL.doc_endpoint_mentions(content))
    documented = part(referenced_existing(refs, files), documented_files=F.lit(1))
    return (
        code.unionByName(prose).unionByName(documented)
        .groupBy("repo").agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("entities", F.col("endpoints") + F.col("exports"))
    )


def coverage_report(inventory: DataFrame) -> DataFrame:
    """Coverage percentages truncated to one decimal; ``N/A`` where there are no endpoints, 0.0 elsewhere."""
    file_pct = T.pct_trunc1(F.col("documented_files"), F.col("files"))
    endpoint_pct = T.pct_trunc1(F.col("documented_endpoints"), F.col("endpoints"))
    entity_pct = T.pct_trunc1(F.col("documented_endpoints") + F.col("documented_files"), F.col("entities"))
    return inventory.select(
        "*",
        F.coalesce(file_pct.cast("string"), F.lit("0.0")).alias("file_coverage"),
        F.coalesce(endpoint_pct.cast("string"), F.lit("N/A")).alias("endpoint_coverage"),
        F.coalesce(entity_pct.cast("string"), F.lit("0.0")).alias("entity_coverage"),
    )


def assigned_exports(files: DataFrame) -> DataFrame:
    """(repo, path, name) of script exports by assignment: ``exports.NAME = ...`` and ``module.exports = { NAME, ... }``."""
    content = F.col("content")
    single = F.regexp_extract_all(content, F.lit(r"\bexports\.([A-Za-z_$][A-Za-z0-9_$]*)\s*="), F.lit(1))
    lists = F.regexp_extract_all(content, F.lit(r"\bmodule\.exports\s*=\s*\{([^}]*)\}"), F.lit(1))
    listed = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"^\s*([A-Za-z_$][A-Za-z0-9_$]*)", 1))
    names = F.array_distinct(F.filter(F.concat(single, listed), lambda x: x != ""))
    scripts = files.filter((C.language_family(F.col("path")) == "js") & content.contains("exports"))
    return scripts.select("repo", "path", F.explode(names).alias("name"))


def exported_names(files: DataFrame) -> DataFrame:
    """(repo, path, name) of everything a file exports, declared or assigned."""
    declared = exports(files).select("repo", "path", "name").filter("name is not null")
    return declared.unionByName(assigned_exports(files))


def gap_candidates(files: DataFrame) -> DataFrame:
    """Source files with exports and how many export lines they hold."""
    path = F.col("path")
    chosen = P.source_dirs(files).filter(T.suffix(path).isin(fv.GAP_SUFFIXES) & ~path.rlike(C.TEST_PATH))
    counted = chosen.select("repo", "path", T.matching_lines(F.col("content"), fv.GAP_EXPORT, fv.GAP_NEEDLES).alias("exports"))
    return counted.filter(F.col("exports") > 0)


def covered_paths(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files a reference names directly or through a directory above them (equi-join on exploded ancestors)."""
    both = F.concat(F.array("path"), T.ancestors(F.col("path")))
    return (
        files.select("repo", "path", F.explode(both).alias("target"))
        .join(refs.select("repo", F.col("path").alias("target")).distinct(), ["repo", "target"], "left_semi")
        .select("repo", "path").distinct()
    )


def doc_gaps(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files with exports that no document references."""
    candidates = gap_candidates(files)
    return candidates.join(covered_paths(files, refs), ["repo", "path"], "left_anti")


def documented_split(files: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documented, undocumented) source files as set operations on path keys."""
    source = P.drop_tests(P.source_dirs(files)).select("repo", "path")
    named = covered_paths(files, refs)
    return source.intersect(named), source.exceptAll(named)
