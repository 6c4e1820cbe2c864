"""Which files, documents, commits and events take part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import code as C
from corpusloom.functions import text as T


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def hard_exclude_regex() -> str:
    """One expression for all excluded directories and names, so the path is matched once."""
    dirs = "|".join(T.glob_body(d) for d in fv.HARD_EXCLUDE_DIRS)
    names = "|".join(T.glob_body(n).replace(".*", "[^/]*") for n in fv.HARD_EXCLUDE_NAMES)
    return rf"(^|/)({dirs})/|(^|/)({names})$"


def hard_excludes(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("path").rlike(hard_exclude_regex()))


def exclude_regex(glob: str) -> str:
    """A glob without leading ``**/`` excludes what starts with it, at the top or after any slash."""
    cleaned = glob[3:] if glob.startswith("**/") else glob
    return rf"^(.*/)?{T.glob_body(cleaned)}.*$|{T.glob_regex(glob)}"


def exclude_globs(files: DataFrame, globs: list[str] | None = None) -> DataFrame:
    chosen = fv.DEFAULT_EXCLUDES if globs is None else globs
    return files.filter(~any_of([F.col("path").rlike(exclude_regex(g)) for g in chosen]))


def include_prefixes(files: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """Files under an include prefix, plus the known configuration files at the root."""
    chosen = fv.DEFAULT_INCLUDES if globs is None else globs
    prefixes = [g[:-2] if g.endswith("**") else g[:-1] if g.endswith("*") else g for g in chosen]
    root_names = "|".join(T.glob_body(n) for n in fv.ROOT_CONFIG_NAMES)
    at_root = ~F.col("path").contains("/") & F.col("path").rlike(rf"^({root_names})$")
    return files.filter(any_of([F.col("path").startswith(p) for p in prefixes]) | at_root)


def is_binary(content: Column) -> Column:
    """Not readable as text: no valid decoding (NULL) or a NUL character."""
    return content.isNull() | content.contains("\u0000")


def skip_binary(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept files, warnings): both are plain filters of one input."""
    binary = is_binary(F.col("content"))
    warnings = files.filter(binary).select("repo", "path", F.lit("BINARY_SKIP").alias("warning"))
    return files.filter(~binary), warnings


def skip_non_code(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("path").rlike(rf"\.({'|'.join(fv.NON_CODE_SUFFIXES)})$"))


def source_dirs(files: DataFrame, dirs: list[str] | None = None) -> DataFrame:
    return files.filter(C.top_dir(F.col("path")).isin(dirs or fv.ALL_SOURCE_ROOTS))


def drop_tests(files: DataFrame) -> DataFrame:
    """The name test looks at the path only, so code that mentions a test is kept."""
    return files.filter(~F.col("path").rlike(C.TEST_PATH + r"|__pycache__|node_modules"))


def select_docs(files: DataFrame, docs_dir: str = "docs") -> DataFrame:
    """Markdown at the root or directly in the docs directory, as (repo, doc, content)."""
    root = docs_dir.rstrip("/")
    path = F.col("path")
    in_docs = path.startswith(root + "/") & ~F.expr(f"substring(path, {len(root) + 2})").contains("/")
    return files.filter(path.endswith(".md") & (~path.contains("/") | in_docs)).select(
        "repo", path.alias("doc"), "content"
    )


def docs_with_markers(docs: DataFrame, kind: str = "start", namespace: str = T.DEFAULT_NAMESPACE) -> DataFrame:
    return docs.filter(F.col("content").contains(f"{namespace}:{kind}:"))


def ignore_patterns(docs: DataFrame, globs: list[str]) -> DataFrame:
    return docs.filter(~any_of([F.col("doc").rlike(exclude_regex(g)) for g in globs]))


def consented(events: DataFrame) -> DataFrame:
    """Do-not-track always wins; without an explicit opt-in nothing is counted."""
    return events.filter(
        ~F.coalesce(F.col("do_not_track"), F.lit(False)) & F.coalesce(F.col("enabled"), F.lit(False))
    )


def non_merge(commits: DataFrame) -> DataFrame:
    return commits.filter(~F.col("is_merge"))


def since(commits: DataFrame, days: int, now: Column) -> DataFrame:
    return commits.filter(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def merged_prs(prs: DataFrame) -> DataFrame:
    return prs.filter(F.col("merged_at").isNotNull())


def closed_issues(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("closed_at").isNotNull())


def pending_items(milestones: DataFrame) -> DataFrame:
    return milestones.filter(F.col("status") == "pending")


def update_targets(sections: DataFrame) -> DataFrame:
    """Stale sections only, each with the writer that regenerates its document."""
    architecture = F.upper(T.basename(F.col("doc"))).startswith("ARCHITECTURE")
    writer = F.when(architecture, "architecture-writer").otherwise("writer")
    return sections.filter(F.col("status") == "stale").withColumn("writer", writer)


def ci_gate(overall: DataFrame, fail_on: str = "stale") -> DataFrame:
    """One row per repo for a build: status, counts and whether to fail."""
    status = F.col("overall")
    failing = {
        "stale": status.isin("stale", "very-stale"),
        "possibly-stale": status != "current",
        "never": F.lit(False),
    }[fail_on]
    return overall.select("repo", "overall", F.col("stale").alias("stale_count"), failing.alias("fail"))


def oversized(files: DataFrame, threshold: int = fv.OVERSIZE_LINES) -> DataFrame:
    return files.filter(F.col("n_lines") > threshold)
