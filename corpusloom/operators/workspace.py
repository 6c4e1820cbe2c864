"""Languages, frameworks, entry points, workspaces and packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import text as T
from corpusloom.operators.paths import known_dirs
from corpusloom.runtime import top_per_group


def merge_labels(*frames: DataFrame, value: str = "label") -> DataFrame:
    """Sorted distinct labels per repo; labels come from small dictionaries, so the list is bounded."""
    rows = reduce(lambda a, b: a.unionByName(b), [f.select("repo", value) for f in frames])
    return rows.groupBy("repo").agg(F.sort_array(F.collect_set(value)).alias(f"{value}s"))


def language_rows(files: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """(repo, label) for each language whose manifest lies at the root. Only paths are read."""
    path = F.col("path")
    at = lambda *names: F.coalesce(F.bool_or(path.isin(list(names))), F.lit(False))
    kotlin = F.bool_or(path.endswith(".kt") & (F.size(F.split(path, "/")) <= 3))
    seen = files.groupBy("repo").agg(
        at("package.json").alias("js"), at("tsconfig.json").alias("ts"), at(*fv.ECOSYSTEM_MANIFESTS["python"]).alias("py"),
        at("go.mod").alias("go"), at("Cargo.toml").alias("rs"), at("Gemfile").alias("rb"),
        at(*fv.ECOSYSTEM_MANIFESTS["jvm"]).alias("jvm"), F.coalesce(F.bool_or(path == "build.gradle.kts") | kotlin, F.lit(False)).alias("kt"),
    )
    label = lambda cond, name: F.when(cond, F.lit(name))
    found = F.array_compact(F.array(
        label(F.col("js"), "javascript"), label(F.col("js") & F.col("ts"), "typescript"), label(F.col("py"), "python"),
        label(F.col("go"), "go"), label(F.col("rs"), "rust"), label(F.col("rb"), "ruby"),
        label(F.col("jvm") & F.col("kt"), "kotlin"), label(F.col("jvm") & ~F.col("kt"), "java"),
    ))
    rows = seen.select("repo", F.explode(found).alias("label"))
    if dependencies is None:
        return rows
    typed = dependencies.filter((F.col("path") == "package.json") & (F.col("dep") == "typescript"))
    return rows.unionByName(typed.select("repo", F.lit("typescript").alias("label")))


def detect_language(files: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    return merge_labels(language_rows(files, dependencies)).withColumnRenamed("labels", "languages")


def framework_rows(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repo, label): JSON dependency keys by equality, line formats by text, build tools by config file.

    The dictionaries are literals inside the plan; there is no table to broadcast.
    """
    names = F.create_map(*[F.lit(x) for pair in fv.JSON_FRAMEWORKS.items() for x in pair])
    keyed = dependencies.filter((F.col("kind") == "npm") & (F.col("path") == "package.json")).select(
        "repo", names[F.col("dep")].alias("label"))
    line_names = sorted({m for m, _, _ in fv.LINE_FRAMEWORKS})
    hits = F.array_compact(F.array(*[
        F.when((F.col("path") == m) & F.col("content").rlike(p), F.lit(n)) for m, p, n in fv.LINE_FRAMEWORKS]))
    listed = files.filter(F.col("path").isin(line_names)).select("repo", F.explode(hits).alias("label"))
    tools = F.create_map(*[F.lit(x) for pair in fv.CONFIG_FRAMEWORKS.items() for x in pair])
    scripted = files.filter(F.col("path") == "package.json").select("repo").distinct()
    configured = files.filter(F.col("path").isin(list(fv.CONFIG_FRAMEWORKS))).select("repo", tools[F.col("path")].alias("label")).join(
        scripted, "repo", "left_semi")
    return keyed.filter("label is not null").unionByName(listed).unionByName(configured)


def frameworks(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    return merge_labels(framework_rows(files, dependencies)).withColumnRenamed("labels", "frameworks")


def entry_points(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(repo, path): per ecosystem the first candidate that exists, the manifest's main, and a Go command.

    Candidates are root-level facts, so one aggregate over paths answers all ecosystems.
    """
    path = F.col("path")
    rank = lambda names: reduce(
        lambda acc, iv: acc.when(path == iv[1], iv[0]), list(enumerate(names))[1:], F.when(path == names[0], 0))
    candidates = {e: rank(names) for e, names in fv.ENTRY_POINT_CANDIDATES.items()}
    go_cmd = F.when(path.rlike(r"^cmd/[^/]+/main\.go$"), path)
    enabled = {e: F.bool_or(path.isin(fv.ECOSYSTEM_MANIFESTS[e])) for e in candidates}
    found = files.groupBy("repo").agg(
        *[F.min_by("path", c).alias(f"p_{e}") for e, c in candidates.items()],
        *[c.alias(f"on_{e}") for e, c in enabled.items()], F.min(go_cmd).alias("go_cmd"),
    )
    chosen = F.array_compact(F.array(*[
        F.when(F.col(f"on_{e}"), F.coalesce(f"p_{e}", "go_cmd") if e == "go" else F.col(f"p_{e}")) for e in candidates]))
    firsts = found.select("repo", F.explode(chosen).alias("path"))
    mains = manifests.filter((F.col("path") == "package.json") & F.col("main").isNotNull()).select(
        "repo", F.regexp_replace("main", r"^\./", "").alias("path"))
    existing = mains.join(files.select("repo", "path"), ["repo", "path"], "left_semi")
    return firsts.unionByName(existing).distinct()


def workspace_type(manifests: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Workspace kind per repo by precedence; a configured true or false overrides the detection."""
    root = manifests.filter(~F.col("path").contains("/"))
    kind, ws = F.col("kind"), F.col("workspaces")
    label = (
        F.when(kind == "pnpm", "pnpm-workspaces").when((kind == "npm") & ws.isNotNull(), "npm-workspaces")
        .when(kind == "lerna", "lerna").when((kind == "cargo") & ws.isNotNull(), "cargo-workspaces").when(kind == "go-work", "go-workspaces")
    )
    priority = F.array_position(F.array(*[F.lit(w) for w in fv.WORKSPACE_PRECEDENCE]), label)
    found = root.withColumn("_type", label).groupBy("repo").agg(
        F.min_by("_type", F.when(F.col("_type").isNotNull(), priority)).alias("workspace_type"),
        F.min_by("workspaces", F.when(F.col("_type").isNotNull(), priority)).alias("patterns"),
    )
    if config is None:
        enabled = F.col("workspace_type").isNotNull()
    else:
        found = found.join(config.select("repo", "enabled"), "repo", "full")
        enabled = F.coalesce("enabled", F.col("workspace_type").isNotNull())
    return found.select("repo", enabled.alias("is_monorepo"), F.coalesce("workspace_type", F.lit("none")).alias("workspace_type"), "patterns")


def resolve_packages(patterns: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Packages named by workspace patterns (repo, pattern).

    ``dir/*`` gives every direct subdirectory, an exact directory is one package. Both are equi-joins on the
    table of directories.
    """
    raw = F.regexp_replace("pattern", r"^\./", "")
    clean = F.regexp_replace(F.regexp_replace(raw, r"/\*$", ""), r"\*$", "")
    rules = patterns.select("repo", F.when(clean == "", ".").otherwise(clean).alias("at"), F.col("pattern").contains("*").alias("is_glob")).distinct()
    dirs = known_dirs(files).filter("path <> '.'")
    globbed = dirs.withColumn("at", T.dirname(F.col("path"))).join(rules.filter("is_glob"), ["repo", "at"]).select("repo", "path", "is_glob")
    exact = dirs.withColumn("at", F.col("path")).join(rules.filter("not is_glob"), ["repo", "at"]).select("repo", "path", "is_glob")
    places = globbed.unionByName(exact).groupBy("repo", "path").agg(F.max("is_glob").alias("is_glob"))
    base = T.basename(F.col("path"))
    marker = lambda *names: F.bool_or(base.isin(list(names)))
    kinds = files.filter(F.col("path").contains("/") & base.isin("package.json", "tsconfig.json", "Cargo.toml", "go.mod", "pyproject.toml", "setup.py")).groupBy(
        "repo", T.dirname(F.col("path")).alias("path")
    ).agg(package_language(marker).alias("language"))
    described = manifests.filter(F.col("kind") == "npm").select(
        "repo", T.dirname(F.col("path")).alias("path"), F.col("name").alias("declared"), "description")
    joined = places.join(kinds, ["repo", "path"], "left").join(described, ["repo", "path"], "left")
    glob = F.col("is_glob")
    return joined.select(
        "repo", F.coalesce(F.when(glob, F.col("declared")), base).alias("name"), "path",
        F.coalesce(F.when(glob, F.col("language")), F.lit("unknown")).alias("language"),
        F.coalesce(F.when(glob, F.col("description")), F.lit("")).alias("description"),
    )


def package_language(marker):
    """Language of a package by its first marker file; ``marker`` says whether any of some names is there."""
    return (
        F.when(marker("package.json") & marker("tsconfig.json"), "typescript").when(marker("package.json"), "javascript")
        .when(marker("Cargo.toml"), "rust").when(marker("go.mod"), "go").when(marker("pyproject.toml", "setup.py"), "python")
        .otherwise("unknown")
    )


def package_edges(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Package A depends on package B of the same repo when B's name is among A's dependencies.

    ``dependencies`` is (repo, package path, dep).
    """
    names = packages.select("repo", F.col("name").alias("dep"), F.col("name").alias("to")).distinct()
    owners = packages.select("repo", "path", F.col("name").alias("from"))
    return (
        dependencies.select("repo", "path", "dep").join(names, ["repo", "dep"]).join(owners, ["repo", "path"])
        .filter(F.col("from") != F.col("to")).select("repo", "from", "to").distinct()
    )


def shared_dependencies(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Dependencies that more than one package of a repo declares."""
    used = dependencies.select("repo", "path", "dep").join(packages.select("repo", "path"), ["repo", "path"], "left_semi")
    return used.groupBy("repo", "dep").agg(F.countDistinct("path").alias("packages")).filter("packages > 1")


def top_shared_deps(shared: DataFrame, k: int = 10) -> DataFrame:
    return top_per_group(shared, ["repo"], [F.desc("packages"), F.desc("dep")], k, "rank")


def scan_summary(files: DataFrame, languages: DataFrame, framework_list: DataFrame, entries: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, lines, languages, frameworks, entry points and secrets per repo."""
    base = files.groupBy("repo").agg(F.count("*").alias("files"), F.sum("n_lines").alias("lines"))
    points = merge_labels(entries.withColumnRenamed("path", "label")).withColumnRenamed("labels", "entry_points")
    secrets = findings.groupBy("repo").agg(F.count("*").alias("secrets"))
    listed = lambda c: F.when(F.size(F.coalesce(c, F.array())) > 0, F.array_join(c, " ")).otherwise("none")
    return (
        base.join(languages, "repo", "left").join(framework_list, "repo", "left").join(points, "repo", "left").join(secrets, "repo", "left")
        .select("repo", "files", "lines", listed("languages").alias("languages"), listed("frameworks").alias("frameworks"),
                listed("entry_points").alias("entry_points"), F.coalesce("secrets", F.lit(0)).alias("secrets"))
    )
