"""User analyzers: registration, isolated execution, discovery and merging of findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import text as T
from corpusloom.operators.filters import exclude_regex
from corpusloom.runtime import top_per_group

PARTIAL = ["repo", "analyzer", "key", "value", "text", "path", "position", "error"]


@dataclass(frozen=True)
class Analyzer:
    name: str
    fn: Callable
    description: str = "No description"
    file_filter: str = "*"
    kind: str = "script"
    confidence: float = 1.0


class Registry:
    """Analyzers by name.

    A ``script`` analyzer is a function of the files of one repo that arrive in one Arrow batch (a pandas
    frame with repo, path, content, n_lines). It returns (key, value), (key, value, text) or (key, value, text, path,
    position) rows; values of a key are added up over all batches. A hot repo is therefore spread over all its batches and
    never gathered. A ``frame`` analyzer maps the files DataFrame to partial findings with native operators, with the
    same columns; path and position may be left out.

    Every text stays a row of its own (``text_findings``), in the order of path and position: by default the first path
    of the batch and the place in the returned list. The data map of a finding shows the first text of a key.
    """

    def __init__(self) -> None:
        self._analyzers: dict[str, Analyzer] = {}

    def register_analyzer(
        self, name: str, fn: Callable, description: str = "No description", file_filter: str = "*",
        kind: str = "script", confidence: float = 1.0,
    ) -> Analyzer:
        if kind not in ("script", "frame"):
            raise ValueError(f"unknown analyzer kind {kind}")
        made = Analyzer(name, fn, description, file_filter, kind, confidence)
        self._analyzers[name] = made
        return made

    def names(self) -> list[str]:
        return sorted(self._analyzers)

    def run_analyzer(self, name: str, files: DataFrame) -> DataFrame:
        """Findings of one analyzer; an unknown name gives one ``not_found`` row per repo."""
        analyzer = self._analyzers.get(name)
        if analyzer is None:
            return files.select("repo").distinct().select(
                "repo", F.lit(name).alias("analyzer"), F.lit(None).cast("string").alias("kind"),
                F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("map<string,string>").alias("data"),
                F.lit("not_found").alias("status"), F.lit(None).cast("string").alias("error"))
        return merge_partials(self._partials(analyzer, files), analyzer.kind, F.lit(float(analyzer.confidence)))

    def run_all(self, files: DataFrame) -> DataFrame:
        """Findings of every analyzer. All script analyzers see each batch of files in one pass."""
        chosen = [self._analyzers[n] for n in self.names()]
        scripts = [a for a in chosen if a.kind == "script"]
        frames = [self.run_analyzer(a.name, files) for a in chosen if a.kind == "frame"]
        if scripts:
            partials = self._script_partials(scripts, files)
            confidences = F.create_map(*[F.lit(x) for a in scripts for x in (a.name, float(a.confidence))])
            frames.append(merge_partials(partials, "script", confidences[F.col("analyzer")]))
        if not frames:
            return self.run_analyzer("", files.limit(0))
        return reduce(lambda a, b: a.unionByName(b), frames)

    def text_findings(self, files: DataFrame) -> DataFrame:
        """(repo, analyzer, key, path, position, text): every text that any analyzer returned, one row each."""
        frames = [self._partials(a, files) for a in self._analyzers.values() if a.kind == "frame"]
        scripts = [self._analyzers[n] for n in self.names() if self._analyzers[n].kind == "script"]
        if scripts:
            frames.append(self._script_partials(scripts, files))
        columns = ["repo", "analyzer", "key", "path", "position", "text"]
        if not frames:
            return files.limit(0).select("repo", *[F.lit(None).cast("bigint" if c == "position" else "string").alias(c) for c in columns[1:]])
        return reduce(DataFrame.unionByName, [f.filter("text IS NOT NULL").select(*columns) for f in frames])

    def _script_partials(self, scripts: list[Analyzer], files: DataFrame) -> DataFrame:
        """Partial findings of several script analyzers, from one pass over the files that any of them asked for."""
        wanted = [file_test(a.file_filter).alias(f"_{k}") for k, a in enumerate(scripts)]
        any_ = reduce(lambda a, b: a | b, [F.col(f"_{k}") for k in range(len(scripts))])
        narrow = files.select("repo", "path", "content", "n_lines", *wanted).filter(any_)
        return narrow.mapInPandas(isolated(*[(a.name, a.fn) for a in scripts]), schemas.PARTIAL_FINDING)

    def _partials(self, analyzer: Analyzer, files: DataFrame) -> DataFrame:
        seen = filtered(files, analyzer.file_filter)
        if analyzer.kind == "frame":
            absent = lambda c: F.lit(None).cast("bigint" if c in ("value", "position") else "string").alias(c)
            try:
                found = analyzer.fn(seen).withColumn("analyzer", F.lit(analyzer.name))
                kept = [F.col(c).cast("bigint" if c in ("value", "position") else "string").alias(c) if c in found.columns else absent(c) for c in PARTIAL[2:-1]]
                return found.select("repo", "analyzer", *kept, absent("error"))
            except Exception as problem:  # noqa: BLE001
                first = str(problem).splitlines()[0] if str(problem) else ""
                return seen.select("repo").distinct().select(
                    "repo", F.lit(analyzer.name).alias("analyzer"), *[absent(c) for c in PARTIAL[2:-1]], F.lit(f"{type(problem).__name__}: {first}").alias("error"))
        narrow = seen.select("repo", "path", "content", "n_lines", F.lit(True).alias("_0"))
        return narrow.mapInPandas(isolated((analyzer.name, analyzer.fn)), schemas.PARTIAL_FINDING)


def filtered(files: DataFrame, file_filter: str) -> DataFrame:
    """Only files the analyzer asked for cross the Python boundary; a bare glob matches the base name."""
    return files.filter(file_test(file_filter))


def file_test(file_filter: str) -> Column:
    if file_filter in ("*", "**", ""):
        return F.lit(True)
    target = F.col("path") if "/" in file_filter else T.basename(F.col("path"))
    if file_filter.startswith("**/"):
        return T.glob_match(target, file_filter) | F.col("path").rlike(exclude_regex(file_filter))
    return T.glob_match(target, file_filter)


def isolated(*analyzers: tuple[str, Callable]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Run analyzers over the same batches, the k-th on the files with ``_k``. What one raises, or returns that is no
    finding, becomes an error row of that analyzer and repo and nothing else."""

    def findings(name: str, fn: Callable, repo: str, group: pd.DataFrame) -> list[tuple]:
        try:
            found = []
            for place, item in enumerate(fn(group)):
                key, value, text, path, position = (*item, None, None, None)[:5]
                number, shown = None if value is None else int(value), None if text is None else str(text)
                where = group["path"].min() if path is None else str(path)
                found.append((repo, name, str(key), number, shown, where, place if position is None else int(position), None))
            return found
        except Exception as problem:  # noqa: BLE001
            return [(repo, name, None, None, None, None, None, f"{type(problem).__name__}: {problem}")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, (name, fn) in enumerate(analyzers):
                seen = batch[batch[f"_{k}"]][["repo", "path", "content", "n_lines"]]
                for repo, group in seen.groupby("repo", sort=False):
                    rows += findings(name, fn, repo, group)
            yield pd.DataFrame(rows, columns=PARTIAL).astype({"value": "Int64", "position": "Int64"})

    return run


def merge_partials(partials: DataFrame, kind: str, confidence: Column) -> DataFrame:
    """Add up partial findings per (repo, key), then one finding per repo with its data map.

    The map holds one entry per key the analyzer defines; its size does not depend on the number of files.
    """
    keyed = partials.groupBy("repo", "analyzer", "key").agg(
        F.sum("value").alias("value"),
        F.min(F.when(F.col("text").isNotNull(), F.struct("path", "position", "text")))["text"].alias("text"), F.min("error").alias("error"))
    entry = F.struct(F.col("key"), F.coalesce("text", F.col("value").cast("string")).alias("value"))
    per_repo = keyed.groupBy("repo", "analyzer").agg(
        F.collect_list(F.when(F.col("key").isNotNull(), entry)).alias("entries"), F.min("error").alias("error"))
    failed = F.col("error").isNotNull()
    return per_repo.select(
        "repo", "analyzer", F.lit(kind).alias("kind"),
        F.when(~failed, confidence).alias("confidence"),
        F.when(~failed, F.map_from_entries(F.array_sort("entries"))).alias("data"),
        F.when(failed, "error").otherwise("success").alias("status"), "error")


def first_texts(findings: DataFrame, limit: int = 20) -> DataFrame:
    """(repo, analyzer, key, n_texts, texts): the first ``limit`` texts of each key in their order, and how many there are.

    A list is never longer than ``limit``; each task passes on that many rows of a key at most.
    """
    keys = ["repo", "analyzer", "key"]
    counts = findings.groupBy(*keys).agg(F.count("*").alias("n_texts"))
    ranked = top_per_group(findings, keys, [F.col("path"), F.col("position"), F.col("text")], limit, "rank")
    lists = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("t"))
    return counts.join(lists, keys).select(*keys, "n_texts", F.col("t.text").alias("texts"))


def merge_findings(*frames: DataFrame) -> DataFrame:
    """Findings of all analyzers in one table; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_context(context: DataFrame, findings: DataFrame) -> DataFrame:
    """Add each analyzer's data to the repo context under the analyzer's name (one entry per analyzer)."""
    ok = findings.filter(F.coalesce(F.col("status") == "success", F.lit(True)))
    single = ok.groupBy("repo", "analyzer").agg(F.max(F.to_json("data")).alias("json"))
    merged = single.groupBy("repo").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("analyzer", "json")))).alias("analyzers"))
    return context.join(merged, "repo", "left")


def list_plugins(files: DataFrame, root: str = ".docs") -> DataFrame:
    """Analyzer and generator definitions found in the corpus, with their declared properties."""
    path, content = F.col("path"), F.col("content")
    script = path.rlike(rf"^{T.glob_body(root)}/analyzers/[^/]+\.sh$")
    agent = path.rlike(rf"^{T.glob_body(root)}/analyzers/[^/]+\.md$")
    generator = path.rlike(rf"^{T.glob_body(root)}/generators/[^/]+\.md$")
    name = F.regexp_replace(T.basename(path), r"\.(sh|md)$", "")
    prop = lambda key, default: F.coalesce(T.frontmatter(content, key), default)
    kind: Column = F.when(script, "script").when(agent, "agent").when(generator, "generator")
    return files.withColumn("kind", kind).filter("kind is not null").select(
        "repo", "kind", name.alias("name"), "path", prop("description", F.lit("No description")).alias("description"),
        F.when(F.col("kind") != "generator", prop("file-filter", F.lit("*"))).alias("file_filter"),
        F.when(F.col("kind") == "generator", prop("output-file", F.concat(F.lit("docs/"), name, F.lit(".md")))).alias("output_file"),
    )


def plugin_counts(plugins: DataFrame) -> DataFrame:
    return plugins.groupBy("repo").agg(
        F.count_if(F.col("kind") == "script").alias("scripts"), F.count_if(F.col("kind") == "agent").alias("agents"),
        F.count_if(F.col("kind") != "generator").alias("analyzers"), F.count_if(F.col("kind") == "generator").alias("generators"))
