"""Composite plans. Each returns lazy DataFrames; shared inputs are read once per plan by Catalyst's reuse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunks as CH
from corpusloom.operators import filters as P
from corpusloom.operators import graph as G
from corpusloom.operators import history as H
from corpusloom.operators import progress as PR
from corpusloom.operators import secrets as S
from corpusloom.operators import sections as SE
from corpusloom.operators import snapshots as SN
from corpusloom.operators import surface as SU
from corpusloom.operators import verification as V
from corpusloom.operators import workspace as WS
from corpusloom.runtime import cut_lineage
from corpusloom.sources import tables as ST
from corpusloom.sources.files import dependency_rows, read_manifests


@dataclass
class Context:
    files: DataFrame
    summary: DataFrame
    findings: DataFrame
    states: DataFrame
    chunks: DataFrame
    budget: DataFrame
    imports: DataFrame


def scanned_files(files: DataFrame, includes: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Files that take part: hard excludes, configured globs, include prefixes, text only."""
    kept, _ = P.skip_binary(P.include_prefixes(P.exclude_globs(P.hard_excludes(files), excludes), includes))
    return kept


def generate_context(
    files: DataFrame, manifest: DataFrame, preset: str = "balanced", includes: list[str] | None = None,
    excludes: list[str] | None = None,
) -> Context:
    """Everything known about each repo before any text is written."""
    chosen = scanned_files(files, includes, excludes)
    manifests = read_manifests(P.hard_excludes(files))
    deps = dependency_rows(manifests)
    languages = WS.detect_language(files.select("repo", "path"), deps)
    entries = WS.entry_points(files.select("repo", "path"), manifests)
    findings = S.scan_secrets(chosen)
    states = SN.changed_files(chosen, manifest)
    chunks = CH.chunk_totals(CH.index_chunks(CH.assign_chunks(chosen, entries)))
    budget = CH.estimate_budget(chosen, languages, preset)
    summary = WS.scan_summary(chosen, languages, WS.frameworks(files, deps), entries, findings)
    return Context(chosen, summary, findings, states, chunks, budget, G.imports(chosen))


def check_sections(
    docs: DataFrame, files: DataFrame, baseline: DataFrame, hashes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(section status, reference changes) of marked documents against the newest baseline. Only files that a section
    cites are read and hashed; with ``hashes`` (repo, path, sha256) of a stored state, none."""
    refs = SE.section_refs(SE.parse_sections(P.docs_with_markers(docs)), keep_empty=True)
    now = SN.path_hashes(files, refs.filter("path IS NOT NULL")) if hashes is None else hashes
    changes = SN.ref_changes(refs, now, baseline)
    return SE.section_status(changes, baseline.select("repo")), changes.filter("path is not null")


def check(docs: DataFrame, files: DataFrame, baseline: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Overall staleness per repo."""
    status, _ = check_sections(docs, files, baseline)
    return SE.overall_status(status, repos)


def check_after(docs: DataFrame, state: DataFrame, changes: DataFrame, baseline: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Overall staleness per repo after ``changes`` (repo, path, content) to a stored hash state: as many contents are
    read as files changed."""
    status, _ = check_sections(docs, changes, baseline, SN.state_hashes(SN.apply_changes(state, changes)))
    return SE.overall_status(status, repos)


def update_plan(docs: DataFrame, files: DataFrame, baseline: DataFrame) -> DataFrame:
    """Which sections to regenerate, with the writer and the changed references behind each."""
    status, _ = check_sections(docs, files, baseline)
    return P.update_targets(status).select("repo", "doc", "section", "writer", "n_changed", "changed_refs")


def update_context(docs: DataFrame, files: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(update plan, import edges around it): a row for every edge into or out of a changed reference of a section to
    regenerate. A reference to a directory stands for the files below it."""
    status, changes = check_sections(docs, files, baseline)
    targets = P.update_targets(status)
    plan = targets.select("repo", "doc", "section", "writer", "n_changed", "changed_refs")
    keys = ["repo", "doc", "section", "section_ord"]
    changed = changes.filter("changed").join(targets.select(*keys), keys, "left_semi").select("repo", "doc", "section", F.col("path").alias("ref")).distinct()
    return plan, changed.join(G.edges_by_path(G.imports(files)), ["repo", "ref"])


def verify_docs(docs: DataFrame, files: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, quality per document); documents below 0.80 with a failed check need a fix."""
    counts = SU.family_total(SU.endpoint_counts(files, "verify"), "endpoints")
    checks, quality = V.verified(docs, files, counts, dependencies)
    return checks, quality.withColumn("needs_fix", (F.col("failed") > 0) & (F.col("accuracy") < 0.80))


def decision_records(commits: DataFrame, commit_files: DataFrame, prs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One numbered record per decision group with its commits, paths and pull requests counted. Unless ``groups`` are
    given, related decisions are one group."""
    decided = cut_lineage(H.decisions(commits).select("repo", "hash", "ts", "subject", "reason"))
    groups = H.related_decisions(decided, commit_files) if groups is None else groups
    records = H.number_decisions(groups)
    context = H.decision_context(decided, commit_files, prs).select("repo", "hash", "pr")
    paths = H.commit_paths(decided, commit_files).groupBy("repo", "hash").agg(F.count("*").alias("n_paths"))
    evidence = (
        groups.join(context, ["repo", "hash"]).join(paths, ["repo", "hash"], "left")
        .groupBy("repo", "decision_group").agg(F.coalesce(F.sum("n_paths"), F.lit(0)).alias("paths"), F.min("pr").alias("first_pr"))
    )
    return records.join(evidence, ["repo", "decision_group"])


def api_surface(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(endpoints, resource groups, endpoints per method)."""
    found = SU.endpoints(files)
    return found, SU.resource_groups(found), SU.route_methods(found)


def workspace_map(files: DataFrame, config: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(workspace per repo, packages, package edges, shared dependencies)."""
    usable = P.hard_excludes(files)
    manifests = read_manifests(usable)
    kind = WS.workspace_type(manifests, config)
    patterns = kind.filter("is_monorepo").select("repo", F.explode("patterns").alias("pattern"))
    packages = WS.resolve_packages(patterns, usable, manifests)
    deps = dependency_rows(manifests).withColumn("path", T.dirname(F.col("path")))
    edges = WS.package_edges(packages, deps)
    shared = WS.shared_dependencies(packages, deps.filter("not is_dev"))
    return kind, packages, edges, shared


def progress(items: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their new status, report per milestone)."""
    detected = PR.detect_progress(items, files, SU.exported_names(files))
    return detected, PR.progress_report(detected)


def save_progress(items: DataFrame, files: DataFrame, path: str, updated_at: Column) -> DataFrame:
    """Detect, write the items with their new statuses as a new snapshot of the milestones, and report on what was written."""
    detected, _ = progress(items, files)
    ST.write_milestones(detected, path, updated_at)
    return PR.progress_report(items.sparkSession.read.schema(detected.withColumn("updated_at", updated_at).schema).json(path).filter(F.col("updated_at") == updated_at))


def save_after_update(docs: DataFrame, files: DataFrame, saved_at: Column) -> DataFrame:
    """The baseline rows to append once a plan has been carried out."""
    return SN.baseline_rows(SE.section_refs(SE.parse_sections(docs)), files, saved_at)
