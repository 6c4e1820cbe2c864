"""Claims in documentation checked against the code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import claims as CL
from corpusloom.functions import text as T
from corpusloom.operators.paths import known_paths
from corpusloom.operators.sections import document_refs

CHECK = ["repo", "doc", "type", "claim", "expected", "actual", "passed"]


def _check(df: DataFrame, kind: str, claim: Column, expected: Column, actual: Column, passed: Column) -> DataFrame:
    return df.select(
        "repo", "doc", F.lit(kind).alias("type"), claim.alias("claim"), expected.alias("expected"),
        actual.alias("actual"), passed.alias("passed"),
    )


def _exists(mentions: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    joined = mentions.join(known.select("repo", "path", F.lit(True).alias("_k")), ["repo", "path"], "left")
    found = F.col("_k").isNotNull()
    return _check(joined, kind, F.col("path"), F.lit("exists"), F.when(found, "exists").otherwise("missing"), found)


def check_file_refs(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Every distinct source path a document mentions must be a file."""
    mentions = docs.select("repo", "doc", F.explode(CL.mentioned_paths(F.col("content"))).alias("path"))
    return _exists(mentions, files.select("repo", "path").distinct(), "file_exists")


def check_ref_anchors(docs: DataFrame, files: DataFrame, namespace: str = T.DEFAULT_NAMESPACE) -> DataFrame:
    """Every reference anchor must be a file or a directory."""
    return _exists(document_refs(docs, namespace), known_paths(files), "ref_anchor")


def check_endpoint_counts(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``N endpoints`` passes when the code has none, or when it is off by at most two."""
    claims = docs.select("repo", "doc", F.explode(CL.count_claim_digits(F.col("content"))).alias("claimed"))
    joined = claims.join(counts.select("repo", F.col("endpoints").alias("_n")), "repo", "left")
    actual = F.coalesce("_n", F.lit(0)).cast("bigint")
    # A claim that no long can hold is far from any count.
    ok = (actual == 0) | F.coalesce(F.abs(F.col("claimed").try_cast("decimal(38,0)") - actual) <= fv.ENDPOINT_TOLERANCE, F.lit(False))
    return _check(joined, "endpoint_count", F.concat("claimed", F.lit(" endpoints")), F.col("claimed"), actual.cast("string"), ok)


def declared_versions(dependencies: DataFrame) -> DataFrame:
    """One declared version per (repo, lower-case name) of the root package, runtime before development."""
    root = dependencies.filter((F.col("kind") == "npm") & (F.col("path") == "package.json"))
    return root.groupBy("repo", F.lower("dep").alias("name")).agg(F.min_by("version", F.struct("is_dev", "version")).alias("version"))


def check_versions(docs: DataFrame, versions: DataFrame, repos: DataFrame) -> DataFrame:
    """``Framework N`` against the declared version; an undeclared framework passes.

    Only repos with a package manifest are checked.
    """
    claims = docs.select("repo", "doc", F.explode(CL.version_claims(F.col("content"))).alias("c")).select(
        "repo", "doc", "c.name", "c.major"
    )
    joined = claims.join(repos.select("repo").distinct(), "repo", "left_semi").join(
        versions.select("repo", "name", CL.first_int(F.col("version")).alias("_v")), ["repo", "name"], "left"
    )
    ok = F.col("_v").isNull() | F.coalesce(F.col("_v") == F.col("major"), F.lit(False))
    return _check(
        joined, "dep_version", F.concat_ws(" ", "name", F.col("major").cast("string")), F.col("major").cast("string"),
        F.coalesce(F.col("_v").cast("string"), F.lit("none")), ok,
    )


def union_checks(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(*CHECK) for f in frames])


def repo_features(files: DataFrame) -> DataFrame:
    """Whether a repo has a package manifest and a license at its root."""
    return files.groupBy("repo").agg(
        F.coalesce(F.bool_or(F.col("path").isin("package.json", "requirements.txt", "go.mod")), F.lit(False)).alias("has_manifest"),
        F.coalesce(F.bool_or(F.col("path").isin("LICENSE", "LICENSE.md")), F.lit(False)).alias("has_license"),
    )


def section_coverage(docs: DataFrame, features: DataFrame, namespace: str = T.DEFAULT_NAMESPACE) -> DataFrame:
    """One row per (doc, expected section) with ``found``.

    The few expected sections become boolean tests inside the row, so no alias table is joined to the texts.
    """
    def found(aliases: list[str]) -> Column:
        names = "|".join(aliases)
        return F.col("headings").rlike(rf"(?i)## [^\n]*({names})|<!-- {namespace}:start:({names})")

    entry = lambda name, aliases: F.struct(F.lit(name).alias("section"), found(aliases).alias("found"))
    base = F.array(*[entry(n, a) for n, a in fv.EXPECTED_SECTIONS.items()])
    with_manifest = F.array(*[entry(n, a) for n, a in fv.EXPECTED_IF_MANIFEST.items()])
    with_license = F.array(*[entry(n, a) for n, a in fv.EXPECTED_IF_LICENSE.items()])
    headings = T.candidate_lines(F.col("content"), ["## ", f"<!-- {namespace.lower()}:start:"], True)
    tested = docs.select("repo", "doc", headings.alias("headings")).select("repo", "doc", base.alias("base"), with_manifest.alias("m"), with_license.alias("l"))
    joined = tested.join(features, "repo", "left")
    none = F.slice("base", 1, 0)
    expected = F.concat(
        "base", F.when(F.col("has_manifest"), F.col("m")).otherwise(none), F.when(F.col("has_license"), F.col("l")).otherwise(none)
    )
    return joined.select("repo", "doc", F.explode(expected).alias("e")).select("repo", "doc", "e.section", "e.found")


def anchor_count(docs: DataFrame, namespace: str = T.DEFAULT_NAMESPACE) -> DataFrame:
    return docs.select("repo", "doc", T.matching_lines(F.col("content"), f"<!-- {namespace}:refs:", [f"{namespace}:refs:"]).alias("refs"))


def quality_score(checks: DataFrame, coverage: DataFrame, anchors: DataFrame) -> DataFrame:
    """Accuracy, coverage and overall score per document, truncated at every step.

    Checks, expected sections and anchors are reduced to partial counts under one schema and meet in one
    shuffle on (repo, doc).
    """
    names = ["checks", "passed", "expected", "present", "refs"]
    part = lambda df, **cols: df.select("repo", "doc", *[cols.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])
    counted = (
        part(checks, checks=F.lit(1), passed=F.col("passed").cast("int"))
        .unionByName(part(coverage, expected=F.lit(1), present=F.col("found").cast("int")))
        .unionByName(part(anchors, refs=F.col("refs")))
        .groupBy("repo", "doc").agg(*[F.sum(n).alias(n) for n in names])
    )
    return scored(counted)


CLAIM = "struct<type:string,key:string,claim:string,number:string>"
#: Parts into which a repo's endpoint count is dealt: all its documents may claim one.
SALT = 16


def document_claims(docs: DataFrame, namespace: str = T.DEFAULT_NAMESPACE) -> DataFrame:
    """Everything a document claims, from one reading of it: (repo, doc, type, key, claim, number) and, repeated on each row,
    how many expected sections it has and how many reference markers. Without claims a document has one row."""
    content = F.col("content")
    claim = lambda kind, key, text, number: F.struct(
        F.lit(kind).alias("type"), key.alias("key"), text.alias("claim"), number.cast("string").alias("number")).cast(CLAIM)
    none = F.lit(None).cast("string")
    markers = F.regexp_extract_all(content, F.lit(rf".*<!-- {re.escape(namespace)}:refs:([^>\n]+) -->"), F.lit(1))
    anchors = F.filter(F.transform(F.flatten(F.transform(markers, T.split_refs)), T.ref_path), lambda p: p != "")
    part = F.pmod(F.xxhash64("doc"), F.lit(SALT)).cast("string")
    claims = F.concat(
        F.transform(CL.mentioned_paths(content), lambda p: claim("file_exists", F.concat(F.lit("f:"), p), p, none)),
        F.transform(anchors, lambda p: claim("ref_anchor", F.concat(F.lit("p:"), p), p, none)),
        F.transform(CL.count_claim_digits(content), lambda n: claim("endpoint_count", F.concat(F.lit("c:"), part), F.concat(n, F.lit(" endpoints")), n)),
        F.transform(CL.version_claims(content), lambda c: claim(
            "dep_version", F.concat(F.lit("v:"), c["name"]), F.concat_ws(" ", c["name"], c["major"].cast("string")), c["major"])),
    )
    headings = T.candidate_lines(content, ["## ", f"<!-- {namespace.lower()}:start:"], True)
    present = lambda names: sum((F.col("headings").rlike(rf"(?i)## [^\n]*({'|'.join(a)})|<!-- {namespace}:start:({'|'.join(a)})").cast("int") for a in names.values()), F.lit(0))
    refs = T.matching_lines(content, f"<!-- {namespace}:refs:", [f"{namespace}:refs:"])
    read = docs.select("repo", "doc", claims.alias("claims"), headings.alias("headings"), refs.alias("refs")).select(
        "repo", "doc", "claims", "refs", present(fv.EXPECTED_SECTIONS).alias("sections"), present(fv.EXPECTED_IF_MANIFEST).alias("with_manifest"),
        present(fv.EXPECTED_IF_LICENSE).alias("with_license"))
    return read.select("repo", "doc", "refs", "sections", "with_manifest", "with_license", F.explode_outer("claims").alias("c")).select(
        "repo", "doc", "refs", "sections", "with_manifest", "with_license", "c.*")


def claim_facts(files: DataFrame, counts: DataFrame, versions: DataFrame) -> DataFrame:
    """(repo, key, value): what claims are held against, under the keys that they carry. Contents aren't read here."""
    paths = F.concat(
        F.array(F.concat(F.lit("f:"), F.col("path"))), F.transform(F.concat(F.array("path"), T.ancestors(F.col("path"))), lambda p: F.concat(F.lit("p:"), p)))
    known = files.select("repo", F.explode(paths).alias("key"), F.lit(1).cast("bigint").alias("value"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(SALT - 1)), lambda k: F.concat(F.lit("c:"), k.cast("string")))
    totals = counts.select("repo", F.explode(parts).alias("key"), F.col("endpoints").cast("bigint").alias("value"))
    declared = versions.select("repo", F.concat(F.lit("v:"), F.col("name")).alias("key"), CL.first_int(F.col("version")).alias("value"))
    return known.unionByName(totals).unionByName(declared).groupBy("repo", "key").agg(F.max("value").alias("value"))


def checked_claims(claims: DataFrame, facts: DataFrame, features: DataFrame) -> DataFrame:
    """The claims with expected, actual and passed, by one join with all facts. Documents without a claim, and version claims of
    repos without a package manifest, keep a row whose type is NULL."""
    # A row without a claim gets a key of its own, so that they don't gather in one partition.
    keyed = claims.withColumn("key", F.coalesce("key", F.concat(F.lit("\u0000"), "doc")))
    joined = keyed.join(facts.withColumn("known", F.lit(True)), ["repo", "key"], "left").join(features, "repo", "left")
    kind, value = F.col("type"), F.col("value")
    exists = kind.isin("file_exists", "ref_anchor")
    counted = F.coalesce(value, F.lit(0))
    near = (counted == 0) | F.coalesce(F.abs(F.col("number").try_cast("decimal(38,0)") - counted) <= fv.ENDPOINT_TOLERANCE, F.lit(False))
    declared = value.isNull() | F.coalesce(value == F.col("number").try_cast("bigint"), F.lit(False))
    counts = (kind != "dep_version") | F.coalesce("has_npm", F.lit(False))
    passed = F.when(exists, F.col("known").isNotNull()).when(kind == "endpoint_count", near).otherwise(declared)
    actual = F.when(exists, F.when(F.col("known").isNotNull(), "exists").otherwise("missing")).when(kind == "endpoint_count", counted.cast("string")).otherwise(
        F.coalesce(value.cast("string"), F.lit("none")))
    return joined.select(
        "repo", "doc", F.when(counts, kind).alias("type"), "claim", F.when(exists, "exists").otherwise(F.col("number")).alias("expected"), actual.alias("actual"),
        passed.alias("passed"), "refs", "sections", "with_manifest", "with_license", "has_manifest", "has_license")


def verified(docs: DataFrame, files: DataFrame, counts: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, quality per document), from one reading of the documents and one join with what is known of the code."""
    npm = dependencies.filter((F.col("kind") == "npm") & (F.col("path") == "package.json")).select("repo").distinct().withColumn("has_npm", F.lit(True))
    features = repo_features(files).join(npm, "repo", "full")
    rows = checked_claims(document_claims(docs), claim_facts(files, counts, declared_versions(dependencies)), features)
    n = lambda names: F.lit(len(names))
    manifest, license_ = F.coalesce(F.max("has_manifest"), F.lit(False)), F.coalesce(F.max("has_license"), F.lit(False))
    counted = rows.groupBy("repo", "doc").agg(
        F.count("type").alias("checks"), F.count_if(F.col("type").isNotNull() & F.col("passed")).alias("passed"),
        (n(fv.EXPECTED_SECTIONS) + F.when(manifest, n(fv.EXPECTED_IF_MANIFEST)).otherwise(0) + F.when(license_, n(fv.EXPECTED_IF_LICENSE)).otherwise(0)).cast("bigint").alias("expected"),
        (F.max("sections") + F.when(manifest, F.max("with_manifest")).otherwise(0) + F.when(license_, F.max("with_license")).otherwise(0)).cast("bigint").alias("present"),
        F.max("refs").cast("bigint").alias("refs"))
    return rows.filter("type IS NOT NULL").select(*CHECK), scored(counted)


def scored(counted: DataFrame) -> DataFrame:
    """Scores from the counts of a document, truncated at every step."""
    ratio = lambda a, b: F.when(F.col(b) > 0, T.int_div(F.col(a) * 100, F.nullif(F.col(b), F.lit(0)))).otherwise(F.lit(100).cast("bigint"))
    score = lambda c: (F.col(c).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(5,2)")
    hundredths = counted.withColumn("_a", ratio("passed", "checks")).withColumn("_c", ratio("present", "expected"))
    return hundredths.select(
        "repo", "doc", "checks", "passed", (F.col("checks") - F.col("passed")).alias("failed"),
        score("_a").alias("accuracy"), score("_c").alias("coverage"), F.lit(1).cast("decimal(5,2)").alias("freshness"),
        T.int_div(F.col("_a") * 50 + F.col("_c") * 35 + 1500, 100).alias("overall"), "refs",
    )
