"""Content hashes against saved snapshots: what changed, what is cached, what went missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

LANES = 4


def file_hashes(files: DataFrame) -> DataFrame:
    """(repo, path, sha256). The text is hashed in the scan; only 64 digits per file are ever shuffled. A stored
    manifest passes through: with it, no check, baseline or digest reads any content."""
    if "sha256" in files.columns:
        return files.select("repo", "path", "sha256")
    return files.select("repo", "path", T.content_hash(F.col("content")).alias("sha256"))


def _with_lanes(hashes: DataFrame) -> DataFrame:
    """Add the 60-bit lanes of the hash of (path, content hash), one SHA-256 per file."""
    digest = hashes.withColumn("_d", F.sha2(F.concat_ws("\n", "path", "sha256"), 256))
    lanes = {f"lane{i}": F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(LANES)}
    return digest.withColumns(lanes).drop("_d")


def _combined(count: Column) -> Column:
    return F.sha2(F.concat_ws("|", count.cast("string"), *[F.col(f"lane{i}").cast("string") for i in range(LANES)]), 256)


def dir_digest(hashes: DataFrame) -> DataFrame:
    """One digest per directory over all (path, hash) pairs below it.

    Two directories have equal digests exactly when they hold the same files with the same contents. The
    pairs are combined by an order-free 240-bit XOR of their hashes, so a directory of any size is aggregated
    map-side and never listed in one task. Files are first reduced to their own directory, and only those
    directory rows fan out to the ancestors.
    """
    own = _with_lanes(hashes).groupBy("repo", T.dirname(F.col("path")).alias("dir")).agg(
        F.count("*").alias("n_files"), *[F.bit_xor(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])
    up = F.when(F.col("dir") == ".", F.array(F.lit("."))).otherwise(
        F.concat(T.ancestors(F.col("dir")), F.array(F.col("dir")))
    )
    return (
        own.select("repo", F.explode(up).alias("path"), "n_files", *[f"lane{i}" for i in range(LANES)])
        .groupBy("repo", "path")
        .agg(F.sum("n_files").alias("n_files"), *[F.bit_xor(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])
        .select("repo", "path", "n_files", _combined(F.col("n_files")).alias("sha256"))
    )


def cited_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files that ``wanted`` (repo, path) names, or that lie below a directory it names.

    Paths meet first, without contents; contents are joined to the few files left, so that only those are hashed.
    """
    named = wanted.select("repo", F.col("path").alias("at")).distinct()
    above = files.select("repo", "path", F.explode(F.concat(F.array("path"), T.ancestors(F.col("path")))).alias("at"))
    return files.join(above.join(named, ["repo", "at"], "left_semi").select("repo", "path").distinct(), ["repo", "path"], "left_semi")


OWN = [f"own{i}" for i in range(LANES + 1)]
LANE = [f"lane{i}" for i in range(LANES)]


def _as_numbers(sha256: str) -> dict[str, Column]:
    """A hash as whole numbers of 15 hexadecimal digits: with a string an aggregate would have to sort."""
    return {f"own{i}": F.conv(F.substring(sha256, 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(LANES + 1)}


def _as_digits(numbers: list[str]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 15 if i < LANES else 4, "0") for i, c in enumerate(numbers)])


def hash_state(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(repo, path, is_file, n_files, lane0 … lane4): the mergeable state behind the hash of every file and directory.

    Each file counts for itself and for its ancestors, so files and directories come out of one aggregate that is
    partitioned on (repo, path) for the joins that follow. A file's lanes are its hash, a directory's the XOR of the
    lanes of what lies below. With ``wanted`` (repo, path), only of those paths, and only their files are read.
    """
    hashed = _with_lanes(file_hashes(files if wanted is None else cited_files(files, wanted)))
    targets = F.concat(
        F.array(F.struct(F.col("path").alias("path"), F.lit(True).alias("is_file"))),
        F.transform(T.ancestors(F.col("path")), lambda d: F.struct(d.alias("path"), F.lit(False).alias("is_file"))),
    )
    fanned = hashed.withColumns(_as_numbers("sha256")).select("repo", *OWN, *LANE, F.explode(targets).alias("t"))
    if wanted is not None:
        named = wanted.select(F.col("repo").alias("_repo"), F.col("path").alias("_path")).distinct()
        fanned = fanned.join(named, (F.col("repo") == F.col("_repo")) & (F.col("t.path") == F.col("_path")), "left_semi")
    is_file = F.col("t.is_file")
    mixed = [
        F.bit_xor(F.when(is_file, F.col(f"own{i}")).otherwise(F.col(f"lane{i}") if i < LANES else F.lit(0))).alias(f"lane{i}")
        for i in range(LANES + 1)
    ]
    return fanned.groupBy("repo", F.col("t.path").alias("path")).agg(F.bool_or(is_file).alias("is_file"), F.count("*").alias("n_files"), *mixed)


def state_hashes(state: DataFrame) -> DataFrame:
    """(repo, path, sha256) of a hash state."""
    own = _as_digits([f"lane{i}" for i in range(LANES + 1)])
    return state.select("repo", "path", F.when(F.col("is_file"), own).otherwise(_combined(F.col("n_files"))).alias("sha256"))


def path_hashes(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Current hash of every file and every directory, from the contents or from a stored manifest; with ``wanted``
    (repo, path), only of those, and only what they cite is read."""
    return state_hashes(hash_state(files, wanted))


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A stored hash state after ``changes`` (repo, path, content), where a null content is a file removed.

    Reads the contents of the changed files and nothing else. XOR takes a file's old lanes out of the digests of its
    directories and its new ones in; the old ones follow from its stored hash. A change that names a file twice isn't
    one change: give the last.
    """
    lanes = [f"lane{i}" for i in range(LANES + 1)]
    new = changes.filter(F.col("content").isNotNull()).select("repo", "path", T.content_hash(F.col("content")).alias("sha256"))
    old = state.filter("is_file").join(changes.select("repo", "path"), ["repo", "path"], "left_semi").select("repo", "path", _as_digits(lanes).alias("sha256"))
    signed = _with_lanes(new).withColumn("n", F.lit(1)).unionByName(_with_lanes(old).withColumn("n", F.lit(-1)))
    up = signed.select("repo", F.explode(T.ancestors(F.col("path"))).alias("path"), "n", *LANE)
    delta = up.groupBy("repo", "path").agg(F.sum("n").alias("dn"), *[F.bit_xor(c).alias(f"d{c}") for c in LANE])
    dirs = state.filter("NOT is_file").join(delta, ["repo", "path"], "full")
    moved = dirs.select(
        "repo", "path", F.lit(False).alias("is_file"), (F.coalesce("n_files", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n_files"),
        *[F.coalesce(c, F.lit(0)).bitwiseXOR(F.coalesce(f"d{c}", F.lit(0))).alias(c) for c in LANE], F.lit(0).cast("bigint").alias(f"lane{LANES}"),
    ).filter("n_files > 0")
    kept = state.filter("is_file").join(changes.select("repo", "path"), ["repo", "path"], "left_anti")
    added = new.withColumns(_as_numbers("sha256")).select(
        "repo", "path", F.lit(True).alias("is_file"), F.lit(1).cast("bigint").alias("n_files"), *[F.col(o).alias(c) for o, c in zip(OWN, lanes, strict=True)])
    return kept.select(*added.columns).unionByName(added).unionByName(moved)


def dir_hash(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Digest of each referenced directory; only files below one of them are read and listed."""
    wanted = refs.select("repo", "path").distinct()
    return wanted.join(dir_digest(file_hashes(cited_files(files, wanted))), ["repo", "path"])


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each current file as changed or cached against the saved manifest (no entry means changed)."""
    saved = manifest.select("repo", "path", F.col("sha256").alias("saved_sha256"))
    same = F.coalesce(F.col("sha256") == F.col("saved_sha256"), F.lit(False))
    return file_hashes(files).join(saved, ["repo", "path"], "left").select(
        "repo", "path", "sha256", F.when(same, "cached").otherwise("changed").alias("state")
    )


def cache_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("repo").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "changed").alias("changed"),
        F.count_if(F.col("state") == "cached").alias("cached"),
    )


def orphaned_cache(cache: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept entries, removed entries) of the analysis cache, by whether a manifest still names the hash."""
    live = manifest.select("sha256").distinct()
    return cache.join(live, "sha256", "left_semi"), cache.join(live, "sha256", "left_anti")


def distinct_refs(refs: DataFrame) -> DataFrame:
    return refs.select("repo", F.col("path").alias("ref_path")).distinct()


def compare_baseline(refs: DataFrame, hashes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each distinct referenced path as missing, new, changed or unchanged, tested in that order."""
    current = hashes.select("repo", F.col("path").alias("ref_path"), F.col("sha256").alias("current_sha256"))
    saved = baseline.select("repo", "ref_path", F.col("sha256").alias("saved_sha256"))
    state = (
        F.when(F.col("current_sha256").isNull(), "missing")
        .when(F.col("saved_sha256").isNull(), "new")
        .when(F.col("current_sha256") != F.col("saved_sha256"), "changed")
        .otherwise("unchanged")
    )
    return (
        distinct_refs(refs)
        .join(current, ["repo", "ref_path"], "left")
        .join(saved, ["repo", "ref_path"], "left")
        .select("repo", "ref_path", state.alias("state"))
    )


def baseline_counts(compared: DataFrame) -> DataFrame:
    states = ["unchanged", "changed", "missing", "new"]
    return compared.groupBy("repo").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in states]
    )


def ref_changes(refs: DataFrame, hashes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every reference row with ``changed``: gone, not in the baseline, or hashed differently.

    The references are joined as they are, so the documents behind them are read once. Rows without a path get
    a key of their own: they match nothing and spread evenly instead of meeting in one NULL partition.
    """
    key = F.coalesce("path", F.concat(F.lit("\u0000"), F.xxhash64(*refs.columns).cast("string")))
    keyed = refs.withColumn("_key", key)
    current = hashes.select("repo", F.col("path").alias("_key"), F.col("sha256").alias("_now"))
    saved = baseline.select("repo", F.col("ref_path").alias("_key"), F.col("sha256").alias("_then"))
    joined = keyed.join(current, ["repo", "_key"], "left").join(saved, ["repo", "_key"], "left")
    same = F.coalesce(F.col("_now") == F.col("_then"), F.lit(False))
    return joined.select(*refs.columns, (~same).alias("changed"))


def latest_snapshot(table: DataFrame, keys: list[str], ts: str = "saved_at", as_of: Column | None = None) -> DataFrame:
    """Newest row per key. An aggregate rather than a window: each task keeps one row per key before anything crosses. Where
    rows hold strings, Spark sorts inside the tasks for it; ``sources.levels`` keeps whole histories from coming here."""
    rows = table if as_of is None else table.filter(F.col(ts) <= as_of)
    rest = [c for c in table.columns if c not in keys and c != ts]
    return (
        rows.groupBy(*keys).agg(F.max(F.struct(F.col(ts), *[F.col(c) for c in rest])).alias("_s"))
        .select(*keys, "_s.*").select(*table.columns)
    )


def baseline_rows(refs: DataFrame, files: DataFrame, saved_at: Column) -> DataFrame:
    """A baseline for every distinct referenced file or directory that exists now."""
    hashes = path_hashes(files, refs).withColumnRenamed("path", "ref_path")
    return distinct_refs(refs).join(hashes, ["repo", "ref_path"]).select(
        "repo", "ref_path", "sha256", saved_at.alias("saved_at")
    )
