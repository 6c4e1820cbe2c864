"""Source files and project manifests."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import text as T


#: Scheme and authority of a path: the lister names them even where the caller left them out.
STORE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/+"


#: Tasks for each core that read files, at most. A file counts as 4 MB where Spark deals files out, so that a task has few.
FILE_TASKS = 32


@contextmanager
def short_listings(spark: SparkSession) -> Iterator[None]:
    """Spark lists a folder of many folders in up to 10,000 tasks, and does so for every such folder. Here a listing has
    a few tasks for each core."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_corpus(spark: SparkSession, roots: str | list[str], path_glob: str | None = None) -> DataFrame:
    """Files of checked-out repositories: ``<root>/<repo>/<path>``, read recursively.

    Text that is not valid UTF-8 gets NULL content and is dropped by the binary filter. For anything large,
    compact once with ``write_files`` and read the table: many small files are slow on any cluster.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    names = [roots] if isinstance(roots, str) else list(roots)
    with short_listings(spark):
        raw = reader.load(names).coalesce(FILE_TASKS * spark.sparkContext.defaultParallelism)
    full = F.regexp_replace("path", STORE, "/")
    relative = full
    for root in (re.sub(STORE, "/", name).rstrip("/") + "/" for name in names):
        rest = full.substr(F.lit(len(root) + 1), F.length(full))
        relative = F.when(full.startswith(root), rest).otherwise(relative)
    text = F.when(F.is_valid_utf8("content"), F.col("content").cast("string"))
    return raw.select(
        F.split_part(relative, F.lit("/"), F.lit(1)).alias("repo"),
        F.regexp_replace(relative, r"^[^/]*/", "").alias("path"),
        text.alias("content"),
        T.suffix(relative).alias("language"),
        F.coalesce(T.line_count(text), F.lit(0)).alias("n_lines"),
        F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("last_modified"),
    )


#: What Spark's writers put in place of a null or empty value, and the characters they escape in the name of a folder.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def mounted(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder on a local or mounted disk; None for a folder in any other store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    uri = store.makeQualified(place).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_corpus(files: DataFrame, root: str) -> None:
    """Texts (repo, doc, value) as files for :func:`read_corpus`: a folder ``repo=<repo>`` for each repository, a file for
    each document in it. Values of one document follow one another in its file, and each ends with a line end.

    On a local or mounted disk Hadoop starts a process (``chmod``) for every file, checksum and folder that it makes, unless
    its native library is there, which PySpark lacks. So tasks write ``doc=<doc>.txt`` themselves there, each file under a
    name of the task's own first. In other stores Spark's writer makes a folder ``doc=<doc>`` with a file.
    """
    name = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NO_VALUE)).alias(c)
    dealt = files.select(name("repo"), name("doc"), "value").repartition("repo", "doc")
    folder = mounted(files.sparkSession, root)
    if folder is None:
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("repo", "doc").text(root)
        return

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        attempt, made = TaskContext.get().taskAttemptId(), 0
        escaped = lambda text: ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", text)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (doc, repo), lines in groupby(rows, itemgetter(0, 1)):
            inside, named = f"{folder}/repo={escaped(repo)}", f"doc={escaped(doc)}.txt"
            own = f"{inside}/.{named}.{attempt}"
            try:
                file = open(own, "wb")
            except FileNotFoundError:
                os.makedirs(inside, exist_ok=True)
                file = open(own, "wb")
            with file:
                for line in lines:
                    file.write((line[2] or b"") + b"\n")
            os.replace(own, f"{inside}/{named}")
            made += 1
        yield pa.RecordBatch.from_pydict({"files": [made]})

    os.makedirs(folder, exist_ok=True)
    # By document first: tasks that make files in one folder at the same time wait for one another.
    ordered = dealt.select("doc", "repo", F.col("value").cast("binary")).sortWithinPartitions("doc", "repo")
    ordered.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The compacted ``files`` table."""
    return spark.read.schema(schemas.FILES).parquet(path)


def write_files(files: DataFrame, path: str) -> None:
    files.write.mode("append").parquet(path)


def sorted_files(files: DataFrame) -> DataFrame:
    """Paths in order, for a sink that needs one: a range-partitioned sort without the contents."""
    return files.select("repo", "path", "n_lines").orderBy("repo", "path")


MANIFEST_KINDS = {
    "package.json": "npm", "lerna.json": "lerna", "pnpm-workspace.yaml": "pnpm", "Cargo.toml": "cargo",
    "go.mod": "go", "go.work": "go-work", "requirements.txt": "pip", "pyproject.toml": "pyproject",
}


def _pairs_to_map(names: Column, values: Column) -> Column:
    """A map from two parallel arrays; the first value of a repeated name wins."""
    keys = F.array_distinct(names)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.trim(F.get(values, (F.array_position(names, k) - 1).cast("int")))))


def _line_map(text: Column, pattern: str) -> Column:
    return _pairs_to_map(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)))


def _section(text: Column, header: str) -> Column:
    """Body of one ``[header]`` table of a TOML file."""
    return F.regexp_extract(text, rf"(?ms)^\[{header}\][^\n]*\n(.*?)(?=^\[|\z)", 1)


def _quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""["']([^"'\n]+)["']"""), F.lit(1))


def read_manifests(files: DataFrame) -> DataFrame:
    """Package manifests with their dependencies and workspace patterns; JSON is parsed, never matched."""
    base = T.basename(F.col("path"))
    kind = F.create_map(*[F.lit(x) for pair in MANIFEST_KINDS.items() for x in pair])[base]
    text = F.col("content")
    rows = files.filter(base.isin(list(MANIFEST_KINDS))).select("repo", "path", kind.alias("kind"), "content")
    json = F.from_json(F.when(F.col("kind").isin("npm", "lerna"), text), schemas.PACKAGE_JSON)
    rows = rows.withColumn("j", json)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    toml_pair = r"""(?m)^([A-Za-z0-9_.-]+)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?["']?([^"'\n,}]*)"""
    kind_is = lambda k: F.col("kind") == k
    deps = (
        F.when(kind_is("npm"), F.coalesce("j.dependencies", none))
        .when(kind_is("pip"), _line_map(text, r"(?m)^\s*([A-Za-z0-9_.-]+)(?:\[[^\]\n]*\])?[ \t]*([^#;\n]*)"))
        .when(kind_is("go"), _line_map(text, r"(?m)^(?:require\s+|\s+)([A-Za-z0-9_.~-]+(?:/[A-Za-z0-9_.~-]+)+)\s+(v[^\s]+)"))
        .when(kind_is("cargo"), _line_map(_section(text, "dependencies"), toml_pair))
        .when(kind_is("pyproject"), _line_map(
            F.concat_ws("\n", F.array_join(_quoted(F.regexp_extract(text, r"(?ms)^dependencies\s*=\s*\[(.*?)^\s*\]|^dependencies\s*=\s*\[(.*?)\]\s*$", 0)), "\n"),
                        _section(text, r"tool\.poetry\.dependencies")),
            r"(?m)^([A-Za-z0-9_.-]+)(?:\[[^\]\n]*\])?[ \t]*(?:=[ \t]*)?([^\n]*)"))
        .otherwise(none)
    )
    dev = F.when(kind_is("npm"), F.coalesce("j.devDependencies", none)).when(
        kind_is("cargo"), _line_map(_section(text, "dev-dependencies"), toml_pair)
    ).otherwise(none)
    ws = F.get_json_object(text, "$.workspaces")
    as_list = lambda s: F.from_json(s, "array<string>")
    pnpm_body = F.regexp_extract(text, r"(?ms)^packages:[^\n]*\n(.*?)(?=^[a-z]|\z)", 1)
    pnpm_items = F.regexp_extract_all(pnpm_body, F.lit(r"""(?m)^\s+-\s*['"]?([^'"\n]+?)['"]?[ \t]*$"""), F.lit(1))
    members = F.regexp_extract(_section(text, "workspace"), r"(?ms)^members\s*=\s*\[(.*?)\]", 1)
    use_block = F.regexp_extract(text, r"(?ms)^use\s*\((.*?)\)", 1)
    go_use = F.concat(
        F.regexp_extract_all(text, F.lit(r"(?m)^use\s+(\./[^\s]+)"), F.lit(1)),
        F.regexp_extract_all(use_block, F.lit(r"(?m)^\s*([^\s/][^\s]*)\s*$"), F.lit(1)),
    )
    lerna_packages = F.get_json_object(text, "$.packages")
    default_lerna = F.array(F.lit("packages/*"))
    workspaces = (
        F.when(kind_is("npm") & ws.startswith("["), as_list(F.when(ws.startswith("["), ws)))
        .when(kind_is("npm") & ws.startswith("{"), as_list(F.get_json_object(ws, "$.packages")))
        .when(kind_is("lerna"), F.when(lerna_packages.startswith("[") & (lerna_packages != "[]"),
                                       as_list(F.when(lerna_packages.startswith("["), lerna_packages))).otherwise(default_lerna))
        .when(kind_is("pnpm"), pnpm_items)
        .when(kind_is("cargo") & text.rlike(r"(?m)^\[workspace\]"), _quoted(members))
        .when(kind_is("go-work"), go_use)
    )
    name = (
        F.when(kind_is("npm") | kind_is("lerna"), F.col("j.name"))
        .when(kind_is("go"), F.regexp_extract(text, r"(?m)^module\s+([^\s]+)", 1))
        .when(kind_is("cargo") | kind_is("pyproject"), F.regexp_extract(text, r"""(?m)^name\s*=\s*["']([^"'\n]+)""", 1))
    )
    version = F.when(kind_is("npm") | kind_is("lerna"), F.col("j.version")).when(
        kind_is("cargo") | kind_is("pyproject"), F.regexp_extract(text, r"""(?m)^version\s*=\s*["']([^"'\n]+)""", 1)
    )
    blank = F.lit("")
    return rows.select(
        "repo", "path", "kind", F.nullif(name, blank).alias("name"), F.nullif(version, blank).alias("version"),
        F.col("j.description").alias("description"), F.col("j.main").alias("main"),
        deps.alias("dependencies"), dev.alias("dev_dependencies"), workspaces.alias("workspaces"),
    )


def dependency_rows(manifests: DataFrame, dev: bool = True) -> DataFrame:
    """One row per declared dependency: (repo, path, kind, dep, version, is_dev)."""
    runtime = manifests.select("repo", "path", "kind", F.explode("dependencies").alias("dep", "version"), F.lit(False).alias("is_dev"))
    if not dev:
        return runtime
    extra = manifests.select("repo", "path", "kind", F.explode("dev_dependencies").alias("dep", "version"), F.lit(True).alias("is_dev"))
    return runtime.unionByName(extra)
