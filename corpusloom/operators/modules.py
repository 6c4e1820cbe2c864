"""Imports resolved to files: every language's way from a name to a file becomes keys that two sides share.

A file has keys: its path without suffix, and names by the roots above it (npm packages, Go modules, Rust crates). An
import has candidate keys in the order in which its language would try them, with shorter prefixes behind longer ones.
Roots are found by an equi-join over the ancestors of directories, imports by an equi-join over candidate keys; the first
candidate that is a file wins. What matches nothing stays as it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.functions import text as T
from corpusloom.functions.imports import import_uses

JS_SUFFIX = r"\.(js|jsx|ts|tsx|mjs|cjs)$"
#: Copies of the file keys for the join: one popular module may be the target of a third of all imports.
SALT = 8


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts."""
    step = lambda acc, part: (
        F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def module_key(path: Column) -> Column:
    """What an import of a script file names: no suffix, and a directory for its index file."""
    return F.regexp_replace(F.regexp_replace(path, JS_SUFFIX, ""), r"(^|/)index$", "")


def folder(path: Column) -> Column:
    """The directory of a path, '' for the root."""
    return F.regexp_extract(path, r"^(.*)/", 1)


def parts(text: Column, sign: str) -> Column:
    return F.filter(F.split(text, sign), lambda x: x != "")


def prefixes(items: Column, least: int, sign: str, before: Column) -> Column:
    """``before`` with the first n, n-1, … ``least`` items joined by ``sign`` behind it."""
    counts = F.filter(F.transform(F.sequence(F.lit(0), F.size(items)), lambda k: F.size(items) - k), lambda n: n >= least)
    return F.transform(counts, lambda n: F.concat(before, F.array_join(F.slice(items, F.lit(1), n), sign)))


MARKS = ("package.json", "go.mod", "Cargo.toml", "lib.rs", "main.rs", "__init__.py")


def directory_marks(files: DataFrame) -> DataFrame:
    """(repo, root, npm, go, cargo, crate, init): what each directory with a manifest or a module file is the root of."""
    base, text = F.col("base"), F.col("content")
    name = (
        F.when(base == "package.json", F.get_json_object(text, "$.name")).when(base == "go.mod", F.regexp_extract(text, r"(?m)^\s*module\s+\"?([^\s\"]+)", 1))
        .when(base == "Cargo.toml", F.translate(F.regexp_extract(text, r"(?ms)^\[package\][^\[]*?^name\s*=\s*[\"']([^\"'\n]+)", 1), "-", "_"))
    )
    marks = files.withColumn("base", T.basename(F.col("path"))).filter(F.col("base").isin(*MARKS)).select(
        "repo", folder(F.col("path")).alias("root"), "base", F.nullif(name, F.lit("")).alias("name"))
    named = lambda kind: F.min(F.when(base == kind, F.col("name")))
    return marks.groupBy("repo", "root").agg(
        named("package.json").alias("npm"), named("go.mod").alias("go"), named("Cargo.toml").alias("cargo"),
        F.bool_or(base.isin("lib.rs", "main.rs")).alias("crate"), F.bool_or(base == "__init__.py").alias("init"))


def roots_of(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, dir, npm, go, rs, py): the nearest roots in or above each directory, as structs of root and name. ``py`` is the
    nearest directory that is no package."""
    above = F.concat(prefixes(parts(F.col("dir"), "/"), 1, "/", F.lit("")), F.array(F.lit("")))
    each = dirs.select("repo", "dir", F.posexplode(above).alias("up", "root")).withColumn("salt", F.pmod(F.xxhash64("dir"), F.lit(SALT)))
    # Every directory of a repo looks for its root.
    marks = directory_marks(files).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    met = each.join(marks, ["repo", "root", "salt"], "left")
    nearest = lambda value, is_it: F.min_by(value, F.when(is_it, F.col("up")))
    named = lambda kind: nearest(F.struct("root", F.col(kind).alias("name")), F.col(kind).isNotNull()).alias(kind)
    found = met.groupBy("repo", "dir").agg(
        named("npm"), named("go"), nearest(F.col("root"), F.col("crate")).alias("crate"), nearest(F.col("cargo"), F.col("cargo").isNotNull()).alias("cargo"),
        nearest(F.struct("root"), ~F.coalesce("init", F.lit(False))).alias("py"))
    crate = F.when(F.col("crate").isNotNull(), F.struct(F.col("crate").alias("root"), F.col("cargo").alias("name")))
    return found.select("repo", "dir", "npm", "go", crate.alias("rs"), "py")


def below(path: Column, root: Column) -> Column:
    return F.when(root == "", path).otherwise(F.substring(path, F.char_length(root) + 2, F.char_length(path)))


def joined(*names: Column) -> Column:
    """Parts of a path joined by ``/`` without the empty ones."""
    return F.array_join(F.filter(F.array(*names), lambda x: x != ""), "/")


def rust_module(path: Column, root: Column) -> Column:
    """The module that a file is in its crate: ``a::b`` of a/b.rs and a/b/mod.rs, '' of the crate's root file."""
    own = F.regexp_replace(below(path, root), r"\.rs$", "")
    return F.translate(F.regexp_replace(F.when(own.isin("lib", "main"), "").otherwise(own), r"(^|/)mod$", ""), "/", ":")


def file_keys(code: DataFrame, dirs: DataFrame) -> DataFrame:
    """(repo, key, file): the keys by which imports find a file. ``dirs`` has the roots of each directory."""
    path, family = F.col("path"), F.col("family")
    key = module_key(path)
    named = joined(F.col("npm.name"), below(key, F.col("npm.root")))
    sourced = joined(F.col("npm.name"), F.regexp_replace(below(key, F.col("npm.root")), r"^src(/|$)", ""))
    package = joined(F.col("go.name"), below(F.col("dir"), F.col("go.root")))
    module = rust_module(path, F.col("rs.root"))
    tag = lambda name, value: F.concat(F.lit(name), value)
    keys = (
        F.when(family == "js", F.array(tag("js:", key), tag("jsn:", named), tag("jsn:", sourced)))
        .when(family == "python", F.array(tag("py:", F.regexp_replace(path, r"(/__init__)?\.py$", ""))))
        .when((family == "go") & ~path.endswith("_test.go"), F.array(tag("go:", package)))
        .when(family == "rust", F.array(F.concat(F.lit("rs:"), F.col("rs.root"), F.lit("|"), module), F.concat(F.lit("rsn:"), F.concat_ws(":", "rs.name", F.nullif(module, F.lit("")))))))
    # A Go package is its directory; the file named like it stands for it.
    rank = F.when(T.basename(path) == F.concat(T.basename(F.col("dir")), F.lit(".go")), 0).otherwise(1)
    keyed = code.join(dirs, ["repo", "dir"], "left").select("repo", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"), rank.alias("rank"), "path")
    return keyed.groupBy("repo", "key").agg(F.min_by("path", F.struct("rank", "path")).alias("file"))


def candidates() -> Column:
    """Keys that an import may mean, in the order in which they are tried."""
    src, target, member = F.col("src"), F.col("target"), F.col("member")
    tag = lambda name, value: F.concat(F.lit(name), value)
    js = F.when(target.startswith("."), F.array(tag("js:", module_key(normal_path(F.concat_ws("/", F.col("dir"), target)))))).otherwise(
        F.array(tag("jsn:", F.regexp_replace(target, JS_SUFFIX, ""))))
    # Python: a dotted name below a directory, first with the member as a module.
    dots = F.char_length(F.regexp_extract(target, r"^(\.*)", 1))
    rest = F.translate(F.substring(target, dots + 1, F.char_length(target)), ".", "/")
    both = lambda where: F.array_compact(F.array(
        F.when(member.isNotNull(), tag("py:", joined(where, rest, member))), tag("py:", joined(where, rest))))
    up = normal_path(F.concat_ws("/", F.col("dir"), F.repeat(F.lit("../"), dots - 1)))
    # Absolute names start at directories that are no packages, from the nearest up.
    roots = F.concat(prefixes(parts(F.col("py.root"), "/"), 1, "/", F.lit("")), F.array(F.lit("")))
    absolute = F.flatten(F.transform(roots, lambda a: F.concat(both(a), both(joined(a, F.lit("src"))))))
    python = F.when(dots > 0, both(up)).otherwise(absolute)
    go = F.array(tag("go:", target))
    # Rust: items stand behind modules, so shorter prefixes are tried too.
    steps = parts(target, "::")
    own = parts(rust_module(src, F.col("rs.root")), ":")
    ups = F.size(F.filter(steps, lambda s: s == "super"))
    tail = F.filter(steps, lambda s: ~s.isin("crate", "self", "super"))
    at = F.concat(F.lit("rs:"), F.col("rs.root"), F.lit("|"))
    from_module = lambda drop: F.slice(own, F.lit(1), F.greatest(F.size(own) - drop, F.lit(0)))

    def inside(base: Column, least: int) -> Column:
        """Modules below ``base``, by at least ``least`` steps."""
        return F.transform(prefixes(tail, least, ":", F.lit("")), lambda k: F.concat(at, F.array_join(F.concat(base, parts(k, ":")), ":")))

    first = F.get(steps, 0)
    rust = (
        F.when(first == "crate", prefixes(tail, 0, ":", at))
        .when(first == "super", inside(from_module(ups), 0))
        .when(first == "self", inside(own, 1))
        .otherwise(F.concat(prefixes(tail, 1, ":", F.lit("rsn:")), inside(own, 1)))
    )
    family = F.col("family")
    return F.when(family == "js", js).when(family == "python", python).when(family == "go", go).when(family == "rust", F.filter(rust, lambda k: k.isNotNull()))


def resolved_imports(files: DataFrame, candidate: Column) -> DataFrame:
    """(repo, src, dst, is_internal) of files (repo, path, content): ``dst`` is a file of the repo where the import means one.

    ``candidate``: which files can hold imports at all, a rule over ``family`` and ``content``."""
    family = C.language_family(F.col("path"))
    marked = files.select("repo", F.col("path").alias("src"), "content", family.alias("family")).filter("family IS NOT NULL").filter(candidate)
    uses = marked.select("repo", "src", "family", folder(F.col("src")).alias("dir"), F.explode(import_uses(F.col("src"), F.col("content"))).alias("u"))
    code = files.select("repo", "path", family.alias("family"), folder(F.col("path")).alias("dir")).filter("family IS NOT NULL")
    dirs = roots_of(code.select("repo", "dir").distinct(), files)
    edges = uses.select("repo", "src", "family", "dir", "u.target", "u.member").join(dirs, ["repo", "dir"], "left")
    none = F.array(F.lit(None).cast("string"))
    keyed = edges.withColumn("c", candidates()).select(
        "repo", "src", "target", "member", F.posexplode_outer(F.coalesce("c", none)).alias("at", "key"), F.pmod(F.xxhash64("src", "target"), F.lit(SALT)).alias("salt"))
    # A use without candidates gets a key of its own, so that those don't gather in one partition.
    keyed = keyed.withColumn("key", F.coalesce("key", F.concat(F.lit("\u0000"), "src", "target")))
    modules = file_keys(code, dirs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    found = keyed.join(modules, ["repo", "key", "salt"], "left").groupBy("repo", "src", "target", "member").agg(
        F.min_by("file", F.when(F.col("file").isNotNull(), F.col("at"))).alias("file"))
    internal = C.is_internal_import(F.col("target")) | F.col("file").isNotNull()
    return found.select("repo", "src", F.coalesce("file", "target").alias("dst"), internal.alias("is_internal")).distinct()
