"""What the import statements of a source file name, as (target, member) pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.code import language_family

USES = "array<struct<target:string,member:string>>"
VISIBLE = r"(?:pub(?:\([^)\n]*\))?\s+)?"


def import_uses(path: Column, content: Column) -> Column:
    """The pairs of a file, by its language. ``member`` is a name taken from the target that may be a module itself."""
    family = language_family(path)
    plain = lambda targets: F.transform(targets, lambda t: F.struct(t.alias("target"), F.lit(None).cast("string").alias("member")))
    found = (
        F.when(family == "js", plain(script_targets(content)).cast(USES)).when(family == "python", python_uses(content).cast(USES))
        .when(family == "go", plain(go_targets(content)).cast(USES)).when(family == "rust", plain(rust_targets(content)).cast(USES))
    )
    return F.array_distinct(F.filter(found, lambda x: x["target"] != ""))


def import_targets(path: Column, content: Column) -> Column:
    """Modules that a file's imports name; a name imported from a bare ``.`` is a module beside the file."""
    named = F.transform(
        import_uses(path, content),
        lambda x: F.when(x["target"].rlike(r"^\.+$"), F.concat(x["target"], F.coalesce(x["member"], F.lit("")))).otherwise(x["target"]),
    )
    return F.array_distinct(named)


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def script_targets(content: Column) -> Column:
    """``import``, ``export … from``, ``require`` and dynamic imports; a template literal counts if it has no holes."""
    return F.concat(
        every(content, r"""\b(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)"""),
        every(content, r"\b(?:require|import)\(\s*`([^`$]+)`\s*\)"),
        every(content, r"""(?m)(?:^|;)\s*(?:import|export)\b[^;'"()]*?\bfrom\s*['"]([^'"]+)['"]"""),
        every(content, r"""(?m)(?:^|;)\s*import\s*['"]([^'"]+)['"]"""),
    )


def python_uses(content: Column) -> Column:
    """``import a.b, c`` and ``from x import (y, z)``, over continued lines and lists in parentheses."""
    text = F.regexp_replace(content, r"\\\r?\n", " ")
    taken = r"(?m)^[ \t]*from\s+(\.*[A-Za-z0-9_.]*)\s+import\s*(\([^)]*\)|[^\n#;]+)"
    zipped = F.arrays_zip(every(text, taken, 1).alias("target"), every(text, taken, 2).alias("names"))

    def members(x: Column) -> Column:
        names = F.split(F.regexp_replace(x["names"], r"#[^\n]*|[()]", ""), ",")
        words = F.filter(F.transform(names, lambda n: F.regexp_extract(n, r"^\s*([A-Za-z0-9_*]+)", 1)), lambda n: n != "")
        return F.transform(words, lambda n: F.struct(x["target"].alias("target"), F.nullif(n, F.lit("*")).alias("member")))

    lists = F.flatten(F.transform(every(text, r"(?m)^[ \t]*import\s+([^\n#;]+)"), lambda names: F.split(names, ",")))
    whole = F.transform(lists, lambda n: F.struct(F.regexp_extract(n, r"^\s*([A-Za-z0-9_.]+)", 1).alias("target"), F.lit(None).cast("string").alias("member")))
    return F.concat(F.flatten(F.transform(zipped, members)).cast(USES), whole.cast(USES))


def go_targets(content: Column) -> Column:
    blocks = F.array_join(every(content, r"(?m)^\s*import\s*\(([^)]*)\)"), "\n")
    return F.concat(
        every(content, r"""(?m)^\s*import\s+(?:[A-Za-z0-9_.]+\s+)?"([^"\n]+)\""""), every(blocks, r"""(?m)^\s*(?:[A-Za-z0-9_.]+\s+)?"([^"\n]+)\"""")
    )


def rust_targets(content: Column) -> Column:
    """Every path of ``use`` trees, child modules as ``self::name``, and external crates."""
    trees = F.flatten(F.transform(every(content, rf"(?m)^\s*{VISIBLE}use\s+([^;]+);"), use_paths))
    children = F.transform(every(content, rf"(?m)^\s*{VISIBLE}mod\s+(?:r#)?([A-Za-z0-9_]+)\s*;"), lambda n: F.concat(F.lit("self::"), n))
    return F.concat(trees, children, every(content, rf"(?m)^\s*{VISIBLE}extern\s+crate\s+([A-Za-z0-9_]+)"))


def use_paths(tree: Column) -> Column:
    """Paths of one ``use`` tree: a fold over its signs with a stack of the prefixes that are open."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(tree, r"//[^\n]*", ""), r"\s+as\s+[A-Za-z0-9_]+", ""), r"\s+|r#", "")
    strings = F.array().cast("array<string>")
    start = F.struct(strings.alias("open"), F.lit("").alias("now"), strings.alias("out"))

    def step(s: Column, sign: Column) -> Column:
        prefix = F.coalesce(F.get(s["open"], F.size(s["open"]) - 1), F.lit(""))
        closes = sign.isin(",", "}")
        return F.struct(
            F.when(sign == "{", F.concat(s["open"], F.array(F.concat(prefix, s["now"]))))
            .when(sign == "}", F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"]).alias("open"),
            F.when(closes | (sign == "{"), F.lit("")).otherwise(sign).alias("now"),
            F.when(closes & (s["now"] != ""), F.concat(s["out"], F.array(F.concat(prefix, s["now"])))).otherwise(s["out"]).alias("out"),
        )

    signs = F.concat(F.regexp_extract_all(text, F.lit(r"[{},]|[^{},]+"), F.lit(0)), F.array(F.lit(",")))
    paths = F.aggregate(signs, start, step, lambda s: s["out"])
    # ``x::{self}`` and ``x::*`` name x.
    return F.transform(paths, lambda p: F.regexp_replace(p, r"^::|(?:::self|::\*)$", ""))
