"""Endpoints, exports, imports and other facts read from single source lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import text as T

TEST_PATH = r"test|spec|mock"
TEST_OR_MIN_PATH = r"test|spec|mock|\.min\."


def top_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def language_family(path: Column) -> Column:
    ext = T.suffix(path)
    rule = None
    for family, names in fv.FAMILY_SUFFIXES.items():
        rule = F.when(ext.isin(names), family) if rule is None else rule.when(ext.isin(names), family)
    return rule


def endpoint_scope(path: Column, family: str, variant: str) -> Column:
    """Whether a file may hold endpoints of a family under a counting rule."""
    scope = top_dir(path).isin(fv.SOURCE_ROOTS[family])
    if variant != "reference":
        scope = scope & T.suffix(path).isin(fv.FAMILY_SUFFIXES[family])
    if family == "js":
        scope = scope & ~path.rlike(TEST_OR_MIN_PATH)
    return scope


def export_scope(path: Column, family: str) -> Column:
    scope = top_dir(path).isin(fv.EXPORT_ROOTS[family]) & T.suffix(path).isin(fv.FAMILY_SUFFIXES[family])
    return scope & ~path.rlike(TEST_PATH) if family in ("js", "python") else scope


def by_family(path: Column, line: Column, patterns: dict[str, str], scope) -> Column:
    rule = None
    for family, pattern in patterns.items():
        hit = scope(path, family) & line.rlike(pattern)
        rule = F.when(hit, family) if rule is None else rule.when(hit, family)
    return rule


def endpoint_family(path: Column, line: Column, variant: str = "coverage") -> Column:
    """Language family of a route registration, NULL for other lines."""
    return by_family(path, line, fv.ENDPOINT_PATTERNS[variant], lambda p, f: endpoint_scope(p, f, variant))


def export_family(path: Column, line: Column) -> Column:
    return by_family(path, line, fv.EXPORT_PATTERNS, export_scope)


def route_method(line: Column) -> Column:
    """HTTP verb in capitals; ``route`` and handler-function registrations give ANY."""
    dotted = F.regexp_extract(line, r"(?i)\.(get|post|put|patch|delete|options|head|all|route)\s*\(", 1)
    bracket = F.regexp_extract(line, r"#\[(get|post|put|delete|patch)\(", 1)
    verb = F.upper(F.coalesce(F.nullif(dotted, F.lit("")), F.nullif(bracket, F.lit("")), F.lit("ANY")))
    return F.when(verb.isin("ALL", "ROUTE"), "ANY").otherwise(verb)


def route_path(line: Column) -> Column:
    """First quoted argument that starts with a slash, NULL when there is none."""
    return F.nullif(F.regexp_extract(line, r"""\(\s*['"`](/[^'"`]*)['"`]""", 1), F.lit(""))


def resource_of(route: Column, path: Column) -> Column:
    """``/api/users/:id`` is resource ``users``; a route without a name falls back to the file stem."""
    named = F.regexp_extract(route, r"^/(?:api/)?(?:v[0-9]+/)?([A-Za-z][A-Za-z0-9_-]*)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), T.file_stem(path))


def export_kind(line: Column) -> Column:
    js = F.regexp_extract(line, r"export (?:default )?(?:async )?(function|class|const|let|var|interface|type|enum)\s", 1)
    py = F.regexp_extract(line, r"^(def|class) [A-Za-z]", 1)
    go = F.regexp_extract(line, r"^(func|type) [A-Z]", 1)
    rust = F.regexp_extract(line, r"^pub (fn|struct|enum|trait|type|const)", 1)
    blank = F.lit("")
    return F.coalesce(
        F.nullif(js, blank), F.nullif(py, blank), F.nullif(go, blank), F.nullif(rust, blank),
        F.when(line.contains("module.exports"), "module"),
    )


def export_name(line: Column) -> Column:
    """Declared name; assignments to module.exports give the assigned identifier when there is one."""
    js = F.regexp_extract(
        line, r"export (?:default )?(?:async )?(?:function|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)", 1
    )
    module = F.regexp_extract(line, r"module\.exports\s*=\s*([A-Za-z_$][A-Za-z0-9_$]*)", 1)
    other = F.regexp_extract(
        line, r"^(?:def|class|func|type|pub fn|pub struct|pub enum|pub trait|pub type|pub const) ([A-Za-z][A-Za-z0-9_]*)", 1
    )
    blank = F.lit("")
    return F.coalesce(F.nullif(js, blank), F.nullif(module, blank), F.nullif(other, blank))


# Texts of which one must occur in any import line, by language family.
IMPORT_NEEDLES = {"js": ["require(", "import", "export"], "python": ["import"], "go": ["import"], "rust": ["use ", "mod ", "crate "]}


def is_internal_import(target: Column) -> Column:
    return target.startswith(".") | target.rlike(r"^(crate|self|super)(::|$)")


# Reading a variable from the environment, one capture group for its name.
ENV_VAR = (
    r"""(?:process\.env\.|os\.environ\[['"]|os\.environ\.get\(['"]|os\.getenv\(['"]|os\.Getenv\("|env::var\(")"""
    r"""([A-Za-z_][A-Za-z0-9_]*)"""
)


ENV_NEEDLES = ["process.env.", "os.environ", "os.getenv(", "os.Getenv(", "env::var("]


def env_vars(content: Column) -> Column:
    """Distinct names of environment variables a file reads."""
    lines = T.candidate_lines(content, ENV_NEEDLES)
    return F.array_distinct(F.regexp_extract_all(lines, F.lit(ENV_VAR), F.lit(1)))


AUTH_HINT = (
    r"(?i)(authenticate|requireAuth|require_auth|jwt_required|login_required|isAuthenticated|ensureAuth"
    r"|passport\.|authorize|Depends\(get_current_user)"
)


def auth_hint(line: Column) -> Column:
    """True when an authentication guard is visible; unknown is NULL, never false."""
    return F.when(line.rlike(AUTH_HINT), F.lit(True))


def graphql_hint(path: Column, content: Column) -> Column:
    decorated = content.contains("@") & content.rlike(r"@(Query|Mutation|Subscription)\b")
    return path.rlike(r"\.(graphql|gql)$") | T.holds_any(content, ["typeDefs", "resolvers"]) | decorated
