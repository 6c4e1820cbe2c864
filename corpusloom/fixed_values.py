"""Constants that results depend on, stated plainly and in one place."""

from __future__ import annotations

from typing import NamedTuple


class SecretPattern(NamedTuple):
    """A pattern and, where known, texts of which one must be there for it to match at all."""

    pattern_id: int
    name: str
    regex: str
    severity: str = "high"
    needles: tuple[str, ...] = ()


# Secret patterns (id, name, regular expression, severity, texts that a match must contain).
SECRET_PATTERNS: list[SecretPattern] = [
    SecretPattern(1, "AWS Access Key", r"AKIA[0-9A-Z]{16}", "critical", ("AKIA",)),
    SecretPattern(2, "OpenAI API Key", r"sk-[a-zA-Z0-9]{20,}", "high", ("sk-",)),
    SecretPattern(3, "GitHub Token", r"ghp_[A-Za-z0-9]{36}", "high", ("ghp_",)),
    SecretPattern(4, "GitHub Token", r"gho_[A-Za-z0-9]{36}", "high", ("gho_",)),
    SecretPattern(5, "GitHub Token", r"ghu_[A-Za-z0-9]{36}", "high", ("ghu_",)),
    SecretPattern(6, "GitLab Token", r"glpat-[A-Za-z0-9_-]{20}", "high", ("glpat-",)),
    SecretPattern(7, "Stripe Key", r"sk_live_[a-zA-Z0-9]{24,}", "critical", ("sk_live_",)),
    SecretPattern(8, "Stripe Key", r"pk_live_[a-zA-Z0-9]{24,}", "high", ("pk_live_",)),
    SecretPattern(9, "Twilio", r"SK[a-f0-9]{32}", "high", ("SK",)),
    SecretPattern(10, "Slack Token", r"xox[bpors]-[0-9a-zA-Z-]{10,}", "high", ("xox",)),
    SecretPattern(11, "Private Key Header", r"-----BEGIN.*PRIVATE KEY-----", "critical", ("PRIVATE KEY-----",)),
    SecretPattern(12, "JWT Token", r"eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "high", ("eyJ",)),
    SecretPattern(
        13, "Database URL", r"(mongodb|postgresql|postgres|mysql|redis|amqp)://[^\s]{8,}", "critical",
        ("mongodb://", "postgresql://", "postgres://", "mysql://", "redis://", "amqp://"),
    ),
    SecretPattern(
        14,
        "Generic Secret",
        r"""(api_key|api_secret|secret_key|private_key|auth_token|access_token)\s*[=:]\s*['"][^'"]{8,}""",
        "high",
        ("api_key", "api_secret", "secret_key", "private_key", "auth_token", "access_token"),
    ),
    SecretPattern(
        15, "Generic Password", r"""(password|passwd|pwd)\s*[=:]\s*['"][^'"]{8,}""", "high", ("password", "passwd", "pwd")
    ),
    SecretPattern(16, "Google API Key", r"AIza[0-9A-Za-z_-]{35}", "high", ("AIza",)),
]

# Directories and file names that are never analysed.
HARD_EXCLUDE_DIRS = [
    "node_modules", ".git", "dist", "build", "vendor", ".next", "__pycache__", ".pytest_cache", "target",
    ".gradle", "secrets", "credentials", ".ssh",
]
HARD_EXCLUDE_NAMES = [
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "*.min.js", "*.min.css", "*.map", "*.lock",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "credentials.json", "secrets.yml", "secrets.yaml",
]

# Default include and exclude globs.
DEFAULT_INCLUDES = ["src/**", "lib/**", "app/**", "cmd/**", "pkg/**", "internal/**"]
DEFAULT_EXCLUDES = ["**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/__mocks__/**"]

# Root-level files that are kept whatever the include prefixes say.
ROOT_CONFIG_NAMES = [
    "package.json", "tsconfig.json", "go.mod", "Cargo.toml", "requirements.txt", "pyproject.toml", "Pipfile",
    "Gemfile", "pom.xml", "build.gradle*", "*.md", "*.yml", "*.yaml", "*.toml", "*.json", "Makefile",
    "Dockerfile", "docker-compose.yml",
]

# Suffixes the secret scan skips.
NON_CODE_SUFFIXES = ["md", "hbs", "lock", "svg", "png", "jpg"]

# Source roots by language family, and for file counts and gaps.
SOURCE_ROOTS = {
    "js": ["src", "lib", "app", "routes"],
    "python": ["src", "lib", "app"],
    "go": ["cmd", "pkg", "internal"],
    "rust": ["src"],
}
EXPORT_ROOTS = {
    "js": ["src", "lib", "app"],
    "python": ["src", "lib", "app"],
    "go": ["cmd", "pkg", "internal"],
    "rust": ["src"],
}
ALL_SOURCE_ROOTS = ["src", "lib", "app", "cmd", "pkg", "internal", "routes"]
FAMILY_SUFFIXES = {
    "js": ["js", "jsx", "ts", "tsx", "mjs", "cjs"],
    "python": ["py"],
    "go": ["go"],
    "rust": ["rs"],
}

# Endpoint registrations. "coverage" and "verify" are the two counting rules; the loose forms
# below them count any line that looks like a call, whatever the file type.
ENDPOINT_PATTERNS = {
    "coverage": {
        "js": r"""\.(get|post|put|patch|delete|options|head|all)\s*\(\s*['"`]/""",
        "python": r"@(app|router|api)\.(route|get|post|put|patch|delete)",
        "go": r"(HandleFunc|\.GET|\.POST|\.PUT|\.DELETE|\.PATCH)\(",
        "rust": r"#\[(get|post|put|delete|patch)\(",
    },
    "verify": {
        "js": r"""\.(get|post|put|delete|patch|options|head)\s*\(\s*['"`]/""",
        "python": r"@(app|router)\.(route|get|post|put|delete|patch)",
        "go": r"(HandleFunc|\.GET|\.POST|\.PUT|\.DELETE|\.PATCH)\(",
    },
    "reference": {
        "js": r"\.(get|post|put|patch|delete|options|head|all)\s*\(",
        "python": r"@(app|router|api)\.(route|get|post|put|patch|delete)",
        "go": r"(HandleFunc|\.GET|\.POST|\.PUT|\.DELETE|\.PATCH)\(",
        "rust": r"#\[(get|post|put|delete|patch)\(",
    },
}

# Texts of which one must occur in any line that an endpoint pattern matches.
ENDPOINT_NEEDLES = {
    "js": [".get", ".post", ".put", ".patch", ".delete", ".options", ".head", ".all"],
    "python": ["@app.", "@router.", "@api."],
    "go": ["HandleFunc(", ".GET(", ".POST(", ".PUT(", ".DELETE(", ".PATCH("],
    "rust": ["#["],
}

# Export declarations by language family.
EXPORT_PATTERNS = {
    "js": r"(module\.exports|export (default )?(async )?(function|class|const|let|var|interface|type|enum))\s",
    "python": r"^(def|class) [A-Za-z]",
    "go": r"^(func|type) [A-Z]",
    "rust": r"^pub (fn|struct|enum|trait|type|const)",
}

# Texts of which one must occur in any line that an export pattern matches.
EXPORT_NEEDLES = {"js": ["export"], "python": ["def ", "class "], "go": ["func ", "type "], "rust": ["pub "]}

# What counts as an export when looking for undocumented files, and in which files.
GAP_EXPORT = r"^(?:.*module\.exports|.*export |pub |func [A-Z]|type [A-Z]|def |class )"
GAP_NEEDLES = ["module.exports", "export ", "pub ", "func ", "type ", "def ", "class "]
GAP_SUFFIXES = ["js", "ts", "tsx", "py", "go", "rs"]

# Bytes per token in tenths, first match wins; average bytes per line; pass sizes in tokens.
BYTES_PER_TOKEN_TENTHS = [
    (["typescript", "javascript"], 35),
    (["python"], 40),
    (["go"], 36),
    (["rust"], 34),
    (["java", "kotlin"], 33),
    (["ruby"], 42),
]
DEFAULT_BYTES_PER_TOKEN_TENTHS = 38
BYTES_PER_LINE = 40
ANALYSIS_INPUT_PERCENT = 40
ANALYSIS_OUTPUT_TOKENS = 3000
GENERATION_TOKENS = 9000
REVIEW_TOKENS = {"minimal": 0, "standard": 11700, "thorough": 14400}

# Budget presets (max is None where the preset has no ceiling).
BUDGET_PRESETS = {
    "frugal": {"max": 100000, "warn": 50000, "auto": 20000, "profile": "minimal"},
    "balanced": {"max": None, "warn": 150000, "auto": 50000, "profile": "standard"},
    "quality-first": {"max": None, "warn": 300000, "auto": 100000, "profile": "thorough"},
}
MAX_FILES_PER_CHUNK = 50
OVERSIZE_LINES = 500

# Decision reasons by keyword, tested in this order after the two size rules.
LARGE_REFACTOR_FILES = 10
LARGE_CHANGE_LINES = 200
DECISION_KEYWORDS = [
    ("infrastructure-change", r"(docker|kubernetes|k8s|terraform|ci/cd|pipeline|workflow|deploy|infra)"),
    (
        "dependency-change",
        r"(add|remove|upgrade|downgrade|migrate|switch|replace|bump)\s.*"
        r"(dependenc|package|library|framework|version)",
    ),
    (
        "architecture-change",
        r"(refactor|restructure|reorganize|redesign|rearchitect|migrate|extract|split|merge|consolidate"
        r"|decouple|modularize)",
    ),
    ("breaking-change", r"(break|breaking|deprecat|remove|drop support|rename api|new api)"),
]

# Claims found in prose.
MENTIONED_PATH = r"(?:src|lib|app|cmd|pkg|internal|tests?|scripts?)/[a-zA-Z0-9_./-]+\.[a-zA-Z]{1,5}"
COUNT_CLAIM = r"(?i)([0-9]+) (?:api )?(?:endpoints?|routes?|apis?)"
VERSION_CLAIM_NAMES = [
    "express", "react", "next", "vue", "angular", "fastify", "nestjs", "django", "flask", "fastapi", "gin", "actix", "axum",
]
VERSION_CLAIM = rf"(?i)({'|'.join(VERSION_CLAIM_NAMES)})[ \t]+v?([0-9]+)"
DOC_ENDPOINT_MENTION = r"(GET|POST|PUT|PATCH|DELETE)[ \t]+/"
DOC_ENDPOINT_NEEDLES = ["GET", "POST", "PUT", "PATCH", "DELETE"]
ENDPOINT_TOLERANCE = 2

# Sections a document is expected to have, each with its accepted aliases.
EXPECTED_SECTIONS = {
    "description": ["description", "overview", "about", "introduction", "header"],
    "installation": ["installation", "install", "setup", "quickstart", "quick-start", "getting-started"],
    "usage": ["usage", "api", "endpoints", "commands", "examples"],
    "features": ["features", "highlights", "capabilities"],
}
EXPECTED_IF_MANIFEST = {"architecture": ["architecture", "structure", "design", "project-structure"]}
EXPECTED_IF_LICENSE = {"license": ["license"]}

# Frameworks by dependency name. The JSON dictionary matches whole keys; the line formats match
# text inside one manifest file.
JSON_FRAMEWORKS = {
    "express": "express", "fastify": "fastify", "koa": "koa", "hapi": "hapi", "@hapi/hapi": "hapi",
    "react": "react", "next": "next", "vue": "vue", "nuxt": "nuxt", "angular": "angular",
    "@angular/core": "angular", "svelte": "svelte", "nestjs": "nestjs", "@nestjs/core": "nestjs",
    "jest": "jest", "vitest": "vitest", "mocha": "mocha",
}
LINE_FRAMEWORKS = [
    ("requirements.txt", "(?i)django", "django"),
    ("requirements.txt", "(?i)flask", "flask"),
    ("requirements.txt", "(?i)fastapi", "fastapi"),
    ("requirements.txt", "(?i)pytest", "pytest"),
    ("pyproject.toml", "(?i)django", "django"),
    ("pyproject.toml", "(?i)flask", "flask"),
    ("pyproject.toml", "(?i)fastapi", "fastapi"),
    ("go.mod", "gin-gonic", "gin"),
    ("go.mod", "gorilla/mux", "gorilla"),
    ("go.mod", "labstack/echo", "echo"),
    ("go.mod", "gofiber/fiber", "fiber"),
    ("Cargo.toml", "actix-web", "actix"),
    ("Cargo.toml", "axum", "axum"),
    ("Cargo.toml", "rocket", "rocket"),
    ("Cargo.toml", "tokio", "tokio"),
    ("Gemfile", "rails", "rails"),
    ("Gemfile", "sinatra", "sinatra"),
    ("pom.xml", "spring", "spring"),
    ("build.gradle", "spring", "spring"),
]
CONFIG_FRAMEWORKS = {
    "vite.config.js": "vite", "vite.config.ts": "vite",
    "webpack.config.js": "webpack", "webpack.config.ts": "webpack",
    "next.config.js": "next", "next.config.mjs": "next", "next.config.ts": "next",
}

# Entry-point candidates per ecosystem, best first, and the manifests that enable an ecosystem.
ENTRY_POINT_CANDIDATES = {
    "js": [
        "src/index.ts", "src/index.js", "src/main.ts", "src/main.js", "index.ts", "index.js", "src/App.tsx",
        "src/App.jsx",
    ],
    "python": ["app.py", "main.py", "manage.py", "src/main.py"],
    "go": ["main.go", "cmd/main.go"],
    "rust": ["src/main.rs", "src/lib.rs"],
}
ECOSYSTEM_MANIFESTS = {
    "js": ["package.json"],
    "python": ["requirements.txt", "setup.py", "pyproject.toml", "Pipfile"],
    "go": ["go.mod"],
    "rust": ["Cargo.toml"],
    "ruby": ["Gemfile"],
    "jvm": ["pom.xml", "build.gradle", "build.gradle.kts"],
}

# Workspace kinds in order of precedence.
WORKSPACE_PRECEDENCE = ["pnpm-workspaces", "npm-workspaces", "lerna", "cargo-workspaces", "go-workspaces"]

# Telemetry size buckets (upper bounds in lines).
SIZE_BUCKETS = [("small", 10_000), ("medium", 100_000)]
