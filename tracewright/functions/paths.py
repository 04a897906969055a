"""Predicates over file paths and patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import Text, _c, added_lines, removed_lines

# Fixed values that results depend on.
PATH_KEYWORDS = (
    "api", "auth", "security", "config", "schema", "migration", "migrations", "permission", "permissions", "policy", "acl", "access", "role", "roles",
    "oauth", "jwt", "token", "session", "workflow", "ci", "pipeline", "build", "docker", "k8s", "kubernetes", "deploy", "release",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "gemfile.lock", "go.sum", "cargo.lock", "composer.lock")
BINARY = "png|jpg|jpeg|gif|bmp|svg|ico|pdf|zip|tar|gz|tgz|7z|mp3|mp4|mov|avi|bin|exe|dll|so|dylib"
DUMPS = "csv|tsv|json"
TEST_ENDS = ("_test.py", "_spec.rb", ".test.js", ".spec.js", ".test.ts", ".spec.ts")
CI_ENDS = ("jenkinsfile", ".gitlab-ci.yml", "dockerfile", "docker-compose.yml")
API_WORDS = r"(?i)\b(public|export|class|interface|enum|record|def|function|type|schema)\b"
LANGUAGES = {
    ".py": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go",
    ".rb": "ruby", ".cs": "csharp", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".h": "cpp", ".hpp": "cpp", ".rs": "rust", ".scala": "scala",
}
PUBLIC = {
    "java": r"\bpublic\s+(class|interface|enum|record|void|static|final)\b",
    "kotlin": r"\bpublic\s+(class|interface|object|fun|val|var)\b",
    "javascript": r"\bexport\s+(default|class|function|const|let|var)\b",
    "typescript": r"\bexport\s+(default|class|function|const|let|var|interface|type)\b",
    "python": r"^\s*(def|class)\s+[A-Za-z_][A-Za-z0-9_]*\s*\(",
    "go": r"^\s*(func|type)\s+[A-Z][A-Za-z0-9_]*\b",
    "ruby": r"^\s*def\s+[A-Za-z_][A-Za-z0-9_]*\b",
    "csharp": r"\bpublic\s+(class|interface|struct|enum|void)\b",
    "cpp": r"\b(class|struct|enum)\s+[A-Za-z_][A-Za-z0-9_]*\b",
    "rust": r"\bpub\s+(struct|enum|fn|trait|mod)\b",
    "scala": r"\b(public\s+)?(class|trait|object|def)\b",
}


def normalized(path: Text) -> Column:
    return F.translate(F.lower(F.coalesce(_c(path), F.lit(""))), "\\", "/")


def file_name(path: Text) -> Column:
    return F.regexp_extract(normalized(path), r"([^/]*)$", 1)


def suffix(path: Text) -> Column:
    """The last extension with its dot, in lower case; '' without one."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def has_keyword(path: Text) -> Column:
    """A keyword between '/', '_', '-' or the ends; a dot behind it doesn't count."""
    return normalized(path).rlike(f"(^|/|_|-)({'|'.join(PATH_KEYWORDS)})(/|_|-|$)")


def is_test(path: Text) -> Column:
    """P5: a test directory below the first level, or a test suffix."""
    p = normalized(path)
    return p.rlike("/(tests?|specs?|__tests__)/") | p.rlike(f"({'|'.join(e.replace('.', '[.]') for e in TEST_ENDS)})$")


def is_ci(path: Text) -> Column:
    """P6."""
    p = normalized(path)
    return p.contains("/.github/workflows/") | p.contains("/.circleci/") | p.rlike(f"({'|'.join(e.replace('.', '[.]') for e in CI_ENDS)})$")


def is_noise(path: Text) -> Column:
    """Locks, minified files, binaries, data dumps in data directories, vendored directories."""
    p, name = normalized(path), file_name(path)
    return (
        name.isin(*LOCK_FILES)
        | name.contains(".min.")
        | suffix(path).rlike(f"^[.]({BINARY})$")
        | suffix(path).rlike(f"^[.]({DUMPS})$") & p.rlike("/(data|datasets|fixtures)/")
        | p.rlike("/node_modules/|/.venv/|/.eggs/")
    )


def is_docs(path: Text) -> Column:
    """P8."""
    return suffix(path).isin(".md", ".rst", ".adoc", ".txt")


def language(path: Text) -> Column:
    """Null for an unknown suffix."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix(path)]


def public_symbols(path: Text, lines_: Column) -> Column:
    """Lines that declare a public symbol in the language of the path."""
    lang = language(path)
    matching = lambda pattern: F.size(F.filter(lines_, lambda x: x.rlike(pattern)))
    counts = [F.when(lang == name, matching(pattern)) for name, pattern in PUBLIC.items()]
    return F.coalesce(*counts, F.lit(0))


def api_impact(patch: Text) -> Column:
    """Any changed line holds a declaring word."""
    both = F.concat(added_lines(patch), removed_lines(patch))
    return F.exists(both, lambda x: x.rlike(API_WORDS))


def missing_reason(path: Text, patch: Text) -> Column:
    """Why a file gives no evidence; null for one that does. Noise is named first."""
    t = F.trim(F.lower(F.coalesce(_c(patch), F.lit(""))))
    return F.when(is_noise(path), "noise_excluded").when((t == "") | (t == "[patch not available]"), "patch_missing")
