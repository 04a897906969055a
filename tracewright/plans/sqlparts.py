"""Fragments of the SQL that checks the queries."""

from __future__ import annotations

from tracewright.functions import paths as P
from tracewright.functions import text as T


def q(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def lines(x: str) -> str:
    return rf"(CASE WHEN COALESCE({x}, '') = '' THEN CAST([] AS VARCHAR[]) ELSE STRING_SPLIT(REGEXP_REPLACE(REGEXP_REPLACE({x}, '\r\n?', CHR(10), 'g'), '\n\z', ''), CHR(10)) END)"


_HEAD = "(STARTS_WITH(x, 'diff --git') OR STARTS_WITH(x, '@@') OR STARTS_WITH(x, '+++') OR STARTS_WITH(x, '---'))"


def changed(x: str, sign: str) -> str:
    """Text of added or removed lines."""
    return f"[SUBSTR(x, 2) FOR x IN {lines(x)} IF NOT {_HEAD} AND STARTS_WITH(x, '{sign}')]"


def both(x: str) -> str:
    return f"[SUBSTR(x, 2) FOR x IN {lines(x)} IF NOT {_HEAD} AND (STARTS_WITH(x, '+') OR STARTS_WITH(x, '-'))]"


def code_tokens(x: str) -> str:
    return rf"[t FOR t IN REGEXP_SPLIT_TO_ARRAY(LOWER(COALESCE({x}, '')), '[^\p{{L}}\p{{N}}_./#:+-]+') IF t <> '']"


def word_tokens(x: str) -> str:
    return f"REGEXP_EXTRACT_ALL(LOWER(COALESCE({x}, '')), '[a-z0-9_]+')"


def trimmed(x: str) -> str:
    return rf"REGEXP_REPLACE(COALESCE({x}, ''), '^\s+|\s+$', '', 'g')"


def path(x: str) -> str:
    return f"REPLACE(LOWER(COALESCE({x}, '')), '\\', '/')"


def name(x: str) -> str:
    return f"REGEXP_EXTRACT({path(x)}, '([^/]*)$', 1)"


def suffix(x: str) -> str:
    return f"REGEXP_EXTRACT({name(x)}, '^.+([.][^.]+)$', 1)"


def has_keyword(x: str) -> str:
    return f"REGEXP_MATCHES({path(x)}, '(^|/|_|-)({'|'.join(P.PATH_KEYWORDS)})(/|_|-|$)')"


def is_test(x: str) -> str:
    return f"(REGEXP_MATCHES({path(x)}, '/(tests?|specs?|__tests__)/') OR REGEXP_MATCHES({path(x)}, '({'|'.join(e.replace('.', '[.]') for e in P.TEST_ENDS)})$'))"


def is_ci(x: str) -> str:
    return f"(CONTAINS({path(x)}, '/.github/workflows/') OR CONTAINS({path(x)}, '/.circleci/') OR REGEXP_MATCHES({path(x)}, '({'|'.join(e.replace('.', '[.]') for e in P.CI_ENDS)})$'))"


def is_noise(x: str) -> str:
    return (
        f"({name(x)} IN ({q(P.LOCK_FILES)}) OR CONTAINS({name(x)}, '.min.') OR REGEXP_MATCHES({suffix(x)}, '^[.]({P.BINARY})$')"
        f" OR (REGEXP_MATCHES({suffix(x)}, '^[.]({P.DUMPS})$') AND REGEXP_MATCHES({path(x)}, '/(data|datasets|fixtures)/')) OR REGEXP_MATCHES({path(x)}, '/node_modules/|/.venv/|/.eggs/'))"
    )


def is_docs(x: str) -> str:
    return f"({suffix(x)} IN ('.md', '.rst', '.adoc', '.txt'))"


def language(x: str) -> str:
    return f"CASE {suffix(x)} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END"


def api_impact(x: str) -> str:
    return f"(LEN([y FOR y IN {both(x)} IF REGEXP_MATCHES(y, '{P.API_WORDS}')]) > 0)"


def missing_reason(p: str, t: str) -> str:
    return f"CASE WHEN {is_noise(p)} THEN 'noise_excluded' WHEN TRIM(LOWER(COALESCE({t}, ''))) IN ('', '[patch not available]') THEN 'patch_missing' END"


def file_score() -> str:
    """Over columns path, patch, changes, status."""
    return (
        f"(0.4::DOUBLE * LN(1 + GREATEST(0.0::DOUBLE, COALESCE(CAST(changes AS DOUBLE), 0))) + CASE WHEN {has_keyword('path')} THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN {api_impact('patch')} THEN 2.0::DOUBLE ELSE 0 END"
        f" + CASE WHEN {is_test('path')} THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN {is_ci('path')} THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN LOWER(COALESCE(status, '')) IN ('added', 'new') THEN 0.3::DOUBLE ELSE 0 END"
        f" + CASE WHEN LOWER(COALESCE(status, '')) IN ('removed', 'deleted') THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN {is_noise('path')} THEN 1.5::DOUBLE ELSE 0 END)"
    )


def imperative(x: str) -> str:
    first = f"({code_tokens(f'SUBSTR(COALESCE({x}, {chr(39) * 2}), 1, 40)')})[1]"
    return f"CASE WHEN {first} IS NULL OR REGEXP_MATCHES({first}, '(ed|ing)$') THEN 0.0::DOUBLE WHEN {first} IN ({q(T.START_VERBS)}) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"


def weak(x: str) -> str:
    return f"REGEXP_MATCHES(LOWER({x}), '{'|'.join(T.WEAK_WORDS)}')"


def merge(x: str) -> str:
    return rf"COALESCE(REGEXP_MATCHES({x}, '(?i)^\s*(merge|revert)\b'), FALSE)"


def good(t: str) -> str:
    """Over a trimmed message."""
    n = f"LEN({code_tokens(t)})"
    return f"({t} <> '' AND NOT {merge(t)} AND NOT {weak(t)} AND LENGTH({t}) BETWEEN 8 AND 100 AND {n} BETWEEN 3 AND 14 AND {imperative(t)} > 0)"


ISSUES = rf"REGEXP_EXTRACT_ALL(COALESCE(message, ''), '{T.ISSUE_REF}')"


def ident(x: str) -> str:
    return rf"REGEXP_MATCHES({x}, '[/\\._]|\d')"
