"""Text functions as Column expressions; no Python is involved (array functions run outside generated code, all else inside). Null in, null out, unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
WEAK_WORDS = ("wip", "tmp", "fix", "update", "misc", "minor", "changes", "stuff")
START_VERBS = (
    "add", "fix", "update", "refactor", "remove", "rename", "revert", "improve", "optimize", "document", "bump", "implement", "enable", "disable",
    "handle", "support", "streamline", "migrate", "correct", "clean", "extract",
)
ANCHOR_STOP = (
    "add", "adds", "added", "fix", "fixes", "fixed", "update", "updates", "updated", "refactor", "remove", "removed", "rename", "renamed", "revert", "improve",
    "optimize", "document", "bump", "implement", "enable", "disable", "handle", "support", "streamline", "migrate", "correct", "clean", "extract",
    "change", "changes", "adjust", "tweak", "misc",
)
ISSUE_REF = r"(?:\b[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#\d+\b|#\d+)"
IDENTIFIER = r"[/\\._]|\d"
THEMES = {
    "clarity_readability": ("clear", "clearly", "easy to read", "understand", "understandable", "readable", "comprehension"),
    "conciseness": ("concise", "short", "to the point", "brief", "without unnecessary", "not wordy"),
    "completeness_coverage": ("complete", "comprehensive", "covers", "everything", "full change", "scope", "impact"),
    "structure_organization": ("structured", "well-structured", "organized", "format", "section"),
    "specificity_concrete": ("specific", "exactly", "details", "concrete", "affected", "what changed", "why"),
    "implementation_noise_negative": ("word vomit", "too much", "low-level", "implementation detail", "excessive detail"),
    "commit_hash_negative": ("commit hash", "commit hashes", "sha", "metadata", "digging"),
}
GENERIC_REASONS = ("no", "descriptive", "clear description", "understandable", "clean description", "clearly designed", "clearly described")

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def code_tokens(text: Text) -> Column:
    """Lower-case tokens of letters, digits and ._/#:+- ; empty for null or empty text."""
    parts = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}_./#:+-]+")
    return F.filter(parts, lambda t: t != "")


def word_tokens(text: Text) -> Column:
    """Lower-case runs of ASCII letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("([a-z0-9_]+)"), 1)


def expand_dotted(tokens: Text) -> Column:
    """A token is split at the first of '.', '#', '::' that it holds."""

    def parts(t: Column) -> Column:
        mark = F.when(F.contains(t, F.lit(".")), F.split(t, r"\.")).when(F.contains(t, F.lit("#")), F.split(t, "#")).when(F.contains(t, F.lit("::")), F.split(t, "::")).otherwise(F.array(t))
        return F.filter(mark, lambda x: x != "")

    return F.flatten(F.transform(_c(tokens), parts))


def ngrams(tokens: Text, n: int) -> Column:
    """T4: the n-grams in order, joined by one space; empty if there are too few tokens."""
    t = _c(tokens)
    return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " ")))


def issue_refs(text: Text) -> Column:
    """References in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"({ISSUE_REF})"), 1))


def slug(text: Text, default: str = "mode") -> Column:
    """T8."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def lines(text: Text) -> Column:
    """Lines without their ends and without an empty one after the last end."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "\r\n?", "\n"), r"\n\z", "")
    return F.when(F.coalesce(_c(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n"))


def _is_header(line: Column) -> Column:
    return line.startswith("diff --git") | line.startswith("@@") | line.startswith("+++") | line.startswith("---")


def changed_lines(text: Text) -> Column:
    """Added and removed lines with their sign."""
    return F.filter(lines(text), lambda x: ~_is_header(x) & (x.startswith("+") | x.startswith("-")))


def added_lines(text: Text) -> Column:
    """Text of the added lines."""
    return F.transform(F.filter(lines(text), lambda x: ~_is_header(x) & x.startswith("+")), lambda x: F.substr(x, F.lit(2)))


def removed_lines(text: Text) -> Column:
    """Text of the removed lines."""
    return F.transform(F.filter(lines(text), lambda x: ~_is_header(x) & x.startswith("-")), lambda x: F.substr(x, F.lit(2)))


def clean_patch(text: Text, max_lines: int | None = None) -> Column:
    """Without git's file headers, trailing space and blank lines."""
    kept = F.filter(lines(text), lambda x: ~x.rlike("^(diff --git a/.* b/.*|index .*|--- a/.*|\\+\\+\\+ b/.*)$") & (F.trim(F.regexp_replace(x, r"\s", "")) != ""))
    short = F.transform(kept, lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.array_join(F.slice(short, 1, max_lines) if max_lines is not None else short, "\n")


def combine_patches(patches: Text, max_lines: int | None = None) -> Column:
    """The cleaned patches of a commit, one after the other, capped again."""
    each = F.filter(F.transform(F.coalesce(_c(patches), F.array()), lambda p: clean_patch(p["patch"], max_lines)), lambda x: F.coalesce(x, F.lit("")) != "")
    text = F.array_join(each, "\n")
    return F.array_join(F.slice(F.split(text, "\n"), 1, max_lines), "\n") if max_lines is not None else text


def render_diff(patches: Text, limit: int = 40_000) -> Column:
    """Lines of a commit's patches marked by what they are."""

    def marked(p: Column) -> Column:
        body = F.filter(lines(p["patch"]), lambda x: ~_is_header(x) & (x.startswith(" ") | x.startswith("+") | x.startswith("-")))
        out = F.transform(body, lambda x: F.concat(F.when(x.startswith(" "), "<CTX> ").when(x.startswith("+"), "<ADD> ").otherwise("<DEL> "), F.substr(x, F.lit(2))))
        head = F.when(F.coalesce(p["filename"], F.lit("")) != "", F.array(F.concat(F.lit("<FILE> "), p["filename"]))).otherwise(F.array().cast("array<string>"))
        return F.concat(head, out)

    return F.substring(F.array_join(F.flatten(F.transform(F.coalesce(_c(patches), F.array()), marked)), "\n"), 1, limit)


def patch_tokens(patches: Text) -> Column:
    """Tokens of the changed lines of a commit, signs left out."""
    changed = F.flatten(F.transform(F.coalesce(_c(patches), F.array()), lambda p: F.transform(changed_lines(p["patch"]), lambda x: F.substr(x, F.lit(2)))))
    return code_tokens(F.array_join(changed, " "))


def imperative_score(text: Text) -> Column:
    """1 for a listed verb, 0 for an -ed or -ing form or nothing, else a half; first token of 40 characters."""
    first = F.get(code_tokens(F.substring(F.coalesce(_c(text), F.lit("")), 1, 40)), F.lit(0))
    return F.when(first.isNull() | first.rlike("(ed|ing)$"), 0.0).when(first.isin(*START_VERBS), 1.0).otherwise(0.5)


def is_merge_or_revert(text: Text) -> Column:
    """P11."""
    return F.coalesce(_c(text).rlike(r"(?i)^\s*(merge|revert)\b"), F.lit(False))


def has_weak_word(text: Text) -> Column:
    """A weak word anywhere, inside other words too."""
    return F.coalesce(F.lower(_c(text)).rlike("|".join(WEAK_WORDS)), F.lit(False))


def is_good_message(text: Text) -> Column:
    """P12."""
    t = trimmed(text)
    n = F.size(code_tokens(t))
    return (t != "") & ~is_merge_or_revert(t) & ~has_weak_word(t) & F.length(t).between(8, 100) & n.between(3, 14) & (imperative_score(t) > 0)


def needs_rewrite(text: Text) -> Column:
    """P13."""
    return ~is_merge_or_revert(text) & ~is_good_message(text)


def trimmed(text: Text) -> Column:
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"^\s+|\s+$", "")


def identifiers(tokens: Text) -> Column:
    """Distinct tokens with a path mark, underscore or digit; tokens are lower case, so no camel form is left."""
    return F.array_distinct(F.filter(_c(tokens), lambda t: t.rlike(IDENTIFIER)))


def length_score(n: Text) -> Column:
    """1 at 50 characters, 0 from 100 on."""
    return F.greatest(F.lit(0.0), 1.0 - F.abs(_c(n) - 50) / 50.0)


def specificity_score(text: Text) -> Column:
    """Share of code-like tokens, of three at least."""
    t = code_tokens(text)
    return F.when(F.size(t) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(F.filter(t, lambda x: x.rlike(IDENTIFIER))) / F.greatest(F.lit(3), F.size(t))))


def anchors(diff: Text, most: int = 5) -> Column:
    """The first distinct identifiers of added lines, in lower case; distinct before lowering."""
    plus = F.filter(lines(diff), lambda x: x.startswith("+"))
    found = F.flatten(F.transform(plus, lambda x: F.regexp_extract_all(x, F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), 1)))
    kept = F.array_distinct(F.filter(found, lambda t: ~F.lower(t).isin(*ANCHOR_STOP)))
    return F.transform(F.slice(kept, 1, most), lambda t: F.lower(t))


def anchor_terms(text: Text) -> Column:
    """Tokens in camel form, with digits or underscores, or shaped like a path."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit("([A-Za-z_][A-Za-z0-9_./-]{2,})"), 1)
    return F.filter(found, lambda t: t.rlike("[a-z][A-Z]|[0-9_]|/"))


def clean_message_line(text: Text) -> Column:
    """Without preamble and bullets; '#' as '.'; the first line; no dot at the end."""
    s = F.regexp_replace(trimmed(text), r"(?i)^here\s+is[^:]*:\s*", "")
    s = F.translate(F.regexp_replace(s, r"^[#>*\-\s]+", ""), "#", ".")
    s = F.get(F.split(s, "\r\n|\r|\n"), F.lit(0))
    return F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\.+$", "")


def clean_markdown(text: Text) -> Column:
    """Without an outer fence, bullets, heading marks and emphasis; lines stripped."""
    inner = trimmed(F.regexp_replace(trimmed(F.regexp_replace(trimmed(text), r"\A```\w*\n?", "")), r"\n?```\z", ""))
    rules = ((r"^\s*[-*•+]\s*", ""), (r"^#+\s*", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"^\s+|\s+$", ""))

    def bare(x: Column) -> Column:
        for pattern, to in rules:
            x = F.regexp_replace(x, pattern, to)
        return x

    return trimmed(F.array_join(F.transform(lines(inner), bare), "\n"))


def normalize_summary(text: Text) -> Column:
    """T23."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[`'\"]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", " "), " +", " "))


def themes(text: Text) -> Column:
    """All themes of which a keyword occurs."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    marks = F.array(*[F.when(t.rlike("|".join(words)), F.lit(name)) for name, words in THEMES.items()])
    return F.filter(marks, lambda x: x.isNotNull())


def penalty_category(reason: Text) -> Column:
    """The first rule that holds."""
    t = F.lower(F.coalesce(_c(reason), F.lit("")))
    return (
        F.when(t.rlike("linked issues?"), "linked_issue_mismatch")
        .when(t.contains("tests section") | t.contains("tests") & t.rlike("does not include|omits|missing|not include"), "missing_test_coverage")
        .when(t.rlike("unsupported claim|incorrect|inconsistent|mismatched|appears to preexist|not supported"), "unsupported_specifics")
        .when(t.rlike("missing mention|does not mention|omits|missing coverage|not mentioned|top-changed file not mentioned"), "missing_key_changes")
        .when(t.rlike("format|structure|json|section header"), "format_structure")
        .otherwise("other")
    )


def dataset_of_file(name: Text) -> Column:
    """T26."""
    n = F.lower(_c(name))
    return F.when(n.contains("aidev"), "aidev").when(n.contains("parsed") | n.contains("trudeau"), "prsummarizer").otherwise("unknown")


def parse_rank(text: Text) -> Column:
    """A leading digit of 1 to 5."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"^\s*([1-5])", 1), F.lit("")), F.lit("9")).cast("int")


def token_estimate(text: Text, per: int = 4) -> Column:
    """T31."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(_c(text), F.lit(""))) / per).cast("int"))
