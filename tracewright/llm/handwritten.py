r"""Files that nobody wrote by hand: generated, minified, vendored, data held as literals.

Copies are found by winnowing. The shown text of a file (signs of the diff, hunk headers and spacing
aside) becomes a stream of lower-case tokens; every K tokens in a row give a hash, and of every WINDOW
hashes in a row the least is kept, so that any two files that share K + WINDOW - 1 tokens in a row share
a fingerprint. A fingerprint that stands in files of OWNERS or more unrelated repositories (by different
owners) recurs; a file of which at least SHARE of the fingerprints recur is a vendored copy. Of a file with
fewer than LEAST fingerprints all have to recur. A stream too short to be sure of a shared fingerprint
(under K + WINDOW - 1 tokens) is a copy if the whole of it stands in OWNERS repositories; under SHORT
tokens (a brace, a return) a stream says nothing. What one patch shows by itself is read beside that: origin
notes and generator notes in comments, places kept for copies and for tool output, numbered boilerplate,
density of text without spaces, literal rows.

Order of kinds where several hold: minified, generated, vendored by note or place, data_blob, vendored by
fingerprint. Binary and image files and running text (.md, .txt) are no case.

Defined cases: a null, empty or placeholder patch leaves the path as the only sign; a null path leaves
the patch; repeated rows count once, for rows as for repositories; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import ensure_checkpoint_dir, spread, table

K, WINDOW, OWNERS, SHARE, LEAST, SHORT = 20, 12, 3, 0.5, 4, 8
#: Prints that are broadcast, at most.
HEAVY = 100_000

_NO_CASE = re.compile(r"\.(png|jpe?g|gif|ico|svg|pdf|webp|bmp|woff2?|ttf|eot|zip|gz|jar|mp[34]|md|rst|txt|adoc)$", re.I)
_MIN_PATH = re.compile(r"\.min\.(js|css|mjs)$|[-.](packed|bundle)\.(js|css)$|(^|/)bundle-[0-9a-f]{6,}\.(js|css)$|(^|/)dist/[^/]+\.(js|css)$", re.I)
_TOOL_PATH = re.compile(
    r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|gemfile\.lock|composer\.lock|go\.sum)$"
    r"|\.snap$|(^|/)__snapshots__/|_pb2(_grpc)?\.pyi?$|\.pb\.(go|cc|h)$|[._](generated|designer|g)\.[a-z]+$|grpc\.java$"
    r"|(^|/)(generated|gen|gen-src|autogen|__generated__)/",
    re.I,
)
_COPY_PATH = re.compile(r"(^|/)(vendor|vendored|_vendor|third_party|third-party|thirdparty|node_modules|bower_components|pods|external|deps|bundled)/[^/]+/", re.I)
_PLAIN = re.compile(r"\.(css|scss|ya?ml|sql)$", re.I)
_COMMENT = r"^[ \t]*(?://+|#+|/\*+|\*|--|<!--|;+|%)[ \t]*"
_TOOL_NOTE = re.compile(
    _COMMENT + r"(?:@generated(?:\s+by|\s*$)|<auto-?generated>|auto-?generated\b(?=.*(?:\bby\b|--|do not|change|edit))|code generated by (?!\{)"
    r"|(?:this (?:file|code) (?:is|was) )?(?:automatically |auto-?)?generated (?:by|from|with|using) |manual changes (?:\w+ )?(?:will|are)\b.*\blost"
    r"|do not (?:edit|modify)|datei automatisch erzeugt|fichier (?:g[ée]n[ée]r[ée])|archivo generado|(?:ficheiro|arquivo) gerado|produced by \S+ from )",
    re.I | re.M,
)
_COPY_NOTE = re.compile(
    _COMMENT + r"(?:vendored (?:from|copy of)|taken unchanged from|copied (?:unchanged |verbatim )?from https?:|this file is part of (?!this\b|the project\b)"
    r"|upstream: |imported from https?:|\S+ v\d[\w.]* \| \(c\) |copyright .*(?:see upstream|upstream copying)|local changes: )",
    re.I | re.M,
)
_NOTE_WORDS = re.compile(r"generat|auto|lost|erzeugt|g[ée]n[ée]r|gerado|do not|produced|vendored|taken|copied|part of|upstream|imported|\(c\)|local changes", re.I)
_COMMENT_LINE = re.compile(_COMMENT + r"[^\s].*$", re.M)
_DIGITS = b"0123456789"
_DENSE = re.compile(r"[A-Za-z0-9+/=]{60}")
_INSIDE = re.compile(r"[A-Za-z_](\d+)")
_PLACEHOLDER = re.compile(r"\s*(\[patch not available\])?\s*", re.I)
_SIGN = re.compile(r"(?m)^(?:@@.*\n?|[+\- ])")
_NUMBERED = re.compile(r"(?<![A-Za-z_])[A-Za-z_]{2,}_?(\d+)(?![\w.]*\()|(?<![A-Za-z])[A-Za-z]{2,}_?(\d+)\b|_(\d+)_")
_ROW = re.compile(
    r"""^\s*(?:
      [\[({]?\s*(?:[-+]?(?:0x[0-9a-f]++|\d[\d.]*+(?:e[-+]?\d++)?)[fl]?(?:\s*+[,;]\s*+|\s++)){3,}+(?:[-+]?(?:0x[0-9a-f]++|\d[\d.]*+(?:e[-+]?\d++)?)[fl]?)?\s*[\])}]?[,;]?   # numbers in a row
    | [\[{(]\s*(?:(?:"[^"]*"|'[^']*'|\w+)\s*[:=]\s*)?(?:"[^"]*"|'[^']*'|[-+]?\d[\w.]*)\s*,.*[\])}],?;?   # a record
    | (?:[^\s;|,(){}=]*+[;|,\t]){3,}+[^;|(){}=]*+                                         # delimited fields
    | .*["'`][A-Za-z0-9+/=\\]{60,}["'`]?.*
    | [+"']?\s*["']?[A-Za-z0-9+/=]{60,}["']?[,;+\\)]*
    )\s*$""",
    re.I | re.X,
)


def shown(patch: str) -> str:
    """The text of a patch without hunk headers and signs."""
    return _SIGN.sub("", patch.replace("\r\n", "\n"))


def _minified(text: str) -> bool:
    widest = max(map(len, text.split("\n")))
    if widest < 150 or len(text) < 200:
        return False
    marks = sum(map(text.count, ";{}(),=:"))
    return text.count(" ") < 0.09 * len(text) and marks > 0.12 * len(text)


def _data(lines: list[str]) -> bool:
    full = [x for x in lines if x.strip()]
    rows = [x for x in full if any(c.isdigit() for c in x) and _ROW.match(x)]
    chars = sum(map(len, rows))
    return chars >= 0.6 * sum(map(len, full)) and (len(rows) >= 3 or chars >= 200)


def _boilerplate(lines: list[str]) -> bool:
    """Most lines are the same few forms with running numbers inside names."""
    full = [x for x in lines if len(x.strip()) > 3]
    if len(full) < 6:
        return False
    named = [m for x in full if (m := _NUMBERED.search(x))]
    forms = {re.sub(r"\d+", "0", m.string.strip()) for m in named}
    numbers = {next(g for g in m.groups() if g) for m in named}
    return len(named) >= 0.45 * len(full) and len(numbers) >= 3 and len(forms) <= 0.7 * len(named)


def kind_of(path: str | None, patch: str | None) -> str | None:
    """What path and patch show by themselves; '-' for a file that can be no case."""
    path = path or ""
    if _NO_CASE.search(path):
        return "-"
    bare = patch is None or _PLACEHOLDER.fullmatch(patch) is not None
    text = "" if bare else shown(patch)
    if _MIN_PATH.search(path) or (text and _minified(text)):
        return "minified"
    notes = [m[0] for m in _COMMENT_LINE.finditer(text) if _NOTE_WORDS.search(m[0])] if text else []
    head = "\n".join(notes)
    if _TOOL_PATH.search(path) or (head and _TOOL_NOTE.search(head)):
        return "generated"
    if _COPY_PATH.search(path) or (head and _COPY_NOTE.search(head)):
        return "vendored"
    if text:
        raw = text.encode("utf-8", "replace")
        digits = (len(raw) - len(raw.translate(None, _DIGITS))) / len(raw)
        lines = text.split("\n")
        if (digits > 0.08 or _DENSE.search(text)) and _data(lines):
            return "data_blob"
        if digits > 0.01 and not _PLAIN.search(path) and len(inside := _INSIDE.findall(text)) >= 0.2 * len(lines) and len(set(inside)) >= 3 and _boilerplate(lines):
            return "generated"
    return None


# Tables for the tokens: 0 spacing, 1 part of a word, 2 a token of its own.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[:33] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P, _Q, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
with np.errstate(over="ignore"):
    _POWER = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(255, _P, dtype=np.uint64))])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


def fingerprints(texts: list[str], k: int = K, window: int = WINDOW) -> list[np.ndarray]:
    """The winnowed fingerprints of each text; one pass of array operations over all of them."""
    return prints_and_wholes(texts, k, window)[0]


def prints_and_wholes(texts: list[str], k: int = K, window: int = WINDOW) -> tuple[list[np.ndarray], list[int | None]]:
    """The fingerprints of each text, and the hash of the whole stream where it has SHORT to k + window - 2 tokens."""
    out = [np.zeros(0, dtype=np.int64)] * len(texts)
    wholes: list[int | None] = [None] * len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    if not len(data):
        return out, wholes
    kind = _CLASS[data]
    first = kind > 0
    first[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
    starts = np.flatnonzero(first)
    if not len(starts):
        return out, wholes
    solid = np.flatnonzero(kind)
    number = np.cumsum(first[solid]) - 1
    offset = solid - starts[number]
    value = (_LOWER[data[solid]].astype(np.uint64) + np.uint64(1)) * _POWER[np.minimum(offset, 255)]
    token = _mix(np.add.reduceat(value, np.flatnonzero(first[solid])))
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(ends, starts, side="right")
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(begin, len(doc)))
    short = (count >= SHORT) & (count < k + window - 1)
    if short.any():
        place = np.minimum(np.arange(len(doc)) - np.repeat(begin, count), len(_POWER) - 1)
        stream = _mix(np.add.reduceat(token * _POWER[place], begin) + count.astype(np.uint64))
        for d, h in zip(doc[begin[short]].tolist(), stream[short].view(np.int64).tolist()):
            wholes[d] = h
    n = len(token) - k + 1
    if n < 1:
        return out, wholes
    gram = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        gram = gram * _Q + token[j : j + n]
    gram, whole = _mix(gram), doc[:n] == doc[k - 1 :]
    gram, doc = gram[whole], doc[:n][whole]
    if not len(gram):
        return out, wholes
    bounds = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    least = gram.copy()
    span = 1
    while span < window:
        step = min(span, window - span)
        if len(least) <= step:
            break
        least = np.minimum(least[:-step], least[step:])
        span += step
    for a, b in zip(bounds[:-1], bounds[1:]):
        kept = least[a : b - window + 1] if b - a >= window else gram[a:b].min(keepdims=True)
        out[doc[a]] = np.unique(kept[np.concatenate([[True], kept[1:] != kept[:-1]])]).view(np.int64)
    return out, wholes


def mark_files(files: DataFrame, file_id: str = "file_id", repo: str = "repo", path: str = "path", patch: str = "patch") -> DataFrame:
    """(file_id, owner, kind, prints, whole) of each row; kind '-' is no case, null is open. One narrow pass."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch.columns = ["file_id", "owner", "path", "patch"]
            kinds = [kind_of(p, t) for p, t in zip(batch["path"], batch["patch"])]
            printed = [shown(t) if k in (None, "vendored") and t else "" for k, t in zip(kinds, batch["patch"])]
            prints, wholes = prints_and_wholes(printed)
            yield pd.DataFrame({"file_id": batch["file_id"], "owner": batch["owner"], "kind": kinds, "prints": prints, "whole": pd.array(wholes, dtype="Int64")})

    rows = files.select(F.col(file_id).alias("file_id"), F.xxhash64(F.substring_index(F.col(repo), "/", 1)).alias("owner"), F.col(path).alias("path"), F.col(patch).alias("patch"))
    return spread(rows, "file_id").mapInPandas(mark, "file_id long, owner long, kind string, prints array<long>, whole long")


def _recurring(prints: DataFrame, owners: int) -> DataFrame:
    """(print, rows) of the prints that stand in files of `owners` owners; added up by owner before anything is shuffled."""
    return prints.groupBy("print", "owner").count().groupBy("print").agg(F.count("*").alias("owners"), F.sum("count").alias("rows")).filter(F.col("owners") >= owners).select("print", "rows")


def _that_recur(rows: DataFrame, prints: DataFrame, owners: int) -> DataFrame:
    """The rows whose print recurs. Prints of total / HEAVY rows or more, no more than HEAVY, are broadcast; so none is hot in the join."""
    recurring = _recurring(prints, owners).checkpoint()
    bar = max(100, prints.count() // HEAVY)
    heavy = F.broadcast(recurring.filter(F.col("rows") >= bar).select("print"))
    light = recurring.filter(F.col("rows") < bar).select("print")
    return rows.join(heavy, "print", "left_semi").unionByName(rows.join(heavy, "print", "left_anti").join(light, "print", "left_semi"))


def find_not_handwritten(files: DataFrame, owners: int = OWNERS, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(file_id, kind) of the files that nobody wrote by hand. Of each file only its fingerprints travel, as numbers."""
    ensure_checkpoint_dir(files.sparkSession)
    marked = mark_files(files).checkpoint()
    prints = marked.select("owner", F.explode("prints").alias("print"))
    open_ = marked.filter("kind IS NULL AND whole IS NULL").select("file_id", F.size("prints").alias("n"), F.explode("prints").alias("print"))
    hits = _that_recur(open_, prints, owners).groupBy("file_id").agg(F.countDistinct("print").alias("hits"), F.max("n").alias("n"))
    enough = F.when(F.col("n") < least, F.col("n")).otherwise(share * F.col("n"))
    copies = hits.filter(F.col("hits") >= enough).select("file_id", F.lit("vendored").alias("kind"))
    whole = marked.filter("whole IS NOT NULL").select("file_id", "owner", "kind", F.col("whole").alias("print"))
    copies = copies.unionByName(_that_recur(whole.filter("kind IS NULL"), whole, owners).select("file_id", F.lit("vendored").alias("kind")))
    rank = F.when(F.col("kind") == "minified", 0).when(F.col("kind") == "generated", 1).when(F.col("kind") == "vendored", 2).otherwise(3)
    own = marked.filter("kind <> '-'").select("file_id", "kind")
    return own.unionByName(copies).groupBy("file_id").agg(F.min_by("kind", rank).alias("kind"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not hand-written, with their kind."""
    return find_not_handwritten(table(spark, sf_dir, "pr_files"))
