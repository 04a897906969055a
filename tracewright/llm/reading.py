r"""Reading level of English documents, by a pairwise ranker with calibrated scores.

The running prose of a document is what is left without code, logs, tables, headings and markup. Its
sentences and words give syntax and vocabulary features. A linear ranker learns from pairs of graded passages
(module graded: their school years were set by hand when they were written, so no grade is a function of the
features) which of two is harder; pairs that lie less than PAIR_GAP years apart are left out. Isotonic
regression turns scores into school years, which give the band.

Nothing is fitted on the corpus: a document is read once, and its level does not depend on the others.

Defined cases: null, empty and short texts, texts mainly in another language and texts with less than
80 words of prose get no level; the column lang isn't trusted; repeated rows count once; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.graded import PASSAGES
from tracewright.session import spread, table

LEAST_WORDS, PAIR_GAP = 80, 1.0
#: The end of school year 6 and of year 12.
BASIC, INTERMEDIATE = 7.0, 13.0
FEATURES = ["words_per_sentence", "syllables_per_word", "letters_per_word", "long_share", "rare_share", "hard_share", "clauses_per_sentence", "commas_per_sentence", "log_longest"]

_FENCE = re.compile(r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)")
_TAG = re.compile(r"<[^<>\n]{1,200}>|&[a-z]{2,6};|`[^`\n]*`|https?://\S+|!?\[([^\]\n]*)\]\([^)\n]*\)")
_LEAD = re.compile(r"^\s*(?:>\s?)*(?:[-*+•]\s+(?:\[[ xX]\]\s+)?|\d+[.)]\s+)?")
_NOT_PROSE = re.compile(
    r"^\s{0,3}#{1,6}\s|^\s*\||^\s*[-=*_]{3,}\s*$|^(?: {4}|\t)\s*(?![-*+•\d])\S|[{};]\s*$|^\s*(?:def|class|return|import|from|if|for|while|try|except|elif|else|func|var|let|const|public|private|static|type|package|export|await|raise|throw|assert|defer|log\.|console\.|self\.|this\.)\b.*[(){}=:;\[\]]\S*\s*$"
    r"|^\s*(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|\[?\d{4}[-/]\d\d)|^\s*(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b|^\s*(?:File \"|at \S+\(|Traceback|\w+(?:Error|Exception)\b:?)|^\s*(?:[+\-]{1,3}|@@)\s?\S*[(){}=;]|^\s*\$\s|^[\w-]+:\s*\S*$|==|=>|->|\(\)|::|^\s*\*\*[^*]+\*\*:?\s*$|^[^:]{0,40}:\s*$"
)
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_WORD = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
_GROUPS = re.compile(r"[aeiouy]+")
_CLAUSES = frozenset("although because since unless whereas while if when which that who whose whom where whenever whether insofar inasmuch though until provided given considering".split())
#: Frequent words of other languages, and of English, to find the main language of the prose.
_ENGLISH = frozenset("the a an and of to in is it that with for on this by be which each any so also now used when if we not before after from as every has or are was its my our one will can no at".split())
_OTHER = frozenset(
    "der die das und ist nicht mit für auf ein eine wird den dem des zu im bei nach weil ohne el los las y es con para en un una del por que se la le les et est ne pas avec dans du au aux ce cette o os as é não em um uma do da dos das no na w i z nie się jest że dla po przy och att det som het een van".split()
)
_SYLLABLES: dict[str, int] = {}


def syllables(word: str) -> int:
    """Groups of vowels, without a silent e at the end; one at least."""
    n = _SYLLABLES.get(word)
    if n is None:
        w = word.lower()
        n = len(_GROUPS.findall(w))
        if w.endswith("e") and not w.endswith(("le", "ee")) or w.endswith("ed") and not w.endswith(("ted", "ded")) or w.endswith("es") and not w.endswith(("ses", "zes", "ches", "shes", "xes", "ges", "ces")):
            n -= 1
        n = max(1, n)
        if len(_SYLLABLES) < 200_000:
            _SYLLABLES[word] = n
    return n


def prose(text: str) -> list[str]:
    """The sentences of running prose; each item of a list counts as one or more."""
    text = _FENCE.sub("\n\n", text.replace("\r\n", "\n"))
    if "<" in text or "&" in text or "`" in text or "://" in text or "](" in text:
        text = _TAG.sub(lambda m: m[1] or " ", text)
    blocks, open_ = [], False
    for line in text.split("\n"):
        bare = _LEAD.sub("", line)
        if not bare.strip() or _NOT_PROSE.search(line):
            open_ = False
            continue
        if open_ and len(bare) == len(line) and bare[:1].islower():
            blocks[-1] += " " + bare.strip()
        else:
            blocks.append(bare.strip())
        open_ = bare.rstrip()[-1] not in ".!?:;"
    return [s for b in blocks for s in _END.split(b) if s.count(" ") >= 3]


def measures(text: str | None, least: int = LEAST_WORDS) -> list[float] | None:
    """The features; None without `least` words of prose mainly in English."""
    if not text or len(text) < 4 * least:
        return None
    found = [(w, s) for s in prose(text) if len(w := _WORD.findall(s)) >= 3]
    words = [x for w, _ in found for x in w]
    n = len(words)
    if n < least:
        return None
    low = [x.lower() for x in words]
    english, other = sum(map(_ENGLISH.__contains__, low)), sum(map(_OTHER.__contains__, low))
    letters = sum(map(len, words))
    foreign = sum(1 for _, s in found for c in s if ord(c) > 191)
    if other > english or english < 0.04 * n or foreign > 0.12 * letters:
        return None
    sizes = np.fromiter(map(len, words), dtype=float, count=n)
    parts = np.fromiter(map(syllables, low), dtype=float, count=n)
    count = len(found)
    per = n / count
    syllable, letter, hard = parts.mean(), sizes.mean(), (parts >= 3).mean()
    clauses = sum(map(_CLAUSES.__contains__, low)) / count
    commas = sum(s.count(",") + s.count(";") for _, s in found) / count
    longest = max(len(w) for w, _ in found)
    return [per, syllable, letter, (sizes >= 7).mean(), (sizes >= 10).mean(), hard, clauses, commas, float(np.log(longest))]


@dataclass
class Levels:
    """A linear score and the isotonic steps from scores to school years."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    years: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.score(x), self.at, self.years)


def isotonic(y: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v in y:
        pools.append([float(v), 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, n2 = pools.pop()
            v1, n1 = pools[-1]
            pools[-1] = [(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, n in pools]) if pools else y


def graded_rows(passages: Sequence[tuple[float, str]] = PASSAGES, parts: int = 6, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and years of the passages and of drawn halves of their sentences."""
    rng = np.random.default_rng(seed)
    rows, years = [], []
    for year, text in passages:
        sentences = _END.split(text)
        half = max(1, len(sentences) // 2)
        for k in range(parts + 1):
            some = sentences if k == 0 else [sentences[i] for i in sorted(rng.choice(len(sentences), half, replace=False))]
            if (m := measures(" ".join(some), 15)) is not None:
                rows.append(m)
                years.append(year)
    return np.array(rows), np.array(years)


def fit_levels(x: np.ndarray, grade: np.ndarray, rounds: int = 300, ridge: float = 0.01) -> Levels:
    """Logistic loss on differences of features of graded pairs, with a ridge; then calibration."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    a, b = np.triu_indices(len(z), 1)
    far = np.abs(grade[a] - grade[b]) >= PAIR_GAP
    a, b = a[far], b[far]
    weights = np.zeros(z.shape[1])
    if len(a):
        d = (z[a] - z[b]) * np.sign(grade[a] - grade[b])[:, None]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
            weights += 0.5 * (d.T @ p / len(d) - ridge * weights)
    score = z @ weights
    order = np.argsort(score, kind="stable")
    return Levels(mean, scale, weights, score[order], isotonic(grade[order]))


@functools.cache
def fitted_levels() -> Levels:
    return fit_levels(*graded_rows())


def band(years: float) -> str:
    return "basic" if years < BASIC else "intermediate" if years < INTERMEDIATE else "advanced"


def reading_levels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, years, band) of each document that can have a level; one narrow pass, then a distinct of short rows."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted_levels())

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, m) for d, t in zip(batch["doc_id"], batch["text"]) if (m := measures(t)) is not None]
            if rows:
                years = sent.value.grade(np.array([m for _, m in rows]))
                yield pd.DataFrame({"doc_id": [d for d, _ in rows], "years": years, "band": list(map(band, years))})

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") >= 4 * LEAST_WORDS)
    return spread(texts, "doc_id").mapInPandas(grade, "doc_id long, years double, band string").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of each document with enough English prose."""
    return reading_levels(table(spark, sf_dir, "documents")).select("doc_id", "band").distinct()
