"""Model calls behind an interface of pure functions; the offline one answers from its prompt alone."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[str, str], str]
_PROVIDERS: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    """L3."""
    _PROVIDERS[name] = provider


def provider_of(name: str) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return _PROVIDERS[name]


def offline(system: str, user: str) -> str:
    """A JSON answer that depends on the prompt alone; its message is made of the last paragraph, where the change stands."""
    words = user.rsplit("\n\n", 1)[-1].split()
    mark = hashlib.sha256(f"{system}\n{user}".encode()).hexdigest()
    return json.dumps({"message": " ".join(words[:8]) or "empty", "score": int(mark[:2], 16) % 5 + 1, "accept": int(mark[2], 16) % 2 == 0})


def offline_verdict(system: str, user: str) -> str:
    """One of the words that the prompt asks for, by its hash."""
    odd = hashlib.md5(user.encode()).hexdigest()[0] in "02468ace"
    return ("B" if odd else "A") if "A or B" in user else ("YES" if odd else "NO")


def offline_summaries(system: str, user: str) -> str:
    """For a batch a JSON array with the first words of each file's block, for every fourth batch text that is none; for one file an object."""
    lines = [b.split("\n", 1) for b in user.split("\n---\n")]
    told = [{"filename": b[0].removeprefix("File: "), "summary": " ".join(b[-1].split()[:5])} for b in lines]
    if system == "summary":
        return json.dumps({"summary": told[0]["summary"]})
    return "no array" if int(hashlib.md5(user.encode()).hexdigest()[0], 16) % 4 == 0 else json.dumps(told)


register("offline", offline)
register("offline_verdict", offline_verdict)
register("offline_summaries", offline_summaries)


def call(df: DataFrame, system: str, prompt: str, out: str = "answer", provider: str = "offline") -> DataFrame:
    """The answer to each row's prompt; the same for the same prompt, an error gives '' (Q23)."""
    run = provider_of(provider)

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        def one(p: str | None) -> str:
            try:
                return run(system, p or "")
            except Exception:
                return ""

        return prompts.map(one)

    return df.withColumn(out, answer(F.col(prompt)))


def call_log(answered: DataFrame, prompt: str, answer: str) -> DataFrame:
    """K9: one row per call with the first 500 characters of its prompt."""
    return answered.select(F.substring(prompt, 1, 500).alias("prompt_preview"), F.length(prompt).alias("prompt_chars"), F.col(answer).alias("answer"))


def rewrite_prompt(diff: Column, original: Column, demos: Column) -> Column:
    """Rules, demonstrations (struct<message,diff>), then the change."""
    shown = F.array_join(F.transform(demos, lambda d: F.concat(F.lit("Example\n"), d["diff"], F.lit("\nMessage: "), d["message"])), "\n\n")
    return F.concat_ws("\n\n", F.lit("Write one imperative line of 3 to 14 words for the change. Answer as JSON with the key message."), F.nullif(shown, F.lit("")), F.concat(F.lit("Original: "), original), diff)


#: The parts of a judge's prompt in order: title and key of the evidence.
EVIDENCE = (("Commits with diffs", "commits"), ("File summaries with diffs", "file_diffs"), ("Files", "files"), ("Files in all", "meta"), ("Commit messages", "messages"), ("File summaries", "summaries"), ("Linked issues", "issues"))
#: The rubric: caps and steps are fixed values.
RUBRIC = """Judge correctness, coverage and clarity each by itself, by the evidence above alone.
Correctness: 0.5 for each claim that neither a diff nor a linked issue supports, 2.0 at most. That a file is listed proves that it changed, not how.
Coverage: 0.5 for each key change that is missing, 2.0 at most. The five files with most added and deleted lines that are no documents (docs/, .md, .txt, .rst) have to be mentioned; changes of documents may be grouped or left out. Where tests were changed or run a Tests line is needed. With several files or commits at least two have to be covered.
Clarity: 0.5 for each missing section or malformed part, 1.0 at most; style is no fault.
Each bullet of changes, and the summary where code changed, names something of the evidence: a file, symbol, key, literal or flag.
Name a sha or file for each fault of correctness or coverage, and quote the description for each of clarity.
Answer as JSON with correctness_penalty, coverage_penalty, clarity_penalty and the lists correctness_penalties, coverage_penalties, clarity_penalties; no number is negative; no text outside of it."""


def judge_prompt(description: Column, evidence: dict[str, Column]) -> Column:
    """All evidence as JSON by part, the description, the rubric."""
    parts = [F.concat(F.lit(f"{title}:\n"), F.coalesce(F.to_json(evidence[key]), F.lit("[]"))) for title, key in EVIDENCE if key in evidence]
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Description:\n"), F.trim(F.coalesce(description, F.lit("")))), F.lit(RUBRIC))


def is_skipped(text: Column) -> Column:
    """The mark of a call that was left out."""
    return F.coalesce(text.startswith("[LLM skipped:"), F.lit(False))
