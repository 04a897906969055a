"""Verdicts on rewritten messages, and answers that summarise files: prompts and what is read out of the answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import providers
from tracewright.operators.responses import lenient_array

#: Fixed value: characters of a diff that a single verdict sees.
SEEN = 1500


def verdict_prompt(original: Column, candidate: Column, diff: Column, pairwise: bool) -> Column:
    """The two messages with the opening of the diff, and how to answer."""
    ask = "Which message tells the change better, A or B? Answer with one letter." if pairwise else "Is the new message clearly better? Answer YES or NO."
    first, second = ("A: ", "B: ") if pairwise else ("Original: ", "New: ")
    return F.concat_ws("\n\n", F.concat(F.lit("Diff:\n"), F.substring(diff, 1, SEEN)), F.concat(F.lit(first), F.coalesce(original, F.lit(""))), F.concat(F.lit(second), F.coalesce(candidate, F.lit(""))), F.lit(ask))


def read_verdict(answer: Column, pairwise: bool) -> Column:
    """True for the candidate, false against it, null for an answer that is neither."""
    yes, no = ("B", "A") if pairwise else ("Y", "N")
    head = F.upper(F.substring(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+", ""), 1, 1))
    return F.when(head == yes, True).when(head == no, False)


def read_batch(answer: Column, sha: Column, pairwise: bool, enabled: bool = True) -> Column:
    """What a batch's answer, a JSON array by sha, says of one commit: the last entry of it counts; false where it has none.

    With the judge turned off every candidate is accepted.
    """
    if not enabled:
        return F.lit(True)
    rows = lenient_array(answer, "struct<sha:string,accept:boolean,winner:string>")
    own = F.filter(F.coalesce(rows, F.array().cast("array<struct<sha:string,accept:boolean,winner:string>>")), lambda r: r["sha"] == sha)
    last = F.try_element_at(own, F.lit(-1))
    return F.coalesce(last["winner"] == "candidate" if pairwise else last["accept"], F.lit(False))


def summarise_files(files: DataFrame, group: Sequence[str], size: int, provider: str = "offline_summaries") -> DataFrame:
    """Summaries of files in batches of `size` of a group (columns batch, filename, diff); a batch with a malformed answer is asked file by file.

    Adds summary and by ('batch' or 'file'). One answer per batch; an answer is good if it has one summary for each file.
    """
    block = F.concat(F.lit("File: "), "filename", F.lit("\n"), "diff")
    asked = files.groupBy(*group, "batch").agg(F.array_sort(F.collect_list(F.struct("filename", "diff", block.alias("block")))).alias("f"))
    prompt = F.array_join(F.transform("f", lambda x: x["block"]), "\n---\n")
    answered = providers.call(asked.withColumn("prompt", prompt), "summaries", "prompt", provider=provider)
    rows = answered.withColumn("s", lenient_array(F.col("answer"), "struct<filename:string,summary:string>"))
    good = F.coalesce((F.size("s") == F.size("f")) & F.forall("s", lambda x: x["summary"].isNotNull()), F.lit(False))
    each = rows.select(*group, "batch", good.alias("good"), F.explode(F.when(good, F.arrays_zip(F.col("f"), F.col("s"))).otherwise(F.transform("f", lambda x: F.struct(x.alias("f"), F.lit(None).cast("struct<filename:string,summary:string>").alias("s"))))).alias("z"))
    flat = each.select(*group, "batch", "good", F.col("z.f.filename").alias("filename"), F.col("z.f.block").alias("block"), F.col("z.s.summary").alias("summary"))
    alone = providers.call(flat.filter("NOT good"), "summary", "block", provider=provider)
    single = F.coalesce(F.get_json_object("answer", "$.summary"), F.col("answer"))
    columns = [*group, "batch", "filename"]
    return flat.filter("good").select(*columns, "summary", F.lit("batch").alias("by")).unionByName(alone.select(*columns, single.alias("summary"), F.lit("file").alias("by")))
