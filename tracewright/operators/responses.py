"""Answers of models as columns: strict and lenient JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_object(text: Column, schema: str) -> Column:
    """The object, or null fields for anything else."""
    return F.from_json(F.when(F.ltrim(text).startswith("{"), text), schema)


def lenient_object(text: Column, schema: str) -> Column:
    """The text itself, else from its first '{' to its last '}'."""
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.from_json(F.when(F.ltrim(text).startswith("{"), text), schema, {"mode": "PERMISSIVE"}), F.from_json(braced, schema))


def lenient_array(text: Column, element: str) -> Column:
    """A bare array, an object with key results, or what stands between the first '[' and the last ']'."""
    bracket = F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))
    return F.coalesce(F.from_json(F.when(F.ltrim(text).startswith("["), text), f"array<{element}>"), F.from_json(F.when(F.ltrim(text).startswith("{"), text), f"results array<{element}>")["results"], F.from_json(bracket, f"array<{element}>"))


def _repaired(text: str) -> str:
    """Line ends inside quoted strings written as escapes."""
    return re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: m[0].replace("\r", "").replace("\n", "\\n"), text, flags=re.S)


def _stages(raw: str) -> str:
    fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S)
    a, b = raw.find("{"), raw.rfind("}")
    for candidate in (raw, fenced[1] if fenced else None, raw[a : b + 1] if 0 <= a < b else None):
        for text in (candidate, _repaired(candidate)) if candidate else ():
            try:
                got = json.loads(text)
            except ValueError:
                continue
            if isinstance(got, dict):
                return json.dumps(got, ensure_ascii=False)
    return json.dumps({"pr_description": raw.strip()}, ensure_ascii=False)


def parse_response(text: Column) -> Column:
    """A JSON object in four stages: as it is, fenced, braced, each also with repaired line ends; else the whole as description."""

    @F.pandas_udf("string")
    def parse(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else _stages(x))

    return parse(text)
