"""Strict reading of model responses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "label string, summary string, snippet string, confidence double, parse_error boolean, schema_error boolean, used_fallback boolean"
_LABEL = re.compile(r'"?contains_painpoint"?\s*[:=]\s*"?([ynu])\b', re.I)


def strip_fence(text: Column) -> Column:
    """Without a leading fence line and the closing one."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.startswith(t, F.lit("```")), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", "")).otherwise(t)


def json_block(text: Column) -> Column:
    """From the first { to the last }, or the text itself."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(block != "", block).otherwise(text)


def clamp_confidence(c: Column) -> Column:
    """Numbers in 0..1 stay; all else, NaN too, is 0."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0), x).otherwise(F.lit(0.0))


def _confidence(x) -> float:
    try:
        x = float(x)
    except (TypeError, ValueError):
        return 0.0
    return x if 0.0 <= x <= 1.0 else 0.0


def _text(x) -> str:
    return x if isinstance(x, str) else "" if x is None else str(x)


def read_response(raw: str | None) -> tuple:
    """The fields of RESULT; unreadable JSON falls back to the only label named in the text."""
    try:
        data = json.loads(raw or "", parse_constant=lambda _: float("nan"))
    except ValueError:
        named = {m.lower() for m in _LABEL.findall(raw or "")}
        return (named.pop() if len(named) == 1 else "u", "", "", 0.0, True, True, True)
    if not isinstance(data, dict):
        return ("u", "", "", 0.0, False, True, False)
    label = _text(data.get("contains_painpoint")).strip().lower()
    wrong = label not in ("y", "n", "u")
    points = data.get("pain_points")
    first = points[0] if isinstance(points, list) and points and isinstance(points[0], dict) else data
    label = "u" if wrong else label
    keep = label == "y"
    return (label, _text(first.get("root_cause_summary")) if keep else "", _text(first.get("pain_point_snippet")) if keep else "", _confidence(data.get("confidence")), False, wrong, False)


def parse_response(text: Column) -> Column:
    """Struct of RESULT: strict JSON after fence and prose are removed natively."""

    @F.pandas_udf(RESULT)
    def parsed(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_response(x) for x in s], columns=[c.split()[0] for c in RESULT.split(", ")])

    return parsed(json_block(strip_fence(text)))
