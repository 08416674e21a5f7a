"""Filters and predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.codes import code_key

FLAGS = ("is_removed", "is_deleted", "is_promotional")


def structural_filter(posts: DataFrame) -> DataFrame:
    """Posts that are neither deleted, removed nor promotional (null: not) and have any text."""
    keep = F.length(F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit(""))))) > 0
    for flag in FLAGS:
        keep = keep & (F.coalesce(F.col(flag), F.lit(0)) == 0)
    return posts.where(keep)


def code_mentions(text: Column) -> Column:
    """Distinct code-like mentions of a text, normalised: runs of letters and digits, and
    letters and digits with one space or hyphen between.

    One linear scan of the text replaces a pattern for each code: any dictionary then joins
    on equality.
    """
    up = F.upper(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(up, F.lit(r"(?<![A-Z0-9])[A-Z0-9]+(?![A-Z0-9])"), F.lit(0))
    pairs = F.transform(F.regexp_extract_all(up, F.lit(r"(?<![A-Z0-9])[A-Z]+[ -][0-9]+(?![A-Z0-9])"), F.lit(0)), lambda x: F.regexp_replace(x, "[ -]", ""))
    return F.array_distinct(F.concat(runs, pairs))


_PIECES = "[A-Z0-9]+|[^A-Z0-9]"


def signed_mentions(text: Column, lengths: list[int]) -> Column:
    """Distinct stretches of so many pieces, runs of letters and digits or single signs, that begin and end with a run."""
    pieces = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(_PIECES), F.lit(0))
    ends = lambda p: F.array_join(p, "").rlike("^[A-Z0-9].*[A-Z0-9]$")
    cut = lambda n: F.transform(F.when(F.size(pieces) >= n, F.sequence(F.lit(1), F.size(pieces) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(pieces, i, n))
    return F.array_distinct(F.concat(*[F.transform(F.filter(cut(n), ends), lambda p: F.array_join(p, "")) for n in lengths]))


def match_codes(df: DataFrame, key: str, text: Column, codes: DataFrame, code: str, exactly: int | None = 1) -> DataFrame:
    """(key, matched): the sorted distinct dictionary codes in each row's text, of rows with `exactly` so many.

    Spaces and hyphens in codes are left out. Codes with other signs (as ``A.1``), which begin and end with a letter
    or digit, are matched sign by sign; the numbers of pieces they have are asked first.
    """
    known = codes.select(F.regexp_replace(F.upper(code), "[- ]", "").alias("__code")).where(F.length("__code") >= 2).distinct()
    signed = known.where(F.col("__code").rlike("^[A-Z0-9].*[^A-Z0-9].*[A-Z0-9]$"))
    lengths = [r[0] for r in signed.select(F.size(F.regexp_extract_all("__code", F.lit(_PIECES), F.lit(0))).alias("n")).distinct().orderBy("n").collect()]
    mentions = F.array_distinct(F.concat(code_mentions(text), signed_mentions(text, lengths))) if lengths else code_mentions(text)
    hits = df.select(key, F.explode(mentions).alias("__code")).join(known, "__code", "left_semi")
    out = hits.groupBy(key).agg(F.array_sort(F.collect_set("__code")).alias("matched"))
    return out if exactly is None else out.where(F.size("matched") == exactly)


def any_word(text: Column, words: list[str]) -> Column:
    """Any of the words between word boundaries, whatever the case; no words: all rows pass."""
    if not words:
        return F.lit(True)
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)\b(?:{'|'.join(re.sub(r'([^A-Za-z0-9_ ])', r'\\\1', w) for w in words)})\b")


def clamp_confidence(c: Column) -> Column:
    """Into 0..1: above 1 it is 1, below 0, NaN, infinite or not a number it is 0."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0), 0.0).when(x > 1, 1.0).otherwise(x)


def within(value: Column, bounds: tuple[int, int]) -> Column:
    return F.coalesce(value.between(*bounds), F.lit(False))


def below(c: Column, limit: float, inclusive: bool = False) -> Column:
    """Null and NaN never pass."""
    test = (c <= limit) if inclusive else (c < limit)
    return F.coalesce(test & ~F.isnan(c), F.lit(False))


def first_failing(reasons: list[tuple[str, Column]]) -> Column:
    """Name of the first test that fails, or null."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(reasons):
        out = F.when(fails, name).otherwise(out)
    return out


def pain_point_reasons(label: Column, error: Column, cause: Column, snippet: Column) -> Column:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return first_failing([("not_painpoint", F.lower(F.trim(F.coalesce(label, F.lit("")))) != "y"), ("error_flagged", error), ("empty_root_cause", blank(cause)), ("empty_snippet", blank(snippet))])


__all__ = ["any_word", "below", "code_key", "code_mentions", "first_failing", "match_codes", "pain_point_reasons", "structural_filter"]
