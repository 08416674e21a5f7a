"""Text expressions: assembly, tokens, buckets, previews, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = (("short", 20, 149), ("medium", 150, 299), ("long", 300, 600))


def strip(c: Column) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def assemble(title: Column, body: Column) -> Column:
    """Title and body with a blank line between, or the one that is not empty."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    return F.when(b == "", t).when(t == "", b).otherwise(F.concat(t, F.lit("\n\n"), b))


def assemble_stripped(title: Column, body: Column, between: str = "\n\n") -> Column:
    return strip(F.concat(strip(title), F.lit(between), strip(body)))


def token_count(text: Column) -> Column:
    """A quarter of the code points, rounded up; empty and null have none."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("bigint")


def length_bucket(tokens: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in BUCKETS:
        out = F.when(tokens.between(low, high), name).otherwise(out)
    return out


def preview(text: Column, n: int) -> Column:
    """Links removed, white space collapsed, cut to n characters of which the last is an ellipsis."""
    plain = strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://[^ \t\n\f\r]+", ""), r"[ \t\n\f\r]+", " "))
    return F.when(F.length(plain) > n, F.concat(F.substring(plain, 1, n - 1), F.lit("…"))).otherwise(plain)


def epoch_date(seconds: Column) -> Column:
    """YYYY-MM-DD in UTC; null, NaN and values up to 0 give an empty string."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (seconds > 0)
    return F.when(ok, F.date_format(F.timestamp_seconds(F.when(ok, seconds)), "yyyy-MM-dd")).otherwise(F.lit(""))


def truthy(c: Column, words: tuple[str, ...] = ("true", "1", "y", "yes")) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*words)


def render(template: str, **values: Column) -> Column:
    """Literal {placeholders} of a template replaced one after the other."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def split_multi(c: Column) -> Column:
    """Parts of a ;-separated value, trimmed, blank ones dropped; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
