"""Length profiles and histograms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quantile_profile(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """n, min, max, mean and exact linear quantiles rounded half to even."""
    q = F.expr(f"percentile({value}, array(0.5D, 0.9D, 0.95D, 0.99D))")
    names = ("p50", "p90", "p95", "p99")
    out = df.groupBy(*(group or [])).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), q.alias("q"))
    return out.select(*(group or []), "n", "least", "most", "mean", *[F.bround(F.col("q")[i], 0).cast("bigint").alias(n) for i, n in enumerate(names)])


def histogram(df: DataFrame, value: str, width: int) -> DataFrame:
    """(low, high, n): bins of a fixed width from 0 to the greatest value, empty ones kept."""
    counted = df.where(f"{value} IS NOT NULL").groupBy(F.floor(F.col(value) / width).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = counted.agg(F.max("bin").alias("m")).where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("bin"))
    return spine.join(counted, "bin", "left").select((F.col("bin") * width).alias("low"), (F.col("bin") * width + width - 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def largest_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with the greatest sum, ties kept."""
    sums = df.groupBy(group).agg(F.sum(value).alias("total"))
    return sums.withColumn("rk", F.rank().over(Window.orderBy(F.desc("total")))).where("rk = 1").drop("rk")


#: Fewest and most tokens of a text that is sampled.
BOUNDS = (20, 600)


def length_bounds(profile: str | None) -> tuple[int, int]:
    """Bounds that a profile's JSON gives under ``bounds``; the defaults for what it lacks or where it can't be read."""
    try:
        found = json.loads(profile or "{}").get("bounds", {})
        return int(found.get("min_tokens", BOUNDS[0])), int(found.get("max_tokens", BOUNDS[1]))
    except (ValueError, AttributeError, TypeError):
        return BOUNDS
