"""Deterministic samples and splits: digests stand in for a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def digest_order(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key)))


def round_robin(df: DataFrame, key: str, strata: list[str], target: int, seed: str, focus: Column | None = None) -> DataFrame:
    """A sample that takes one row of each stratum in turn; focus rows are always kept."""
    focus = F.coalesce(focus, F.lit(False)) if focus is not None else F.lit(False)
    kept = df.where(focus)
    rest = df.where(~focus).withColumn("__round", F.row_number().over(Window.partitionBy(*strata).orderBy(digest_order(seed, key), key)))
    room = max(0, target - kept.count())
    return kept.unionByName(rest.orderBy("__round", *strata, key).limit(room).drop("__round"))


def split_by_share(df: DataFrame, key: str, strata: list[str], share: float, seed: str) -> DataFrame:
    """(…, part): of each stratum the first clamp(round_half_even(share n), 1, n - 1) by digest are DEV, the rest TEST."""
    w = Window.partitionBy(*strata)
    n = F.count(F.lit(1)).over(w)
    dev = F.greatest(F.lit(1), F.least(F.bround(n * share, 0), n - 1))
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(digest_order(seed, key), key))).withColumn("__dev", dev)
    return ranked.withColumn("part", F.when(F.col("__rn") <= F.col("__dev"), "DEV").otherwise("TEST")).drop("__rn", "__dev")
