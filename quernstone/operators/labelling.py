"""Labelling that can be broken off and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources import storage
from quernstone.sources.files import nonblank_ids


def remaining(candidates: DataFrame, labels: DataFrame, key: str = "post_id") -> DataFrame:
    """Candidates with an id that have no label yet, once each."""
    return nonblank_ids(candidates, key).dropDuplicates([key]).join(labels.select(key).distinct(), key, "left_anti")


def label_all(candidates: DataFrame, path: str, label: Callable[[DataFrame], DataFrame], key: str = "post_id", parts: int = 16) -> int:
    """Labels what is not labelled in ``path`` yet, part by part, each written before the next begins; returns how many.

    A part is a share of the keys by hash, so a run that is broken off loses one part at most,
    and the next run skips whatever is there.
    """
    spark, done = candidates.sparkSession, 0
    for part in range(parts):
        rest = candidates.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        if storage.exists(spark, path):
            rest = remaining(rest, spark.read.parquet(path), key)
        else:
            rest = nonblank_ids(rest, key).dropDuplicates([key])
        from pyspark.sql import Observation

        seen = Observation()
        label(rest).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
        done += seen.get["n"]
    return done
