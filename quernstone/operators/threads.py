"""Comment threads: trees of bounded depth and width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.rows import cap_children


def thread(comments: DataFrame, key: str, parent: str, root: Column, order: list[Column], depth: int = 2, width: int = 3) -> DataFrame:
    """Comments kept with their level: at most ``width`` replies of each parent, ``depth`` levels.

    One equi-join for each level; a comment below a dropped one is dropped.
    """
    level = cap_children(comments.where(root), parent, order, width).withColumn("level", F.lit(1))
    out = level
    for n in range(2, depth + 1):
        above = level.select(F.col(key).alias("__above"))
        level = cap_children(comments.join(above, F.col(parent) == F.col("__above")).drop("__above"), parent, order, width).withColumn("level", F.lit(n))
        out = out.unionByName(level)
    return out
